import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_works_without_the_subpackage(tmp_path):
    shutil.copytree(f"{ROOT}/lorequarry", tmp_path / "lorequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_rrf' in q and not any(n.startswith('op') for n in q if n[2:3].isdigit()) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_it():
    for folder, _, names in os.walk(f"{ROOT}/lorequarry"):
        if "/llm" not in folder:
            for name in names:
                if name.endswith(".py"):
                    with open(f"{folder}/{name}") as f:
                        assert not re.search(r"\bllm\b", f.read()), name
