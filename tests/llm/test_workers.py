import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import os, sys
assert "lorequarry" not in sys.modules
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.checkpoint.dir", os.getcwd() + "/checkpoints").config("spark.sql.warehouse.dir", os.getcwd() + "/warehouse").getOrCreate()
)
spark.sparkContext.setLogLevel("ERROR")

def importable(rows):
    import importlib.util
    yield from [importlib.util.find_spec("lorequarry") is not None]

assert not any(spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect())
for name, query in entry.queries().items():
    if name == "pipeline" or name.startswith("op") or name in ("hf_chunking", "hashing_search", "vector_topk_batch", "lsh_topk"):
        rows = query(spark, "/root/testdata/sf0.001").count()
        print(name, rows, flush=True)
"""


def test_executors_need_no_copy_of_the_library(tmp_path):
    """Every query that runs Python on executors, where workers can't import the library."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=1200)
    assert done.returncode == 0, done.stdout + done.stderr[-3000:]
    counted = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("op", "pipeline")))
    assert len(counted) == 14 and all(int(n) > 0 for n in counted.values())
