import io
import json

import pytest

from lorequarry.cli import main


@pytest.fixture()
def cli(spark, tmp_path, capsys, monkeypatch):
    conf = tmp_path / "c.toml"
    conf.write_text(f'search = {{ rrf_k = 10 }}\n[embedding]\nonnx_path = "mock"\ndimension = 8\n[storage]\npath = "{tmp_path}/kb"\n')

    def call(*argv, stdin=None, code=0):
        if stdin is not None:
            monkeypatch.setattr("sys.stdin", io.StringIO(stdin))
        capsys.readouterr()
        assert main(["--config", str(conf), *argv], spark) == code
        out = capsys.readouterr()
        return json.loads(out.out if code == 0 else out.err)

    call.path = conf
    return call


def test_documents(cli, tmp_path):
    doc = cli("upload", "--stdin", "--title", "t", "--tag", "x", "--meta", "a=b", stdin="# Head\n\nhello [Graph](x) world")[0]
    assert doc["status"] == "created" and doc["entities"] == ["Graph", "Head"]
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "n.txt").write_text("hello file")
    assert cli("upload", "--path", str(tmp_path / "in"), "--recursive")[0]["title"] == "n.txt"
    assert cli("upload", "--base64", stdin="aGVsbG8gYmFzZQ==")[0]["status"] == "created"
    assert {h["title"] for h in cli("search", "hello", "--mode", "keyword")} == {"t", "n.txt", "base64"}
    assert [h["title"] for h in cli("search", "hello", "--mode", "keyword", "--filter", "title=t")] == ["t"]
    assert cli("stats")["document_count"] == 3 and len(cli("list", "--limit", "2")) == 2
    assert cli("get", doc["document_id"], "--chunks")["chunks"][0]["idx"] == 0
    assert cli("query", "SELECT count(*) AS n FROM chunk") == [{"n": 3}]
    assert cli("reindex", "--dry-run")["documents_processed"] == 3 and len(cli("doctor")) == 5
    assert cli("delete", doc["document_id"])[0]["chunks_deleted"] == 1
    assert cli("get", doc["document_id"], code=6)["error"]["code"] == "E_DOCUMENT_NOT_FOUND"
    assert cli("search", "x", "--filter", "bad=1", code=8)["error"]["code"] == "E_VALIDATION"


def test_graph(cli):
    cli("graph", "entity", "A", "test")
    cli("graph", "entity", "B", "test", "--description", "d")
    cli("graph", "link", "A", "B", "knows")
    out = cli("graph", "query", "A")
    assert [n["id"] for n in out["nodes"]] == ["entity:A", "entity:B"] and out["edges"][0]["relation"] == "knows"


def test_config(cli, tmp_path):
    cli("config", "set", "search.rrf_k", "42")
    assert "search = { rrf_k = 42 }" in cli.path.read_text() and cli("config", "show")["search"]["rrf_k"] == 42
    assert main(["--config", str(tmp_path / "new.toml"), "config", "init"]) == 0
    assert main(["--config", str(tmp_path / "new.toml"), "config", "init"]) == 2
