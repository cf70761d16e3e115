import json

import pytest

from lorequarry.config import Config, Embedding, Storage
from lorequarry.engine import KnowledgeBase
from lorequarry.server import TOOLS, Server


@pytest.fixture(scope="module")
def server(spark, tmp_path_factory):
    return Server(KnowledgeBase(spark, Config(storage=Storage(path=str(tmp_path_factory.mktemp("kb"))), embedding=Embedding(onnx_path="mock", dimension=8))))


def ask(server, method, **params):
    return json.loads(server.handle(json.dumps({"jsonrpc": "2.0", "id": 1, "method": method, "params": params})))


def call(server, tool, /, **arguments):
    out = ask(server, "tools/call", name=tool, arguments=arguments)["result"]
    return json.loads(out["content"][0]["text"]), out.get("isError", False)


def test_tools(server):
    assert {t["name"] for t in ask(server, "tools/list")["result"]["tools"]} == set(TOOLS) and len(TOOLS) == 10
    doc, _ = call(server, "upload", content="hello #world", title="t", tags=["a"], metadata={"k": "v"})
    assert doc["status"] == "created"
    assert call(server, "search", query="hello", mode="keyword", filter={"title": "t"})[0][0]["title"] == "t"
    assert call(server, "list_documents", limit=1)[0][0]["chunk_count"] == 1 and call(server, "stats")[0]["document_count"] == 1
    assert call(server, "get_document", id=doc["document_id"], include_chunks=True)[0]["chunks"][0]["token_count"] == 2
    call(server, "graph_upsert_entity", name="A", kind="x")
    call(server, "graph_link", **{"from": "world", "to": "A", "relation": "r"})
    assert len(call(server, "graph_query", **{"from": "world"})[0]["nodes"]) == 2
    assert call(server, "reindex", dry_run=True)[0]["documents_processed"] == 1
    assert json.loads(ask(server, "resources/read", uri=f"kb://documents/{doc['document_id']}")["result"]["contents"][0]["text"])["title"] == "t"
    assert call(server, "delete_document", id=doc["document_id"])[0]["chunks_deleted"] == 1
    for name, given in (("get_document", {"id": "no"}), ("nothing", {}), ("search", {}), ("stats", {"x": 1})):
        out, failed = call(server, name, **given)
        assert failed and out["code"].startswith("E_")


def test_protocol(server):
    assert ask(server, "initialize")["result"]["serverInfo"]["name"] == "lorequarry" and ask(server, "ping")["result"] == {}
    assert len(ask(server, "resources/list")["result"]["resources"]) == 2 and ask(server, "resources/templates/list")["result"]["resourceTemplates"]
    assert ask(server, "prompts/list")["result"]["prompts"][0]["name"] == "answer"
    assert "why?" in ask(server, "prompts/get", name="answer", arguments={"question": "why?"})["result"]["messages"][0]["content"]["text"]
    assert ask(server, "no/such")["error"]["code"] == -32601 and json.loads(server.handle("{"))["error"]["code"] == -32700
    assert ask(server, "resources/read", uri="kb://x")["error"]["data"]["code"] == "E_VALIDATION"
    assert server.handle(json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"})) is None
