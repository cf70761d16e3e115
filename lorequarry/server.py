"""A tool server: JSON-RPC 2.0, one message a line, over standard input and output. python -m lorequarry.server [CONFIG]"""

from __future__ import annotations

import json
import sys

from pyspark.sql import SparkSession

from . import config as settings
from .cli import records
from .engine import KnowledgeBase
from .errors import KnowledgeError, code_of

TEXT, WHOLE, NUMBER, YES = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
TEXTS = {"type": "array", "items": TEXT}
MAP = {"type": "object", "additionalProperties": TEXT}
#: name: what it does, its parameters, those that are needed
TOOLS = {
    "upload": ("Upload a document: one of path, url, content, content_base64", {"path": TEXT, "url": TEXT, "content": TEXT, "content_base64": TEXT, "title": TEXT, "tags": TEXTS, "metadata": MAP, "force": YES}, []),
    "search": ("Search by hybrid, vector or keyword", {"query": TEXT, "mode": TEXT, "top_k": WHOLE, "graph_expand": WHOLE, "filter": MAP, "prefilter": YES}, ["query"]),
    "list_documents": ("List documents", {"limit": WHOLE, "offset": WHOLE, "order": TEXT}, []),
    "get_document": ("A document and, if asked for, its chunks", {"id": TEXT, "include_chunks": YES}, ["id"]),
    "delete_document": ("Delete a document", {"id": TEXT}, ["id"]),
    "stats": ("Statistics", {}, []),
    "graph_query": ("Walk the graph from an entity or a document", {"from": TEXT, "relation": TEXT, "depth": WHOLE, "limit": WHOLE}, ["from"]),
    "graph_upsert_entity": ("Create or update an entity", {"name": TEXT, "kind": TEXT, "description": TEXT}, ["name", "kind"]),
    "graph_link": ("Link two entities", {"from": TEXT, "to": TEXT, "relation": TEXT, "weight": NUMBER}, ["from", "to", "relation"]),
    "reindex": ("Index all documents anew, or only stale ones", {"dry_run": YES, "stale_only": YES}, []),
}
PROMPT = "Answer strictly from the local knowledge base: call the tool search, and name document_id and chunk_idx of all that you use.\n\nQuestion: "


class Server:
    def __init__(self, base: KnowledgeBase):
        self.base = base

    def tool(self, name: str, given: dict):
        if name not in TOOLS:
            raise KnowledgeError("E_VALIDATION", f"no tool {name}")
        _, known, needed = TOOLS[name]
        if wrong := [k for k in given if k not in known] + [k for k in needed if k not in given]:
            raise KnowledgeError("E_VALIDATION", f"unknown or missing: {', '.join(wrong)}")
        kb, get = self.base, given.get
        match name:
            case "upload":
                return records(kb.upload(**given))[0]
            case "search":
                return records(kb.search(given.pop("query"), **given))
            case "list_documents":
                return records(kb.list(**given))
            case "get_document":
                return records(kb.get(get("id"), get("include_chunks", False)))[0]
            case "delete_document":
                return records(kb.delete(get("id")))[0]
            case "stats":
                return kb.stats()
            case "graph_query":
                nodes, edges = kb.graph_query(get("from"), get("relation"), get("depth", 1), get("limit", 50))
                return {"nodes": records(nodes), "edges": records(edges)}
            case "graph_upsert_entity":
                return {"id": kb.upsert_entity(get("name"), get("kind"), get("description"))}
            case "graph_link":
                kb.link_entities(get("from"), get("to"), get("relation"), get("weight", 1.0))
                return given
            case "reindex":
                return kb.reindex(get("dry_run", False), get("stale_only", False))

    def resource(self, uri: str):
        if uri == "kb://documents":
            return records(self.base.list(100))
        if uri == "kb://stats":
            return self.base.stats()
        if uri.startswith("kb://documents/"):
            return records(self.base.get(uri.removeprefix("kb://documents/"), True))[0]
        raise KnowledgeError("E_VALIDATION", f"no resource {uri}")

    def answer(self, method: str, given: dict):
        match method:
            case "initialize":
                return {"protocolVersion": given.get("protocolVersion", "2025-03-26"), "serverInfo": {"name": "lorequarry", "version": "1"}, "capabilities": {"tools": {}, "resources": {}, "prompts": {}}}
            case "ping":
                return {}
            case "tools/list":
                return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": r}} for n, (d, p, r) in TOOLS.items()]}
            case "tools/call":
                try:
                    return {"content": [{"type": "text", "text": json.dumps(self.tool(given["name"], dict(given.get("arguments") or {})), ensure_ascii=False)}]}
                except Exception as e:
                    return {"content": [{"type": "text", "text": json.dumps({"code": code_of(e)[0], "message": str(e)})}], "isError": True}
            case "resources/list":
                return {"resources": [{"uri": "kb://documents", "name": "documents"}, {"uri": "kb://stats", "name": "stats"}]}
            case "resources/templates/list":
                return {"resourceTemplates": [{"uriTemplate": "kb://documents/{id}", "name": "document"}]}
            case "resources/read":
                return {"contents": [{"uri": given["uri"], "mimeType": "application/json", "text": json.dumps(self.resource(given["uri"]), ensure_ascii=False)}]}
            case "prompts/list":
                return {"prompts": [{"name": "answer", "description": "Answer from the knowledge base", "arguments": [{"name": "question", "required": False}]}]}
            case "prompts/get":
                question = (given.get("arguments") or {}).get("question") or "Answer using the local knowledge base."
                return {"messages": [{"role": "user", "content": {"type": "text", "text": PROMPT + question}}]}
        raise LookupError(method)

    def handle(self, line: str) -> str | None:
        """The answer to a message; None for a notification."""
        try:
            message = json.loads(line)
        except json.JSONDecodeError as e:
            return json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(e)}})
        if "id" not in message:
            return None
        out = {"jsonrpc": "2.0", "id": message["id"]}
        try:
            out["result"] = self.answer(message.get("method", ""), message.get("params") or {})
        except LookupError as e:
            out["error"] = {"code": -32601, "message": f"no method or parameter: {e}"}
        except Exception as e:
            out["error"] = {"code": -32603, "message": str(e), "data": {"code": code_of(e)[0]}}
        return json.dumps(out, ensure_ascii=False)


def main(argv: list[str] | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    server = Server(KnowledgeBase(SparkSession.builder.appName("lorequarry").getOrCreate(), settings.load(argv[0] if argv else None)))
    for line in sys.stdin:
        if line.strip() and (said := server.handle(line)) is not None:
            print(said, flush=True)


if __name__ == "__main__":
    main()
