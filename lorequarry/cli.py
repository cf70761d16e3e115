"""Command line: python -m lorequarry.cli COMMAND. Prints JSON; a failure prints its code and exits with its number."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from . import config as settings
from .engine import KnowledgeBase
from .errors import KnowledgeError, code_of


def records(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lorequarry", description=__doc__)
    top.add_argument("--config")
    top.add_argument("--format", choices=["json", "table"], default="json", help="table: one line of JSON")
    commands = top.add_subparsers(dest="command", required=True)

    up = commands.add_parser("upload")
    up.add_argument("--path", action="append", help="a file, a glob or a folder; may repeat")
    up.add_argument("--recursive", action="store_true")
    up.add_argument("--url", action="append")
    up.add_argument("--stdin", action="store_true")
    up.add_argument("--base64", action="store_true", help="standard input is base64")
    up.add_argument("--title")
    up.add_argument("--tag", action="append", default=[])
    up.add_argument("--meta", action="append", default=[], metavar="KEY=VALUE")
    up.add_argument("--force", action="store_true")

    find = commands.add_parser("search")
    find.add_argument("query", nargs="+")
    find.add_argument("--mode", choices=["vector", "keyword", "hybrid"])
    find.add_argument("--top-k", type=int)
    find.add_argument("--graph-expand", type=int, default=0)
    find.add_argument("--filter", action="append", default=[], metavar="KEY=VALUE")
    find.add_argument("--prefilter", action="store_true")

    page = commands.add_parser("list")
    page.add_argument("--limit", type=int, default=50)
    page.add_argument("--offset", type=int, default=0)
    page.add_argument("--order", default="created_desc")

    get = commands.add_parser("get")
    get.add_argument("id")
    get.add_argument("--chunks", action="store_true")
    commands.add_parser("delete").add_argument("id", nargs="+")
    commands.add_parser("stats")
    commands.add_parser("doctor")
    again = commands.add_parser("reindex")
    again.add_argument("--dry-run", action="store_true")
    again.add_argument("--stale-only", action="store_true", help="only what was made by another embedder, tokenizer or window")
    commands.add_parser("query", help="SQL over the tables").add_argument("sql")

    graph = commands.add_parser("graph").add_subparsers(dest="action", required=True)
    walk = graph.add_parser("query")
    walk.add_argument("start")
    walk.add_argument("--relation")
    walk.add_argument("--depth", type=int, default=1)
    walk.add_argument("--limit", type=int, default=50)
    entity = graph.add_parser("entity")
    entity.add_argument("name")
    entity.add_argument("kind")
    entity.add_argument("--description")
    link = graph.add_parser("link")
    for name in ("src", "dst", "relation"):
        link.add_argument(name)
    link.add_argument("--weight", type=float, default=1.0)

    conf = commands.add_parser("config").add_subparsers(dest="action", required=True)
    conf.add_parser("init")
    conf.add_parser("show")
    put = conf.add_parser("set")
    put.add_argument("key")
    put.add_argument("value")
    return top


def configure(args) -> dict:
    path = Path(args.config) if args.config else settings.default_paths()[0]
    if args.action == "init":
        if path.exists():
            raise KnowledgeError("E_CONFIG", f"{path} exists")
        text = "".join(f"[{s}]\n" + "".join(f"{k} = {json.dumps(list(v) if isinstance(v, tuple) else v)}\n" for k, v in keys.items()) + "\n" for s, keys in settings.Config().to_dict().items())
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
        return {"path": str(path)}
    if args.action == "set":
        path.write_text(settings.set_key(path.read_text() if path.exists() else "", args.key, args.value))
        return {"path": str(path), "key": args.key, "value": settings.parse_scalar(args.value)}
    return settings.load(args.config).to_dict()


def upload(base: KnowledgeBase, args) -> list[dict]:
    how = {"title": args.title, "tags": args.tag, "metadata": settings.parse_filters(args.meta), "force": args.force}
    if args.path and args.recursive:
        from . import sources

        rows = sources.from_files(base.spark, args.path, base.config, recursive=True, title=args.title)
        return records(base.upload_rows(sources.extracted(rows, args.tag, how["metadata"]), args.force))
    data = sys.stdin.read() if args.stdin or args.base64 else None
    source = {"content_base64": data} if args.base64 else {"content": data}
    return records(base.upload(path=args.path, url=args.url, **source, **how))


def run(args, spark: SparkSession):
    base = KnowledgeBase(spark, settings.load(args.config), check_model=args.command not in ("reindex", "doctor"))
    match args.command:
        case "upload":
            return upload(base, args)
        case "search":
            return records(base.search(args.query, args.mode, args.top_k, args.graph_expand, settings.parse_filters(args.filter), args.prefilter))
        case "list":
            return records(base.list(args.limit, args.offset, args.order))
        case "get":
            return records(base.get(args.id, args.chunks))[0]
        case "delete":
            return records(base.delete(args.id))
        case "stats":
            return base.stats()
        case "doctor":
            return base.doctor()
        case "reindex":
            return base.reindex(args.dry_run, args.stale_only)
        case "query":
            base.create_views()
            return records(spark.sql(args.sql))
        case "graph" if args.action == "query":
            nodes, edges = base.graph_query(args.start, args.relation, args.depth, args.limit)
            return {"nodes": records(nodes), "edges": records(edges)}
        case "graph" if args.action == "entity":
            return {"id": base.upsert_entity(args.name, args.kind, args.description)}
        case "graph":
            base.link_entities(args.src, args.dst, args.relation, args.weight)
            return {"from": args.src, "to": args.dst, "relation": args.relation, "weight": args.weight}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        if args.command == "config":
            out = configure(args)
        else:
            out = run(args, spark or SparkSession.builder.appName("lorequarry").getOrCreate())
    except Exception as e:
        code, number = code_of(e)
        print(json.dumps({"error": {"code": code, "message": str(e)}}), file=sys.stderr)
        return number
    print(json.dumps(out, indent=2 if args.format == "json" else None, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
