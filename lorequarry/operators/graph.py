"""The knowledge graph: entities, edges, traversal and graph-expanded search."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import KnowledgeError
from ..functions import text
from ..schema import FOLDERS
from ..store import shared_folder

MAX_DEPTH = 5


#: What an extractor is: from the texts of a batch to the entities of each, as (name, kind), in order.
Extractor = Callable[[list[str]], list[list[tuple[str, str]]]]


def extract(rows: DataFrame, id: str, content: str = "content", extended: bool = False, extractors: Sequence[Extractor] = ()) -> DataFrame:
    """(id, at, name, kind): entity mentions of a row, in the order of extraction; extended: by all rules.

    extractors come after the rules, in their order; each is called once for a batch of rows, on the executors.
    """
    rule = text.extended_entities if extended else text.entities
    every = [rule(F.col(content)), *[plugged(F.col(content), e) for e in extractors]]
    found = rows.select(F.col(id).alias("id"), *[x.alias(f"_e{i}") for i, x in enumerate(every)])
    found = found.select("id", F.posexplode(F.concat(*[F.col(f"_e{i}") for i in range(len(every))])).alias("at", "e"))
    return found.select("id", "at", F.col("e.name").alias("name"), F.col("e.kind").alias("kind"))


def plugged(content: Column, extractor: Extractor) -> Column:
    """The entities that an extractor finds, without those whose names clean to nothing; of a null text none."""

    @F.pandas_udf("array<struct<name:string,kind:string>>")
    def run(texts):
        import pandas as pd

        given = [t or "" for t in texts]
        found = extractor(given)
        if len(found) != len(given):
            raise ValueError(f"an extractor gave {len(found)} results for {len(given)} texts")
        return pd.Series([[{"name": str(n), "kind": str(k)} for n, k in own] for own in found])

    return F.filter(run(content), lambda e: text.clean_name(e["name"]) != "")


def entity_rows(mentions: DataFrame, order: str = "id") -> DataFrame:
    """Rows of the table entity: identity is the cleaned name, and the first kind in order wins."""
    keyed = mentions.withColumn("entity_id", text.clean_name(F.col("name"))).where("entity_id <> ''")
    first = keyed.groupBy("entity_id").agg(F.min_by(F.struct("name", "kind"), F.struct(order, "at")).alias("e"))
    return first.select("entity_id", F.col("e.name").alias("name"), F.col("e.kind").alias("kind"), F.lit(None).cast("string").alias("description"))


def mention_edges(mentions: DataFrame) -> DataFrame:
    """(chunk_id, entity_id), each once."""
    return mentions.select(F.col("id").alias("chunk_id"), text.clean_name(F.col("name")).alias("entity_id")).where("entity_id <> ''").distinct()


def upsert(entities: DataFrame, new: DataFrame) -> DataFrame:
    """entities with those of new: known ones keep name and kind, and take over a description that is given."""
    both = entities.select("entity_id", "name", "kind", "description", F.lit(0).alias("age")).unionByName(new.select("entity_id", "name", "kind", "description", F.lit(1).alias("age")))
    merged = both.groupBy("entity_id").agg(
        F.min_by(F.struct("name", "kind"), F.struct("age", "kind", "name")).alias("e"),
        F.max(F.when(F.col("description").isNotNull(), F.struct("age", "description"))).alias("d"),
    )
    return merged.select("entity_id", F.col("e.name").alias("name"), F.col("e.kind").alias("kind"), F.col("d.description").alias("description"))


def part_of(rows: DataFrame, id: str, content: str = "content") -> DataFrame:
    """(src, dst, relation): each Markdown heading is part of the nearest one before it in its text that has a lower level."""
    heads = rows.select(F.col(id).alias("id"), F.posexplode(text.headings(F.col(content))).alias("at", "h")).select("id", "at", F.col("h.level").alias("level"), text.clean_name(F.col("h.name")).alias("name"))
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("level") == k, F.struct("at", "name"))).over(before) for k in range(1, 6)]
    for k, column in enumerate(last, 1):
        heads = heads.withColumn(f"l{k}", column)
    above = F.greatest(*[F.when(F.col("level") > k, F.col(f"l{k}")) for k in range(1, 6)])
    found = heads.select(F.col("name").alias("src"), above["name"].alias("dst"))
    return found.where("dst is not null and src <> dst and src <> '' and dst <> ''").distinct().select("src", "dst", F.lit("part-of").alias("relation"))


def link(edges: DataFrame, src: str, dst: str, relation: str, weight: float = 1.0) -> DataFrame:
    """One edge more; equal ones may repeat."""
    row = edges.sparkSession.range(1).select(F.lit(src).alias("src"), F.lit(dst).alias("dst"), F.lit(relation).alias("relation"), F.lit(float(weight)).alias("weight"))
    return edges.unionByName(row)


def parse_start(start: str) -> tuple[str, str]:
    """("entity" or "document", id): kind:id, or a bare entity name."""
    kind, sign, rest = start.partition(":")
    if not sign:
        return "entity", _cleaned(start)
    if kind not in ("entity", "document"):
        raise KnowledgeError("E_VALIDATION", f"not an entity or a document: {start}")
    return kind, _cleaned(rest) if kind == "entity" else rest.strip("⟨⟩")


def _cleaned(name: str) -> str:
    out = "".join(c for c in name if c not in "⟨⟩\\'")
    if not out:
        raise KnowledgeError("E_VALIDATION", "an entity name is needed")
    return out


def bfs(starts: DataFrame, edges: DataFrame, depth: int = 1, relation: str | None = None) -> DataFrame:
    """(start, node, depth, parent) of all nodes within depth hops of starts (start, node, depth), along edges src to dst.

    Breadth first: a node has its least depth, and of several ways there the least parent. Starts are part of the
    result. A hop is one equi join, and what was visited is anti-joined. Each level is stored before the next one is
    made from it, so the plan of a hop doesn't hold those before. Edges with a bucket, as they are stored, are read by
    the buckets of the level's nodes only. More hops than MAX_DEPTH are as many as that.
    """
    depth = min(depth, MAX_DEPTH)
    way = edges if relation is None else edges.where(F.col("relation") == relation)
    seen = starts.select("start", "node", F.col("depth").cast("int").alias("depth"), F.lit(None).cast("string").alias("parent"))
    level = seen
    for d in range(1, depth + 1):
        step = level.where(F.col("depth") == d - 1).select("start", F.col("node").alias("src"))
        step = step.join(leaving(way, step, "src").select("src", "dst"), "src")
        new = step.groupBy("start", F.col("dst").alias("node")).agg(F.min("src").alias("parent")).join(seen.select("start", "node"), ["start", "node"], "left_anti")
        level = new.select("start", "node", F.lit(d).alias("depth"), "parent")
        if d < depth:
            level = stored(level)
        seen = seen.unionByName(level)
    return seen


def leaving(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """edges without the folders that hold none of the nodes' edges; the folders' names are all that reaches the driver."""
    column, rule = FOLDERS["related_to"]
    if column not in edges.columns:
        return edges
    wanted = nodes.select(F.expr(rule.replace("src", node))).distinct().collect()  # as many rows as there are folders, at most
    return edges.where(F.col(column).isin([r[0] for r in wanted]))


def stored(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a checkpoint in the folder that the cluster names, which survives lost executors."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def traverse(start: str, documents: DataFrame, chunks: DataFrame, entities: DataFrame, mentions: DataFrame, edges: DataFrame, relation: str | None = None, depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind, depth) and edges (from, to, relation) around a document or an entity.

    A document's neighbours are the entities that its chunks mention; depth 0 is the start alone. An entity is the one
    of that id, or else of that name. At most `limit` nodes besides the start, nearest first, then by id.
    """
    kind, key = parse_start(start)
    if kind == "entity":
        name = start.partition(":")[2] if ":" in start else start
        own = entities.where((F.col("entity_id") == key) | (F.col("name") == name)).orderBy(F.col("entity_id") != key, "entity_id").first()
        key = own["entity_id"] if own else key
    spark = entities.sparkSession
    depth = min(depth, MAX_DEPTH)
    if kind == "document":
        own = documents.where(F.col("document_id") == key)
        if own.isEmpty():
            raise KnowledgeError("E_DOCUMENT_NOT_FOUND", start)
        head = own.select(F.concat(F.lit("document:"), "document_id").alias("id"), F.col("title").alias("name"), F.lit("document").alias("kind"), F.lit(0).alias("depth"))
        begun = chunks.where(F.col("document_id") == key).select("chunk_id").join(mentions, "chunk_id").select("entity_id").distinct()
        starts = begun.select(F.lit(key).alias("start"), F.col("entity_id").alias("node"), F.lit(1).alias("depth"))
        found = bfs(starts.withColumn("depth", F.lit(0)), edges, depth - 1, relation).withColumn("depth", F.col("depth") + 1) if depth else bfs(starts.limit(0), edges, 0)
    else:
        head = spark.range(1).select(F.lit(key).alias("node")).join(entities, F.col("node") == F.col("entity_id"), "left")
        head = head.select(F.concat(F.lit("entity:"), "node").alias("id"), F.coalesce("name", "node").alias("name"), F.coalesce("kind", F.lit("")).alias("kind"), F.lit(0).alias("depth"))
        starts = spark.range(1).select(F.lit(key).alias("start"), F.lit(key).alias("node"), F.lit(0).alias("depth"))
        found = bfs(starts, edges, depth, relation).where("depth > 0")
    named = found.join(entities.select(F.col("entity_id").alias("node"), "name", "kind"), "node")
    kept = named.orderBy("depth", "node").limit(limit)
    nodes = head.unionByName(kept.select(F.concat(F.lit("entity:"), "node").alias("id"), "name", "kind", "depth"))
    root = F.lit(f"{kind}:{key}")
    said = kept.select(F.coalesce(F.concat(F.lit("entity:"), "parent"), root).alias("from"), F.concat(F.lit("entity:"), "node").alias("to"), F.when(F.col("parent").isNull(), F.lit(relation or "mentions")).alias("first"), "parent", "node")
    of = edges if relation is None else edges.where(F.col("relation") == relation)
    labels = of.groupBy(F.col("src").alias("parent"), F.col("dst").alias("node")).agg(F.min("relation").alias("label"))
    joined = said.join(labels, ["parent", "node"], "left")
    return nodes, joined.select("from", "to", F.coalesce("first", "label").alias("relation"))


def expand_hits(hits: DataFrame, mentions: DataFrame, max_expand: int, first: int = 3) -> DataFrame:
    """(query_id, id, score, matched) of chunks that share entities with the first hits (query_id, id, rank), and are no hits.

    At most max_expand chunks for each entity, by id, then max_expand in all for a query; each chunk once, score 1.
    matched: the entities by which it came, sorted. Of an entity with very many chunks each task keeps max_expand
    before anything is shuffled. Sides are broadcast where Spark finds them small.
    """
    seeds = hits.where(F.col("rank") <= first).select("query_id", F.col("id").alias("chunk_id"))
    entities = seeds.join(mentions, "chunk_id").select("query_id", "entity_id").distinct()
    near = mentions.select("entity_id", F.col("chunk_id").alias("id")).join(entities, "entity_id")
    per = Window.partitionBy("query_id", "entity_id").orderBy("id")
    held = near.withColumn("n", F.row_number().over(per)).where(F.col("n") <= max_expand)
    new = held.groupBy("query_id", "id").agg(F.sort_array(F.collect_set("entity_id")).alias("matched")).join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
    best = Window.partitionBy("query_id").orderBy("id")
    return new.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_expand).select("query_id", "id", F.lit(1.0).alias("score"), "matched")


def reached(hits: DataFrame, mentions: DataFrame, edges: DataFrame, hops: int, decay: float = 0.5, first: int = 3) -> DataFrame:
    """(query_id, entity_id, reach): how much of the first hits' scores comes to an entity, over at most `hops` edges.

    What a hit (query_id, id, rank, score) mentions has its score times decay, and an edge (src, dst, weight) passes on
    what its source has, times decay and its weight, 1 at most; of several ways the best counts. All queries and all
    starts go at once: a hop is one equi join with the edges of the frontier, combined to one row for each node before
    the shuffle, and only nodes whose reach grew go on. Each level is stored before the next is made from it.
    """
    seeds = hits.where(F.col("rank") <= first).select("query_id", F.col("id").alias("chunk_id"), "score")
    best = lambda rows: rows.groupBy("query_id", "entity_id").agg(F.max("reach").alias("reach"))
    found = best(seeds.join(mentions, "chunk_id").select("query_id", "entity_id", (F.col("score") * decay).alias("reach")))
    front = found
    for hop in range(min(hops, MAX_DEPTH)):
        if hop:
            found, front = stored(found), stored(front)
        way = leaving(edges, front, "entity_id").select(F.col("src").alias("entity_id"), "dst", F.least(F.coalesce("weight", F.lit(1.0)), F.lit(1.0)).alias("weight")).where("weight > 0")
        step = best(front.join(way, "entity_id").select("query_id", F.col("dst").alias("entity_id"), (F.col("reach") * decay * F.col("weight")).alias("reach")))
        had = found.withColumnRenamed("reach", "had")
        front = step.join(had, ["query_id", "entity_id"], "left").where("had is null or reach > had").drop("had")
        found = best(found.unionByName(front))
    return found


def reranked(hits: DataFrame, mentions: DataFrame, reach: DataFrame, max_expand: int, digits: int = 6) -> DataFrame:
    """(query_id, id, score, rank, matched): hits and at most max_expand further chunks of each query, ranked anew.

    A chunk's score is its own, 0 if it is no hit, and the best reach (query_id, entity_id, reach) of what it mentions,
    times decay already; ties go by id. matched: the entities of a further chunk that give it that reach, sorted.
    Of an entity with very many chunks each task keeps the max_expand first by id, which are the only ones that can be
    among its best, before anything is shuffled.
    """
    near = mentions.select("entity_id", F.col("chunk_id").alias("id")).join(reach, "entity_id")
    own = hits.select("query_id", "id", F.col("score").alias("own"))
    of_hits = near.join(own.drop("own"), ["query_id", "id"], "left_semi").groupBy("query_id", "id").agg(F.max("reach").alias("reach"))
    told = own.join(of_hits, ["query_id", "id"], "left").select("query_id", "id", F.round(F.col("own") + F.coalesce("reach", F.lit(0.0)), digits).alias("score"), F.array().cast("array<string>").alias("matched"))
    per = Window.partitionBy("query_id", "entity_id").orderBy("id")
    more = near.join(own.drop("own"), ["query_id", "id"], "left_anti").withColumn("n", F.row_number().over(per)).where(F.col("n") <= max_expand)
    more = more.withColumn("reach", F.round("reach", digits)).groupBy("query_id", "id", "reach").agg(F.sort_array(F.collect_set("entity_id")).alias("matched"))
    more = more.groupBy("query_id", "id").agg(F.max(F.struct("reach", "matched")).alias("m")).select("query_id", "id", F.col("m.reach").alias("score"), F.col("m.matched").alias("matched"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    more = more.withColumn("n", F.row_number().over(best)).where(F.col("n") <= max_expand).drop("n")
    return told.unionByName(more).withColumn("rank", F.row_number().over(best)).select("query_id", "id", "score", "rank", "matched")


def appended(hits: DataFrame, more: DataFrame) -> DataFrame:
    """hits (query_id, id, score, rank) and then more, whose ranks go on after them."""
    last = hits.groupBy("query_id").agg(F.max("rank").alias("last"))
    order = Window.partitionBy("query_id").orderBy("id")
    ranked = more.withColumn("n", F.row_number().over(order)).join(last, "query_id", "left")
    return hits.select("query_id", "id", "score", "rank").unionByName(ranked.select("query_id", "id", "score", (F.coalesce("last", F.lit(0)) + F.col("n")).alias("rank")))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
