"""Retrieval: vector, keyword and hybrid search, for one query or for many at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import KnowledgeError
from ..functions import vectors
from ..schema import FILTER_FIELDS, all_of
from .index import keyword_scores

MODES = ("vector", "keyword", "hybrid")
#: Rows that a side may have to be broadcast without a hint from statistics; the number of queries is checked against it.
MAX_QUERIES = 10_000
#: So many hits of all queries together are broadcast to the tables that tell of them.
MAX_HITS = 1_000_000
#: So many hits at most are named in the scans of what tells of them, which then skip what can't hold them.
NAMED_HITS = 2_000
#: Scores are compared after rounding to so many digits, so that ties don't hang on the order of a sum.
DIGITS = 6


def check_filter(given: Mapping[str, str] | None) -> dict[str, str]:
    """Also an error where nothing was found."""
    for name in given or {}:
        if name not in FILTER_FIELDS:
            raise KnowledgeError("E_VALIDATION", f"unsupported filter field: {name}")
    return dict(given or {})


def check_queries(queries: DataFrame, limit: int = MAX_QUERIES) -> DataFrame:
    """queries as a side to broadcast, if it is small enough."""
    if queries.limit(limit + 1).count() > limit:
        raise KnowledgeError("E_VALIDATION", f"more than {limit} queries at once")
    return F.broadcast(queries)


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the k best of each query; ties by id.

    Spark keeps just the k best rows of a query in every task before they are shuffled.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("score", F.round("score", DIGITS)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def vector_scores(rows: DataFrame, queries: DataFrame, id: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, score): the exact cosine of every row with every query of queries (query_id, vector).

    Norms are computed once per row. Zero vectors, and those of another length than the query's, are left out.
    """
    base = rows.select(F.col(id).alias("id"), F.col(embedding).alias("e"), vectors.norm(F.col(embedding)).alias("en"))
    asked = check_queries(queries.select("query_id", F.col("vector").alias("q"), vectors.norm(F.col("vector")).alias("qn")))
    pairs = base.where("en > 0").crossJoin(asked).where((F.col("qn") > 0) & (F.size("e") == F.size("q")))
    return pairs.select("query_id", "id", (vectors.dot(F.col("e"), F.col("q")) / (F.col("en") * F.col("qn"))).alias("score"))


def vectors_of(queries: DataFrame) -> list:
    """(query_id, unit vector) of queries (query_id, vector), of a checked number; those that are null, zero or not finite are left out."""
    import numpy as np

    asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("q"))
    rows = asked.limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise KnowledgeError("E_VALIDATION", f"more than {MAX_QUERIES} queries at once")
    out = []
    for r in rows:
        if r["q"] and all(x is not None for x in r["q"]):
            v = np.asarray(r["q"], np.float64)
            size = float(np.linalg.norm(v))
            if np.isfinite(size) and size > 0:
                out.append((r["query_id"], v / size))
    return out


def scanned(rows: DataFrame, given: list, wanted: dict[int, list[int]], k: int, query_id: T.StructField) -> DataFrame:
    """(query_id, id, score): of rows (cell, id, embedding) those that may be among the k best of a query of given.

    wanted: the queries, by their place in given, that a cell is read for. A task takes one matrix product for each
    batch and cell, and keeps the k best of each query across its batches; ties after rounding go by id. It puts out
    at most k rows for a query, all at its end.
    """
    shared = rows.sparkSession.sparkContext.broadcast((given, wanted))
    base = rows.select("cell", "id", F.col("embedding").cast("array<double>").alias("e"))
    made = T.StructType([query_id, base.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        queries, asked = shared.value
        best: dict = {}  # of a query's place: [(-rounded score, id, score)], sorted, at most k
        by_cell: dict = {}
        for cell, places in asked.items():
            for place in places:
                by_cell.setdefault((cell, len(queries[place][1])), []).append(place)
        for batch in batches:
            lists, cells = batch.column(2), batch.column(0).to_numpy(zero_copy_only=False)
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            there, which = np.unique(np.stack([cells, lengths]), axis=1, return_inverse=True)
            for i, key in enumerate(zip(*there.tolist())):
                if key not in by_cell:
                    continue
                places, length = by_cell[key], key[1]
                at = np.flatnonzero(which.ravel() == i)
                e = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
                sizes = np.sqrt(np.einsum("ij,ij->i", e, e))
                fine = np.flatnonzero(sizes > 0)  # not null, nor zero
                at, e = at[fine], e[fine] / sizes[fine][:, None]
                for first in range(0, len(places), 256):
                    part = places[first : first + 256]
                    scores = e @ np.stack([queries[p][1] for p in part]).T
                    rounded = np.floor(scores * 10.0**DIGITS + 0.5)
                    for j, place in enumerate(part):
                        own, column = best.setdefault(place, []), rounded[:, j]
                        near = np.flatnonzero(column >= -own[-1][0]) if len(own) >= k else np.arange(len(column))
                        if len(near) > 4 * k:
                            least = np.partition(column[near], len(near) - k)[len(near) - k]
                            near = near[column[near] >= least]
                        if len(near):
                            ids = batch.column(1).take(pa.array(at[near])).to_pylist()
                            best[place] = sorted([*own, *zip(-column[near], ids, scores[near, j])], key=lambda x: x[:2])[:k]
        flat = [(queries[place][0], id, score) for place, own in best.items() for _, id, score in own]
        for first in range(0, len(flat), 10_000):
            part = list(zip(*flat[first : first + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(part, made)], [f.name for f in made])

    return base.mapInArrow(run, made)


def vector_search(rows: DataFrame, queries: DataFrame, k: int, id: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """The k best of each query (query_id, vector) by exact cosine, in double precision, as vector_scores() gives them.

    For rows without an index: all of them are read, as one cell. The queries, of a checked number, are broadcast as a
    matrix. Zero vectors, and those of another length than the query's, are left out.
    """
    given = vectors_of(queries)
    base = rows.select(F.lit(0).alias("cell"), F.col(id).alias("id"), F.col(embedding).alias("embedding"))
    return top_k(scanned(base, given, {0: list(range(len(given)))}, k, queries.schema["query_id"]), k)


def undefined_pairs(rows: DataFrame, queries: DataFrame, k: int, id: str = "chunk_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, id, score): of each query (query_id, vector) the k first rows, by id, whose cosine isn't defined, as one of
    the two vectors is zero; the score is NaN. Of either side just the k first are paired."""
    zero = lambda v: ~F.exists(v, lambda x: x != 0)
    asked = check_queries(queries.select("query_id", zero(F.col("vector")).alias("none")))
    every = rows.select(F.col(id).alias("id"), zero(F.col(embedding)).alias("zero"))
    lame = every.where("zero").orderBy("id").limit(k).select("id").crossJoin(asked.where("not none"))
    whole = every.where("zero is not null").orderBy("id").limit(k).select("id").crossJoin(asked.where("none"))
    return lame.unionByName(whole).select("query_id", "id", F.lit(float("nan")).alias("score"))


def keyword_search(rows: DataFrame, queries: DataFrame, k: int, **how) -> DataFrame:
    return top_k(keyword_scores(rows, queries, **how), k)


def rrf(lists: list[DataFrame], rrf_k: int = 60) -> DataFrame:
    """(query_id, id, score): reciprocal rank fusion (Cormack, Clarke and Buettcher 2009) of lists (query_id, id, rank)."""
    part = [x.select("query_id", "id", (1.0 / (max(rrf_k, 1) + F.col("rank"))).alias("part")) for x in lists]
    both = part[0]
    for x in part[1:]:
        both = both.unionByName(x)
    return both.groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def hybrid_search(rows: DataFrame, vector_queries: DataFrame, term_queries: DataFrame, k: int, rrf_k: int = 60, id: str = "chunk_id", embedding: str = "embedding", content: str = "content", **bm25) -> DataFrame:
    """The k best by fused rank of the 3 k best by vector and by keyword."""
    by_vector = vector_search(rows, vector_queries, 3 * k, id=id, embedding=embedding)
    by_term = keyword_search(rows, term_queries, 3 * k, id=id, content=content, **bm25)
    return fused(by_vector, by_term, k, rrf_k)


def fused(by_vector: DataFrame, by_term: DataFrame, k: int, rrf_k: int = 60) -> DataFrame:
    return top_k(rrf([by_vector, by_term], rrf_k), k)


def filtered(hits: DataFrame, documents: DataFrame, given: Mapping[str, str] | None) -> DataFrame:
    """Hits (with document_id) whose document has all the given values. After the top k, so fewer may be left."""
    given = check_filter(given)
    if not given:
        return hits
    keep = documents.where(all_of([F.col(c) == v for c, v in given.items()])).select("document_id")
    return hits.join(keep, "document_id").select(*hits.columns)


def lsh_search(rows: DataFrame, queries: DataFrame, k: int, id: str = "chunk_id", embedding: str = "embedding", tables: int = 20, bits: int = 4, seed: int = 7) -> DataFrame:
    """Approximate top k by random hyperplanes: only rows that share a bucket with the query count. Vectors of one length.

    A row at an angle of a (of a half turn) is found with probability 1 - (1 - (1 - a) ** bits) ** tables: 0.97 at 0.35,
    that is, at a cosine of 0.45. Fewer bits find more and score more.

    No vector is shuffled: the queries, of a checked number, are broadcast with their buckets, and a task keeps the k best
    of each query of those rows that it reads and that share one of its buckets.
    """
    import random

    width = rows.where(F.col(embedding).isNotNull()).select(F.size(embedding).alias("n")).first()
    if width is None:
        return vector_search(rows, queries, k, id=id, embedding=embedding)
    n = width["n"]
    rng = random.Random(seed)
    planes = [[[rng.gauss(0, 1) for _ in range(n)] for _ in range(bits)] for _ in range(tables)]
    given = [(q, v) for q, v in vectors_of(queries) if len(v) == n]
    shared = rows.sparkSession.sparkContext.broadcast((planes, given))
    base = rows.select(F.col(id).alias("id"), F.col(embedding).cast("array<double>").alias("e")).where((F.size("e") == n) & ~F.exists("e", lambda x: x.isNull()))
    made = T.StructType([queries.schema["query_id"], base.schema["id"], T.StructField("score", T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        own, asked = shared.value
        across = np.array(own).reshape(-1, n).T
        weights = 1 << np.arange(bits)
        codes = lambda e: ((e @ across > 0).reshape(-1, tables, bits) * weights).sum(2).T.astype(np.int32)  # noqa: E731 of each table
        vectors_ = np.array([v for _, v in asked]).reshape(-1, n)
        theirs = codes(vectors_)
        best: list = [[] for _ in asked]  # of each query: [(-rounded score, id, score)], sorted, at most k
        for batch in batches:
            e = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            sizes = np.sqrt(np.einsum("ij,ij->i", e, e))
            fine = np.flatnonzero((sizes > 0) & np.isfinite(sizes))
            e = e[fine]
            mine, e = codes(e), e / sizes[fine][:, None]
            for first in range(0, len(asked), 128):
                part = slice(first, first + 128)
                near = np.zeros((len(asked[part]), len(e)), bool)
                for a, b in zip(theirs[:, part], mine):
                    near |= a[:, None] == b[None]
                scores = np.where(near, vectors_[part] @ e.T, -np.inf)
                rounded = np.floor(scores * 10.0**DIGITS + 0.5)
                for j, held in enumerate(best[part]):
                    row = rounded[j]
                    at = np.flatnonzero(row >= -held[-1][0] if len(held) >= k else near[j])
                    if len(at) > 4 * k:
                        at = at[row[at] >= np.partition(row[at], len(at) - k)[len(at) - k]]
                    if len(at):
                        ids = batch.column(0).take(pa.array(fine[at])).to_pylist()
                        held[:] = sorted([*held, *zip(-row[at], ids, scores[j, at])], key=lambda x: x[:2])[:k]
        flat = [(q, id_, score) for (q, _), held in zip(asked, best) for _, id_, score in held]
        for first in range(0, len(flat), 10_000):
            part = list(zip(*flat[first : first + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(part, made)], [f.name for f in made])

    return top_k(base.mapInArrow(run, made), k)
