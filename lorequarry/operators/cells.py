"""The stored vector index: vectors in cells around trained centers, and how far each cell reaches."""

from __future__ import annotations

from dataclasses import dataclass, field
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import search

#: Centers are trained once there are so many vectors; until then all are in the cell of those without a center.
TRAIN_FROM = 512
#: At most so many cells, and so many vectors for each to train on: what reaches the driver is one vector for a cell.
MAX_CELLS, SAMPLE = 4096, 64
#: Values that ids are hashed to, to choose the sample.
HASHES = 1 << 40
#: The cell of vectors that came before the centers; it is always read.
UNASSIGNED = 0
STATS = "cell int, rows long, radius double"


def trained(rows: DataFrame, count: int, seed: int = 7) -> list[list[float]]:
    """Unit centers for rows (chunk_id, embedding), about as many as the root of their number, by k-means over a sample.

    The sample is about SAMPLE vectors for each center, those whose ids have the least hashes. They are chosen where they
    are read, by a limit that follows from the number, and the rounds run there too: nothing is sorted, and no task has
    them all.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import Normalizer
    from pyspark.ml.functions import array_to_vector

    k = max(2, min(MAX_CELLS, isqrt(count)))
    some = rows.where(F.pmod(F.xxhash64("chunk_id"), F.lit(HASHES)) < HASHES * k * SAMPLE // max(count, 1))
    fine = some.where(F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    chosen = Normalizer(inputCol="e", outputCol="features").transform(fine.select(array_to_vector("embedding").alias("e"))).select("features")
    if chosen.isEmpty():
        return []
    found = KMeans(k=k, seed=seed, maxIter=8, initMode="random").fit(chosen).clusterCenters()
    out = []
    for center in found:
        size = float((center**2).sum()) ** 0.5
        if size > 0:
            out.append([float(x) / size for x in center])
    return out


def assigned(rows: DataFrame, centers: list[list[float]]) -> DataFrame:
    """rows (chunk_id, document_id, embedding) with cell, the nearest center's (from 1), and angle, to that center.

    Vectors that no query can be like, zero ones and those with null components, are left out. Those of another length
    than the centers', or too large to tell their angle, come to the cell that is always read.
    """
    import numpy as np

    fine = rows.select("chunk_id", "document_id", "embedding")
    if not centers:
        usable = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
        return fine.where(usable).withColumns({"cell": F.lit(UNASSIGNED), "angle": F.lit(np.pi)})
    shared = rows.sparkSession.sparkContext.broadcast(np.array(centers))
    made = T.StructType([*fine.schema, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            lists, c = batch.column(2), shared.value
            lengths = np.asarray(lists.value_lengths().fill_null(0))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            owner = np.repeat(np.arange(len(lengths)), lengths)
            bad, any_ = (np.bincount(owner, x, len(lengths)) > 0 for x in (np.isnan(flat), flat != 0))
            cell, angle = np.full(len(lengths), UNASSIGNED, np.int32), np.full(len(lengths), np.pi)
            sizes = np.sqrt(np.bincount(owner, flat * flat, len(lengths)))
            at = np.flatnonzero((lengths == c.shape[1]) & any_ & ~bad & np.isfinite(sizes) & (sizes > 0))
            if len(at):
                e = flat[np.isin(owner, at)].reshape(-1, c.shape[1]) / sizes[at][:, None]
                for first in range(0, len(at), 2048):
                    part = slice(first, first + 2048)
                    near = e[part] @ c.T
                    best = near.argmax(1)
                    cell[at[part]], angle[at[part]] = best + 1, np.arccos(np.clip(near[np.arange(len(best)), best], -1, 1))
            kept = pa.array(np.flatnonzero(any_ & ~bad))
            yield pa.RecordBatch.from_arrays([*[batch.column(i).take(kept) for i in range(3)], pa.array(cell).take(kept), pa.array(angle).take(kept)], [f.name for f in made])

    return fine.mapInArrow(run, made)


def reach(placed: DataFrame) -> DataFrame:
    """STATS of assigned rows."""
    return placed.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.max("angle").alias("radius"))


@dataclass
class Report:
    """What a search read: cells and their vectors, of how many; and whether each query's answer is certain."""

    cells: int = 0
    read: int = 0
    vectors: int = 0
    vectors_read: int = 0
    certain: dict = field(default_factory=dict)


def cell_search(stored: DataFrame, centers: list[list[float]], stats: dict[int, tuple[int, float]], queries: DataFrame, k: int, exact: bool = True, probes: int = 8) -> tuple[DataFrame, Report]:
    """(query_id, id, score, rank) of the k best of stored (cell, chunk_id, embedding) for each query (query_id, vector).

    First the cells nearest to a query are read, `probes` of them at least and as many as hold 4 k vectors. No vector of
    a cell is nearer to a query than the angle to its center less the cell's radius; so once a cell's bound is below
    the k-th score found, it can't matter. With exact, the cells that may matter yet are read as well, and the result is
    that of a scan over all vectors; without, only where fewer than k were found. The report tells which answers are
    certain either way. Only the folders of the named cells are read, and a cell only for the queries that ask for it.
    """
    import numpy as np

    given = search.vectors_of(queries)
    report = Report(cells=len(stats), vectors=sum(n for n, _ in stats.values()))
    numbers = np.array(sorted(stats), np.int64)
    sizes, radii = np.array([stats[c][0] for c in numbers]), np.array([stats[c][1] for c in numbers])
    bounds = np.ones((len(given), len(numbers)))
    near = np.full((len(given), len(numbers)), 2.0)
    known = np.flatnonzero(numbers != UNASSIGNED)
    if centers and len(known):
        c = np.array(centers)[numbers[known] - 1]
        for i, (_, q) in enumerate(given):
            if len(q) == c.shape[1]:
                near[i, known] = c @ q
                bounds[i, known] = np.cos(np.maximum(0.0, np.arccos(np.clip(near[i, known], -1, 1)) - radii[known] - 1e-7))
    asked = np.zeros(near.shape, bool)
    for i in range(len(given)):
        order = np.argsort(-near[i], kind="stable")
        held = np.cumsum(sizes[order])
        first = max(probes, int(np.searchsorted(held, 4 * k)) + 1)
        asked[i, order[:first]] = True

    def scan(wanted) -> DataFrame:
        cells = {int(numbers[j]): np.flatnonzero(wanted[:, j]).tolist() for j in np.flatnonzero(wanted.any(0))}
        report.read += len(cells)
        report.vectors_read += int(sum(stats[c][0] for c in cells))
        rows = stored.where(F.col("cell").isin([*cells])).select("cell", F.col("chunk_id").alias("id"), "embedding")
        return search.scanned(rows, given, cells, k, queries.schema["query_id"])

    if not len(numbers) or not given:
        return search.top_k(search.scanned(stored.select("cell", F.col("chunk_id").alias("id"), "embedding").limit(0), [], {}, k, queries.schema["query_id"]), k), report
    hits = search.top_k(scan(asked), k)
    rows = hits.collect()  # k for each query at most
    least = {}
    for r in rows:
        least.setdefault(r["query_id"], []).append(r["score"])
    floor = np.array([min(least[q]) if len(least.get(q, [])) >= k else -2.0 for q, _ in given])
    matter = ~asked & (bounds >= floor[:, None] - 3 * 10.0**-search.DIGITS)
    more = matter if exact else matter & (floor[:, None] < -1)
    report.certain = {q: bool((more[i] == matter[i]).all()) for i, (q, _) in enumerate(given)}
    found = stored.sparkSession.createDataFrame(rows, hits.schema)
    if more.any():
        both = found.select("query_id", "id", "score").unionByName(scan(more))
        return search.top_k(both, k), report
    return found, report
