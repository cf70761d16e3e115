"""Near-duplicate embeddings by a robust-pruned flat graph.

Steps
1. Equal vectors become one node. Centroids are fitted on a bounded sample; cells that are large are divided again by
   centroids of their own, fitted on a sample of the cell, so that the number of shards grows with the table.
2. A node is at home in the shard of its nearest centroid. It is a guest of each further shard whose border is so near
   that a vector it links with may lie behind it.
3. Nodes are built into robust-pruned graphs on overlapping shards (the nearest and the next), and the adjacency lists
   that a node has from all its shards are united: one flat graph over all nodes.
4. The search runs over that graph for two shards at a time: those at home in one that are guests of the other, and
   the other way round; and for each shard with itself. It starts from medoids and goes on best first, with a beam;
   the range then grows from everything found within it, along the united lists, whichever shard an edge came from.
   What either end of a pair finds counts for both, so links are symmetric, and a pair meets in one place only.
5. Every link's cosine is computed in double precision before it is counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, materialize

#: Vectors that the first centroids, and those of a large cell, are fitted on, about, at most.
SAMPLE, CELL_SAMPLE = 8192, 4096
#: Nodes of one label that are at home in a shard, about; a cell of more than twice as many is divided.
SHARD = 400
#: Nodes of one side that are searched together, and nodes that a graph is built on, at most, about.
CHUNK, BUILD = 512, 1024
OVERLAP = 2
DEGREE, ALPHA, BEAM, SLACK = 24, 1.2, 16, 0.03
#: A shard's border is near up to so many standard deviations of a random chord of the threshold's length.
REACH = 3.0
EDGE_SCHEMA = "id long, neighbours array<long>"
#: Shards of a cell.
SUBS = 1024


def unit(rows):
    import numpy as np

    x = np.asarray(rows, np.float64)
    x = x / np.abs(x).max(1, keepdims=True)  # first, so that very large and very small ones keep a norm
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, embedding) of the rows that may link: a label, an id, and finite components that aren't all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(finite & some)


def centroids_of(x, k: int, rounds: int = 6):
    """k unit centroids of unit vectors, by spherical k-means from evenly spaced rows."""
    import numpy as np

    c = x[:: max(1, len(x) // k)][:k].copy()
    for _ in range(rounds):
        near = np.argmax(x @ c.T, 1)
        for j in np.unique(near):
            m = x[near == j].sum(0)
            c[j] = m / max(1e-12, np.linalg.norm(m))
    return c


def fit_centroids(nodes: DataFrame, shard: int = SHARD, sample: int = SAMPLE) -> dict:
    """The first centroids by vector length, on at most `sample` vectors: those with the least hash. About one for each
    `shard` nodes of the largest label, at most one for 8 of the sample; cells that this leaves large are divided later."""
    largest = nodes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    got = nodes.orderBy(F.xxhash64("vec_id", F.lit("fit")), "vec_id").limit(sample).select("embedding").collect()
    by: dict = {}
    for r in got:
        by.setdefault(len(r[0]), []).append(r[0])
    return {length: centroids_of(unit(own), max(1, min(len(own) // 8, -(-largest // shard)))) for length, own in by.items()}


def places(x, c, reach: float):
    """For each row of x the nearest centroid, the next one (or -1), and a matrix of those whose border is within reach.

    A row's distance from the border between its nearest centroid a and another one, b, is (x a - x b) / |a - b|.
    """
    import numpy as np

    sims = x @ c.T
    order = np.argsort(-sims, 1, kind="stable")
    home = order[:, 0]
    after = order[:, 1] if len(c) > 1 else np.full(len(x), -1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))[home]
    near = sims[np.arange(len(x)), home][:, None] - sims <= reach * apart
    near[np.arange(len(x)), home] = True
    return home, after, near


def reach_of(length: int, threshold: float) -> float:
    """How far behind a border a vector is looked for. Linked vectors are a chord of sqrt(2 - 2 threshold) apart at
    most; in a random direction it has a standard deviation of that over the root of the dimension."""
    chord = max(0.0, 2 - 2 * threshold) ** 0.5
    return chord * min(1.0, REACH / length**0.5)


def assign(nodes: DataFrame, centroids: dict, threshold: float) -> DataFrame:
    """(id, label, length, cell, rank, vector): each node in all cells within reach. rank 0: at home; 1: the next one; 2: others."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        types = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.float64())]
        for batch in batches:
            ids, labels, vectors = (c.to_pylist() for c in batch.columns)
            out = []
            for length in sorted({len(v) for v in vectors}):
                at = [i for i, v in enumerate(vectors) if len(v) == length]
                x = unit([vectors[i] for i in at])
                c = shared.value.get(length)
                if c is None:  # a length that the sample lacks
                    out += [(ids[i], str(labels[i]), length, 0, 0, True, x[row].tolist()) for row, i in enumerate(at)]
                    continue
                home, after, near = places(x, c, reach_of(length, threshold))
                for row, i in enumerate(at):
                    vector = x[row].tolist()
                    cells = {int(j): True for j in np.flatnonzero(near[row])}
                    if after[row] >= 0:
                        cells.setdefault(int(after[row]), False)
                    out += [(ids[i], str(labels[i]), length, j, 0 if j == home[row] else 1 if j == after[row] else 2, within, vector) for j, within in cells.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["id", "label", "length", "cell", "rank", "within", "vector"])

    return nodes.select("vec_id", "label", "embedding").mapInArrow(run, "id long, label string, length int, cell long, rank int, within boolean, vector array<double>")


def divided(dealt: DataFrame, threshold: float, shard: int = SHARD, part: int = 16_384) -> DataFrame:
    """dealt with `shard` for `cell`: cells in which more than twice `shard` nodes of a label are at home are divided by
    centroids of their own. A cell's rows are dealt into parts of about `part` rows, so no task gathers a cell."""
    place = ["label", "length", "cell"]
    sizes = dealt.groupBy(*place).agg(F.sum((F.col("rank") == 0).cast("long")).alias("own"), F.count(F.lit(1)).alias("all"))
    large = materialize(sizes.where(F.col("own") > 2 * shard), "vector-large-cells")
    whole = F.col("cell") * SUBS
    if large.isEmpty():
        return dealt.withColumn("shard", whole).drop("cell")
    kept = dealt.join(large.select(*place), place, "left_anti").withColumn("shard", whole).drop("cell")

    sampled = dealt.where("rank = 0").join(large, place).where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1 << 30)) * F.col("own") < F.lit(CELL_SAMPLE << 30))

    def fit(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("id")
        x = np.stack(group["vector"].to_list())
        c = centroids_of(x, int(max(1, min(len(x) // 8, SUBS, -(-int(group["own"].iloc[0]) // shard)))))
        return pd.DataFrame([(*(group[p].iloc[0] for p in place), c.ravel().tolist())], columns=[*place, "centres"])

    centres = materialize(sampled.select(*place, "id", "own", "vector").groupBy(*place).applyInPandas(fit, "label string, length int, cell long, centres array<double>"), "vector-sub-centroids")

    parts = F.ceil(F.col("all") / part).cast("int")
    rows = dealt.join(large, place).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), parts).cast("int")).drop("own", "all")
    every = centres.join(large, place).withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select(*place, "part", "centres")

    def deal(rows, every):
        import numpy as np
        import pandas as pd

        if not len(rows) or not len(every):
            return pd.DataFrame({"id": [], "label": [], "length": [], "shard": [], "rank": [], "within": [], "vector": []})
        x = np.stack(rows["vector"].to_list())
        length, cell = int(rows["length"].iloc[0]), int(rows["cell"].iloc[0])
        c = np.asarray(every["centres"].iloc[0]).reshape(-1, length)
        home, after, near = places(x, c, reach_of(length, threshold))
        out = []
        for i, (one, label, rank, within, vector) in enumerate(zip(rows["id"], rows["label"], rows["rank"], rows["within"], rows["vector"])):
            for j in np.flatnonzero(near[i]) if within else [home[i]]:
                out.append((one, label, length, cell * SUBS + int(j), rank if j == home[i] else 1 if rank == 0 and j == after[i] else 2, within, vector))
            if rank == 0 and after[i] >= 0 and not near[i][after[i]]:
                out.append((one, label, length, cell * SUBS + int(after[i]), 1, False, vector))
        return pd.DataFrame(out, columns=["id", "label", "length", "shard", "rank", "within", "vector"])

    keys = [*place, "part"]
    made = rows.groupBy(*keys).cogroup(every.groupBy(*keys)).applyInPandas(deal, "id long, label string, length int, shard long, rank int, within boolean, vector array<double>")
    return kept.select(*made.columns).union(made)


def robust_prune(near, sims, degree: int, alpha: float) -> list[int]:
    """Of candidates (nearest first, their similarities with each other and with the vector at sims[0]) those kept:
    one goes if a kept one is, by the factor alpha, nearer to it than the vector is."""
    own, between = sims
    kept: list[int] = []
    alive = [True] * len(near)
    for i in range(len(near)):
        if not alive[i]:
            continue
        kept.append(i)
        if len(kept) == degree:
            break
        for j in range(i + 1, len(near)):
            if alive[j] and alpha * (1 - between[i][j]) <= 1 - own[j]:
                alive[j] = False
    return kept


def build_graph(x, degree: int = DEGREE, alpha: float = ALPHA, pool: int = 48):
    """Adjacency lists over the rows of x: candidates are the nearest rows and some spread over all, both pruned; edges go both ways."""
    import numpy as np

    n = len(x)
    if n < 2:
        return [[] for _ in range(n)]
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    m = min(n - 1, pool)
    near = np.argpartition(-sims, m - 1, axis=1)[:, :m]
    spread = (np.arange(n)[:, None] + np.linspace(1, n - 1, min(n - 1, 8)).astype(int)[None, :]) % n
    out: list[set] = [set() for _ in range(n)]
    for i in range(n):
        c = np.unique(np.concatenate([near[i], spread[i]]))
        c = c[c != i]
        c = c[np.argsort(-sims[i, c], kind="stable")]
        for j in robust_prune(c, (sims[i, c].tolist(), sims[np.ix_(c, c)].tolist()), degree, alpha):
            out[i].add(int(c[j]))
            out[int(c[j])].add(i)
    return [sorted(o) for o in out]


def medoid(x) -> int:
    import numpy as np

    return int(np.argmax(x @ x.mean(0)))


def joined_graph(ids, lists):
    """A symmetric 0/1 matrix of the united lists among the sorted ids; edges to other nodes are left out."""
    import numpy as np

    out = np.zeros((len(ids), len(ids)), np.float32)
    owner = np.repeat(np.arange(len(ids)), [len(o) for o in lists])
    other = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
    at = np.minimum(np.searchsorted(ids, other), len(ids) - 1)
    here = ids[at] == other
    out[owner[here], at[here]] = out[at[here], owner[here]] = 1
    return out


def parts_of(graph):
    """For each row of a symmetric matrix the least row that can be reached from it."""
    import numpy as np

    n = len(graph)
    least = np.arange(n)
    linked = graph > 0
    while True:
        new = np.minimum(least, np.where(linked, least[None, :], n).min(1, initial=n))
        new = new[new]
        if (new == least).all():
            return least
        least = new


def range_search(queries, x, graph, threshold: float, beam: int = BEAM, slack: float = SLACK):
    """A matrix of which rows of x (the graph's nodes) a search finds at least `threshold` alike to each query.

    In each connected part of the graph the search starts at the medoid. It expands, best first, the `beam` best nodes
    seen, and everything seen that is at least threshold - slack alike, along all edges, until none is left. Only the
    cosines of nodes that an edge leads to are computed. All queries take their steps together.
    """
    import numpy as np

    found = np.zeros((len(queries), len(x)), bool)
    least = parts_of(graph)
    for part in np.unique(least):
        own = np.flatnonzero(least == part)
        base, edges = x[own], graph[np.ix_(own, own)]
        n, most = len(own), min(beam, len(own))
        sims = np.full((len(queries), n), -3.0)
        seen, expanded = np.zeros(sims.shape, bool), np.zeros(sims.shape, bool)
        start = medoid(base)
        sims[:, start], seen[:, start] = queries @ base[start], True
        active = np.arange(len(queries))
        while len(active):
            s, open_ = sims[active], seen[active] & ~expanded[active]
            kth = np.partition(s, n - most, axis=1)[:, n - most][:, None]
            todo = open_ & ((s >= kth) | (s >= threshold - slack))
            active, todo = active[todo.any(1)], todo[todo.any(1)]
            if not len(active):
                break
            expanded[active] |= todo
            new = (todo.astype(np.float32) @ edges > 0) & ~seen[active]
            seen[active] |= new
            rows, cols = np.nonzero(new)
            for at in range(0, len(rows), 100_000):
                r, c = active[rows[at : at + 100_000]], cols[at : at + 100_000]
                sims[r, c] = np.einsum("ij,ij->i", queries[r], base[c])
        found[:, own] = sims >= threshold
    return found


def linked_within(ids, x, lists, side, threshold: float):
    """A symmetric matrix of the links that the search finds among nodes; if side has both values, only links across."""
    import numpy as np

    graph = joined_graph(ids, lists)
    hit = np.zeros(graph.shape, bool)
    one, two = np.flatnonzero(~side), np.flatnonzero(side)
    if len(one) and len(two):
        hit[np.ix_(one, two)] = range_search(x[one], x[two], graph[np.ix_(two, two)], threshold)
        hit[np.ix_(two, one)] = range_search(x[two], x[one], graph[np.ix_(one, one)], threshold)
    else:
        hit = range_search(x, x, graph, threshold)
    hit |= hit.T
    np.fill_diagonal(hit, False)
    return hit


def meetings(dealt: DataFrame, homes: DataFrame, chunk: int) -> DataFrame:
    """(id, label, length, lo, hi, a, b, side): the groups in which a node is searched with others.

    Shards lo <= hi meet if nodes at home in either are guests of the other; only those come. Each side is dealt into
    chunks by a hash, and every chunk a of lo meets every chunk b of hi. A pair of nodes meets in one group only.
    """
    home = homes.select("id", F.col("shard").alias("home"))
    rows = dealt.where("within").select("id", "label", "length", "shard").join(home, "id")
    rows = rows.select("id", "label", "length", F.least("home", "shard").alias("lo"), F.greatest("home", "shard").alias("hi"), (F.col("home") > F.col("shard")).alias("side"))
    rows = materialize(rows, "vector-meetings")
    place = ["label", "length", "lo", "hi"]
    sizes = rows.groupBy(*place).agg(F.sum((~F.col("side")).cast("long")).alias("n0"), F.sum(F.col("side").cast("long")).alias("n1"))
    sizes = sizes.where("lo = hi or (n0 > 0 and n1 > 0)").select(*place, F.ceil(F.col("n0") / chunk).cast("int").alias("c0"), F.ceil(F.when(F.col("lo") == F.col("hi"), F.col("n0")).otherwise(F.col("n1")) / chunk).cast("int").alias("c1"))
    known = rows.join(sizes, place)
    mine, theirs = F.when(F.col("side"), F.col("c1")).otherwise(F.col("c0")), F.when(F.col("side"), F.col("c0")).otherwise(F.col("c1"))
    known = known.select("id", *place, "side", F.pmod(F.xxhash64("id", F.lit("chunk")), mine).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), theirs - 1)).alias("j"))
    same, swapped = F.col("lo") == F.col("hi"), F.col("i") > F.col("j")
    return known.select(
        "id", *place,
        F.when(F.when(same, swapped).otherwise(F.col("side")), F.col("j")).otherwise(F.col("i")).alias("a"),
        F.when(F.when(same, swapped).otherwise(F.col("side")), F.col("i")).otherwise(F.col("j")).alias("b"),
        F.when(same, swapped).otherwise(F.col("side")).alias("side"),
    )


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, shard: int = SHARD, chunk: int = CHUNK) -> DataFrame:
    """vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable) and kept, per row of vectors.

    Vectors of equal, non-null labels link where their cosine in double precision is at least the threshold. The steps
    are those of this module. A link is counted only after its cosine was computed, and at both ends or at none. The
    search is approximate: a link may be missed where both vectors lie farther behind the border between their shards
    than reach_of() says, or where no path of the graph leads from a medoid to them; audit() measures the recall.

    Null, empty and zero vectors, those with null or non-finite components, and rows without label or id have no
    links. Vectors of different lengths don't link. Rows that share a vec_id are one node of the components; each row
    counts the links of its own vector. An empty table gives an empty table. Other columns are ignored.

    What is gathered in one place is two chunks at most, or the nodes of one graph. The links of a large group of near
    copies are counted, never listed.
    """
    rows = usable(vectors)
    marked = rows.withColumn("key", F.concat_ws(":", F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(1), "embedding"))))
    stored = materialize(marked, "vectors")
    classes = stored.groupBy("label", "key").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"), F.min("embedding").alias("embedding"))
    # a vec_id that several rows share may be the least of several classes, so a class is known by a hash of its own
    nodes = materialize(classes.select(F.xxhash64("label", "key").alias("vec_id"), "label", "key", "node", "copies", "embedding"), "vector-nodes")

    first = materialize(assign(nodes, fit_centroids(nodes, shard), threshold), "vector-cells")
    dealt = materialize(divided(first, threshold, shard), "vector-shards")
    place = ["label", "length", "shard"]
    built = dealt.where(F.col("rank") < OVERLAP)
    sizes = built.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / BUILD).cast("int").alias("chunks"))
    built = built.join(sizes, place).withColumn("chunk", F.pmod(F.xxhash64("id", F.lit("build")), F.col("chunks")).cast("int"))

    def build(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("id")
        ids = group["id"].to_numpy()
        lists = build_graph(np.stack(group["vector"].to_list()))
        return pd.DataFrame({"id": ids, "neighbours": [ids[o].tolist() for o in lists]})

    edges = built.select(*place, "chunk", "id", "vector").groupBy(*place, "chunk").applyInPandas(build, EDGE_SCHEMA)
    united = edges.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours"))
    homes = dealt.where("rank = 0")
    weights = nodes.select(F.col("vec_id").alias("id"), "copies")
    graph = materialize(homes.select("id", "vector").join(united, "id").join(weights, "id"), "vector-graph")

    def search(group):
        import numpy as np
        import pandas as pd

        group = group.sort_values("id")
        ids, copies = group["id"].to_numpy(), group["copies"].to_numpy()
        side = group["side"].to_numpy(bool)
        hit = linked_within(ids, np.stack(group["vector"].to_list()), group["neighbours"].to_list(), side, threshold)
        at = np.flatnonzero(hit.any(1))
        return pd.DataFrame({"id": ids[at], "links": hit[at] @ copies, "root": ids[parts_of(hit)[at]]}).astype("int64")

    together = ["label", "length", "lo", "hi", "a", "b"]
    met = meetings(dealt, homes, chunk).join(graph, "id")
    found = materialize(met.groupBy(*together).applyInPandas(search, "id long, links long, root long"), "vector-links")
    counted = found.groupBy("id").agg(F.sum("links").alias("links"))
    named = nodes.select(F.col("vec_id").alias("id"), "label", "key", "node", "copies")
    owned = stored.select("vec_id", "label", "key").distinct().join(named, ["label", "key"])
    # rows of one vec_id in several classes tie these together, as do links between classes
    several = owned.groupBy("vec_id").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    shared = owned.join(several, "vec_id", "left_semi").select(F.col("vec_id").alias("src"), F.col("node").alias("dst"))
    to_node = named.select("id", "node")
    across = found.select("id", "root").join(to_node, "id").select("root", F.col("node").alias("src")).join(to_node.withColumnRenamed("id", "root").withColumnRenamed("node", "dst"), "root").select("src", "dst")
    parts = connected_components(across.union(shared), "vector-components")

    per = owned.join(counted, "id", "left").join(parts, "node", "left")
    per = per.select(F.col("vec_id").alias("_id"), F.col("label").alias("_label"), F.col("key").alias("_key"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("_links"), F.coalesce("component", "node").alias("_component"))
    keyed = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("embedding"))
    keyed = keyed.withColumn("key", F.concat_ws(":", F.hex(F.xxhash64("embedding")), F.hex(F.xxhash64(F.lit(1), "embedding"))))
    out = keyed.join(per, (F.col("vec_id") == F.col("_id")) & (F.col("label") == F.col("_label")) & (F.col("key") == F.col("_key")), "left")
    component = F.coalesce("_component", "vec_id")
    return out.select("vec_id", F.coalesce("_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))


def audit(vectors: DataFrame, result: DataFrame, threshold: float = 0.98, every: int = 50) -> DataFrame:
    """(expected, found): links of the vectors whose id `every` divides by brute force against all rows, and in result."""
    rows = usable(vectors)
    ask = rows.where(F.col("vec_id") % every == 0)
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    unit_of = lambda d, p: d.select(F.col("vec_id").alias(f"{p}id"), "label", F.col("embedding").alias(f"{p}v"), F.sqrt(dot("embedding", "embedding")).alias(f"{p}n"))
    pairs = unit_of(ask, "a").join(unit_of(rows, "b"), "label").where((F.col("aid") != F.col("bid")) & (F.size("av") == F.size("bv")))
    expected = pairs.where(dot("av", "bv") / (F.col("an") * F.col("bn")) >= threshold).agg(F.count(F.lit(1)).alias("expected"))
    return expected.crossJoin(result.where(F.col("vec_id") % every == 0).agg(F.sum("n_links").alias("found")))
