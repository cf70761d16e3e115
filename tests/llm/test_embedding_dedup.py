import math
import random

import numpy as np
import pytest

from lorequarry.llm import embedding_dedup as e

SCHEMA = "vec_id long, embedding array<float>, label int, node long, key string"


def brute(rows, threshold=0.98):
    ok = [(i, v, label) for i, v, label in rows if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent = {i: i for i, _, _ in rows if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    unit = [np.asarray(v, np.float32).astype(float) for _, v, _ in ok]
    unit = [u / np.abs(u).max() for u in unit]
    unit = [u / np.linalg.norm(u) for u in unit]
    n = [0] * len(ok)
    for a in range(len(ok)):
        for b in range(a):
            if ok[a][2] == ok[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                n[a] += 1
                n[b] += 1
                p, q = find(ok[a][0]), find(ok[b][0])
                if p != q:
                    parent[max(p, q)] = min(p, q)
    links = {}
    for (i, _, _), x in zip(ok, n):
        links.setdefault(i, []).append(x)
    return links, {i: find(i) for i in parent}


def near(rng, v, amount):
    return [float(x) for x in np.asarray(v) + rng.normal(0, amount, len(v))]


def make(seed, groups=25, size=30, dim=16):
    rng, rows = np.random.default_rng(seed), []
    for g in range(groups):
        centre = rng.normal(0, 1, dim)
        rows += [near(rng, centre, a) for a in rng.choice([0.02, 0.08, 0.15, 0.4, 1.0], size)]
    random.Random(seed).shuffle(rows)
    return [(i, v, int(rng.integers(3))) for i, v in enumerate(rows)]


def test_recall_and_precision_against_brute_force(spark):
    rows = make(1)
    links, components = brute(rows)
    out = e.near_duplicates(spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA), chunk=256).collect()
    assert len(out) == len(rows)
    expected, found = sum(x[0] for x in links.values()), sum(r.n_links for r in out)
    assert 0.98 * expected <= found <= expected and all(r.n_links <= links[r.vec_id][0] for r in out)
    assert sum(r.component_id == components[r.vec_id] for r in out) >= 0.98 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_a_large_group_is_searched_in_chunks(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 1, 16)
    rows = [(i, near(rng, centre, 0.02), 1) for i in range(300)] + [(1000 + i, [float(x) for x in centre], 1) for i in range(200)]
    out = e.near_duplicates(spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA), chunk=64).collect()
    links, components = brute(rows)
    assert sum(r.n_links for r in out) >= 0.98 * sum(x[0] for x in links.values())
    assert all(r.n_links <= links[r.vec_id][0] for r in out) and {r.component_id for r in out} == {0}


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0, 0.0], 1), (8, [1.0, None, 3.0], 1), (9, [float("nan"), 1.0, 1.0], 1), (10, [float("inf"), 1.0, 1.0], 1), (11, [2.0, 4.0, 6.0], 1), (12, [1.0, 2.0], 1), (13, [1e-30, 2e-30, 3e-30], 1), (14, [1e30, 2e30, 3e30], 1), (None, v, 1), (15, [-1.0, -2.0, -3.0], 1), (2, v, 1)]
    out = e.near_duplicates(spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)).collect()
    links, components = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        assert r.n_links == links.get(r.vec_id, [0])[0], r
        assert r.component_id == components.get(r.vec_id)


def test_empty_table(spark):
    assert e.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_audit_measures_recall(spark):
    df = spark.createDataFrame([(*r, 1, "k") for r in make(2)], SCHEMA)
    got = e.audit(df, e.near_duplicates(df)).first()
    assert got.expected > 0 and got.found >= 0.9 * got.expected


@pytest.mark.parametrize("n", [1, 2, 3, 50])
def test_graphs_are_connected_enough_for_the_search(n):
    x = np.random.default_rng(n).normal(0, 1, (n, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(n)
    found = e.range_search(x, x, e.joined_graph(ids, [ids[o] for o in e.build_graph(x)]), 0.999)
    assert found.diagonal().all()


def dense(n=6000, dim=32, seed=9):
    """Vectors of one label around one direction, so that they fill many shards that lie side by side."""
    rng = np.random.default_rng(seed)
    centre = rng.normal(0, 1, dim)
    x = centre + rng.normal(0, 1, (n, dim)) * rng.uniform(0.05, 0.2, (n, 1))
    x = x.astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    return x, unit @ unit.T >= 0.98


def test_links_across_shards_are_found(spark):
    x, hit = dense()
    np.fill_diagonal(hit, False)
    df = spark.createDataFrame([(i, v.tolist(), 1, 1, "k") for i, v in enumerate(x)], SCHEMA).repartition(4)
    out = {r.vec_id: r for r in e.near_duplicates(df).collect()}
    found = np.array([out[i].n_links for i in range(len(x))])
    assert (found <= hit.sum(1)).all() and found.sum() >= 0.95 * hit.sum()
    # a link counts at both ends or at none
    assert found.sum() % 2 == 0
    alone = hit.any(1) & (found == 0)
    assert alone.sum() <= 0.005 * len(x)


def test_large_cells_are_divided(spark):
    """Few first cells, and small shards: most cells are divided, and links across all borders are found."""
    x, hit = dense(800, 16, 3)
    np.fill_diagonal(hit, False)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows], SCHEMA)
    first = e.assign(e.usable(df), {16: e.centroids_of(e.unit(x), 3)}, 0.98)
    dealt = e.divided(first, 0.98, shard=40, part=100)
    got = dealt.where("rank = 0").groupBy("shard").count().collect()
    assert len(got) >= 12 and sum(r["count"] for r in got) == 800
    home = {r.id: r.shard for r in dealt.where("rank = 0").collect()}
    within = {(r.id, r.shard) for r in dealt.where("within").collect()}
    pairs = [(a, b) for a, b in zip(*np.nonzero(hit)) if a < b]
    met = sum((a, home[b]) in within and (b, home[a]) in within for a, b in pairs)
    assert len(pairs) > 100 and met >= 0.97 * len(pairs)
    out = e.near_duplicates(df, shard=40, chunk=32).collect()
    assert sum(r.n_links for r in out) >= 0.95 * hit.sum()
