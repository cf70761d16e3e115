import random
from collections import Counter

import pytest

from lorequarry.llm import mixing


@pytest.mark.parametrize("seed", range(8))
def test_phases_deviate_by_less_than_a_block(seed):
    rng = random.Random(seed)
    blocks = {f"s{i}": rng.choice([0, 1, 2, 17, 300, 2000]) for i in range(rng.randrange(1, 30))}
    weights = {s: rng.random() * rng.choice([1, 20]) + 0.01 for s in blocks}
    plan = mixing.phases(blocks, weights, 128)
    slots = {}
    for p in plan:
        for block in range(p["first"], p["end"]):
            slot = p["phase"] + p["slots"][block - p["first"]]
            assert slot not in slots
            slots[slot] = (p["source"], block, p["phase"], p["share"] / p["period"])
    assert sorted(slots) == list(range(sum(blocks.values())))
    placed, begun, seen = Counter(), {}, Counter()
    for t in sorted(slots):
        source, block, phase, _ = slots[t]
        assert block == placed[source]
        placed[source] += 1
        if phase not in begun:
            begun[phase], seen = t, Counter()
        seen[source] += 1
        for p in plan:
            if p["phase"] == phase:
                assert abs(seen[p["source"]] - (t - phase + 1) * p["share"] / p["period"]) < 1
    assert placed == Counter({s: n for s, n in blocks.items() if n})


@pytest.mark.parametrize("blocks, weights", [({f"s{i}": 40_000 if i == 0 else 3 + 700 * (i < 20) for i in range(600)}, {f"s{i}": (i + 1) ** -1.2 for i in range(600)}), ({f"s{i}": 100_000 if i == 0 else 9_000 for i in range(20)}, {f"s{i}": 3.0 if i == 0 else 0.97 for i in range(20)}), ({f"s{i}": 5000 // (i + 1) + 1 for i in range(300)}, {f"s{i}": 1 / (i + 1) for i in range(300)})])
def test_the_given_weights_are_met_at_every_slot_by_skewed_weights_and_many_sources(blocks, weights):
    plan, at = mixing.phases(blocks, weights), {}
    for p in plan:
        at.setdefault(p["phase"], {}).setdefault(p["source"], []).extend(p["slots"])
    assert sum(len(x) for of in at.values() for x in of.values()) == sum(blocks.values())
    left = dict(blocks)
    for begin in sorted(at):
        total = sum(weights[s] for s, n in left.items() if n)
        length = sum(map(len, at[begin].values()))
        for s in [s for s, n in left.items() if n]:
            share, slots = weights[s] / total, at[begin].get(s, [])
            # just before and just after each of its blocks, and at the end of the phase
            assert all(abs(i - t * share) < 1 + 1e-6 and abs(i + 1 - (t + 1) * share) < 1 + 1e-6 for i, t in enumerate(slots))
            assert abs(len(slots) - length * share) < 1 + 1e-6
            left[s] -= len(slots)
    assert not any(left.values())


def test_many_sources_get_their_weights(spark):
    df = spark.range(12_000).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', if(id % 2 = 0, 0, id % 1200)) as source")
    n = {r["source"]: r["count"] for r in df.groupBy("source").count().collect()}
    assert len(n) > 512
    weights = {s: 100.0 if s == "s0" else 1.0 for s in n}
    out = mixing.mix(df, weights, block=1).where("mix_phase = 0").select("mix_source", "mix_weight", "mix_slot").collect()
    assert abs(sum(r.mix_source == "s0" for r in out) - len(out) * 100 / (99 + len(n))) < 1
    assert all(abs(r.mix_weight - weights[r.mix_source] / (99 + len(n))) < 1e-12 for r in out)


def test_every_row_once_in_a_gapless_order(spark):
    rng = random.Random(1)
    rows = [(i, f"t{i}", rng.choice(["hot"] * 5 + ["a", "b", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = mixing.mix(df, {"hot": 1.0, "a": 2.0, "b": 1.0, "null": 0.5}).collect()
    assert sorted(r.mix_position for r in out) == list(range(3000)) and {r.doc_id for r in out} == set(range(3000))
    first = [r.mix_source for r in sorted(out, key=lambda r: r.mix_position)][:800]
    n = Counter(first)
    assert abs(n["a"] / 800 - 2 / 4.5) < 0.03 and abs(n["hot"] / 800 - 1 / 4.5) < 0.03
    again = mixing.mix(df.repartition(5), {"hot": 1.0, "a": 2.0, "b": 1.0, "null": 0.5}).collect()
    assert {(r.doc_id, r.mix_position) for r in again} == {(r.doc_id, r.mix_position) for r in out}


def test_files_follow_the_order(spark, tmp_path):
    df = spark.range(500).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', id % 3) as source")
    mixing.in_mixed_order(df).write.parquet(str(tmp_path / "out"))
    order = {r.doc_id: r.mix_position for r in mixing.mix(df).collect()}
    import glob

    import pyarrow.parquet as pq

    read = [order[i] for f in sorted(glob.glob(str(tmp_path / "out/*.parquet"))) for i in pq.read_table(f)["doc_id"].to_pylist()]
    assert read == list(range(500))


def test_odd_rows(odd, odd_rows):
    out = mixing.mix(odd)
    assert out.columns[: len(odd.columns)] == odd.columns
    rows = out.collect()
    assert sorted(r.mix_position for r in rows) == list(range(len(odd_rows)))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in odd_rows)


def test_blocks_grow_so_that_the_plan_stays_small(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCKS", 50)
    df = spark.range(4001).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', id % 3) as source")
    rows = mixing.mix(df, {"s0": 3.0, "s1": 2.0, "s2": 1.0}).collect()
    assert sorted(r.mix_position for r in rows) == list(range(4001))
    assert max(r.mix_slot for r in rows) < 55
    at = [r.mix_source for r in sorted(rows, key=lambda r: r.mix_position) if r.mix_phase == 0]
    n = Counter(at)
    assert all(abs(n[s] - len(at) * w / 6) <= 2 * 81 for s, w in (("s0", 3), ("s1", 2), ("s2", 1)))


def test_clashing_columns_come_back(spark):
    names = ["__row", "__bucket", "__text", "__source", "__rank", "__n", "__slots", "n"]
    df = spark.range(60).selectExpr("id as doc_id", "cast(id as string) as text", "concat('s', id % 3) as source", *[f"concat('{n}', id) as {n}" for n in names], "id * 2 as mix_position", "id as mix_slot")
    for out in (mixing.mix(df), mixing.in_mixed_order(df)):
        rows = out.collect()
        assert len(rows) == 60 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert out.columns == df.columns and all((r.mix_position, r.mix_slot) == (2 * r.doc_id, r.doc_id) for r in rows)


def test_empty_table(none):
    assert mixing.mix(none).count() == 0
