"""Mixing sources to target weights by a Pfair schedule. DataFrame functions only; the schedule itself is a small plan."""

from __future__ import annotations

import math
from array import array
from collections.abc import Callable, Mapping
from fractions import Fraction
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import gapless, private

#: A row of the plan has the slots of so many blocks of a source at most.
UNITS = 512
#: Rows of a block, at least; and blocks of a plan, about, at most: from 8 x 4,000,000 rows on blocks are longer.
BLOCK, BLOCKS = 8, 4_000_000


def phase(left: Mapping[str, int], weights: Mapping[str, float]) -> dict[str, array]:
    """The slots of each source from now until the slot that would need a block of a source that has none left.

    With w the source's share of all weights, exactly, block i is released at floor(i / w) and due at
    ceil((i + 1) / w). Of the blocks that are released the one due first gets the slot, ties by name. The weights fill
    all slots, so every block meets its time, and after any number t of slots each source is less than one block off t w.
    """
    exact = {s: Fraction(weights[s]) for s in left}
    unit = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: x.numerator * (unit // x.denominator) for s, x in exact.items()}
    total, slots, t = sum(parts.values()), {s: array("q") for s in left}, 0
    later: list[tuple[int, str]] = []
    ready = [(-(-total // parts[s]), s) for s in left]
    heapify(ready)
    while True:
        while later and later[0][0] <= t:
            _, s = heappop(later)
            heappush(ready, (-(-(len(slots[s]) + 1) * total // parts[s]), s))
        due, s = heappop(ready)
        if t >= due:
            raise AssertionError("a block is late")
        if len(slots[s]) == left[s]:
            return slots
        slots[s].append(t)
        heappush(later, (len(slots[s]) * total // parts[s], s))
        t += 1


def phases(blocks: Mapping[str, int], weights: Mapping[str, float], units: int = UNITS) -> list[dict]:
    """The plan: for each phase and source the blocks [first, end) it places, and where, `units` blocks in a row at most.

    A phase lasts until the slot that would need a block of a source that has none left. The next one goes on with the
    other sources, their weights in the same proportions, so every block is placed and no slot stays empty.
    """
    left, used, begin, plan = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while left := {s: n for s, n in left.items() if n}:
        slots, total = phase(left, weights), math.fsum(weights[s] for s in left)
        for s in sorted(left):
            first, end = used[s], used[s] + len(slots[s])
            for at in range(first - first % units, end, units):
                f, e = max(at, first), min(at + units, end)
                if f < e:
                    plan.append({"source": s, "phase": begin, "first": f, "end": e, "share": weights[s], "period": total, "slots": slots[s][f - first : e - first]})
            used[s] = end
            left[s] -= len(slots[s])
        begin += sum(map(len, slots.values()))
    return plan


def plan_table(spark: SparkSession, plan: list[dict], counts: Mapping[str, int], block: int, units: int, own: Callable[[str], str]) -> DataFrame:
    """The plan as a table; a row's blocks all have the same number of whole `units`, its part. starts: the position
    of each block's first row, that is, its slot times the block's size, less what partly filled blocks before lack."""
    import numpy as np
    import pyarrow as pa

    kinds = {"source": pa.string(), "phase": pa.int64(), "first": pa.int64(), "share": pa.float64(), "period": pa.float64()}
    columns = {own(c): pa.array([p[c] for p in plan], t) for c, t in kinds.items()}
    columns[own("part")] = pa.array([p["first"] // units for p in plan], pa.int64())
    columns[own("end")] = pa.array([p["end"] for p in plan], pa.int64())
    bounds = np.cumsum([0, *(len(p["slots"]) for p in plan)])
    slots = np.concatenate([np.frombuffer(p["slots"], np.int64) + p["phase"] for p in plan] or [np.empty(0, np.int64)])
    # a source's last block may lack rows
    last = {p["source"]: p["slots"][-1] + p["phase"] for p in plan if p["end"] == -(-counts[p["source"]] // block)}
    gaps = sorted((slot, -counts[s] % block) for s, slot in last.items())
    lacking = np.cumsum([0, *(n for _, n in gaps)])
    starts = slots * block - lacking[np.searchsorted(np.array([slot for slot, _ in gaps], np.int64), slots, "left")]
    for name, values in (("slots", slots), ("starts", starts)):
        columns[own(name)] = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))
    return spark.createDataFrame(pa.table(columns))


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = 0.5, block: int | None = None, units: int = UNITS) -> DataFrame:
    """docs with mix_source, mix_block, mix_slot, mix_phase, mix_weight (the source's target share in that phase) and mix_position.

    Each source's rows are dealt into blocks of `block` rows in a fixed order that looks random, and the blocks get
    slots by phases(). mix_position counts 0, 1, ... over all rows in the mixed order. No row is dropped or repeated.
    weights maps sources to positive weights; a source that isn't in it has its number of rows to the power of
    `temperature`, and so have all without weights. Without `block` a block has BLOCK rows, or as many more as keep
    the plan to BLOCKS blocks, about.

    A null source is a source of its own, mix_source "null"; one named so counts as the same. Null ids and texts are
    allowed; rows equal in doc_id and text are interchangeable. An empty table gives an empty table. Other columns
    stay, but for the added names, which are replaced. Only the numbers of rows by source reach the driver, which
    makes the plan: 16 bytes for each block, and a row of the plan for each `units` blocks of a source, or part of
    them; so what is broadcast is bounded whatever the size of docs. This is for up to some hundred thousand
    sources. Rows are counted off within hash buckets of a source, never in one task.
    """
    spark = docs.sparkSession
    names = ["mix_source", "mix_block", "mix_slot", "mix_phase", "mix_weight", "mix_position"]
    own = private([*docs.columns, *names])
    col = lambda name: F.col(own(name))
    base = docs.drop(*names).withColumn("mix_source", F.coalesce(F.col("source").cast("string"), F.lit("null")))
    counts = {r["mix_source"]: r[own("n")] for r in base.groupBy("mix_source").agg(F.count(F.lit(1)).alias(own("n"))).collect()}
    block = block or max(BLOCK, -(-sum(counts.values()) // BLOCKS))
    weight = {s: float((weights or {}).get(s, n**temperature)) for s, n in counts.items()}
    if min(weight.values(), default=1) <= 0:
        raise ValueError("weights must be positive")
    plan = phases({s: -(-n // block) for s, n in counts.items()}, weight, units)

    ranked = gapless(base.withColumn(own("text"), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))), "mix_source", ["doc_id", own("text")], own("rank"))
    placed = ranked.withColumn("mix_block", F.floor(col("rank") / block)).withColumn(own("turn"), F.floor(F.col("mix_block") / units))
    table = F.broadcast(plan_table(spark, plan, counts, block, units, own))
    here = (F.col("mix_source") == col("source")) & (col("turn") == col("part")) & (F.col("mix_block") >= col("first")) & (F.col("mix_block") < col("end"))
    at = (F.col("mix_block") - col("first")).cast("int")
    return placed.join(table, here).select(
        *[c for c in docs.columns if c not in names],
        "mix_source",
        "mix_block",
        F.get(col("slots"), at).alias("mix_slot"),
        col("phase").alias("mix_phase"),
        (col("share") / col("period")).alias("mix_weight"),
        (F.get(col("starts"), at) + col("rank") % block).alias("mix_position"),
    )


def in_mixed_order(docs: DataFrame, **how) -> DataFrame:
    """The rows and columns of docs, sorted over the whole table by their place in the mix, so that files written from it follow it.

    All columns are as they were, also those whose names mix() would add.
    """
    own = private(docs.columns)
    aside = {c: own(c) for c in docs.columns if c.startswith("mix_")}
    mixed = mix(docs.withColumnsRenamed(aside), **how).orderBy("mix_position")
    return mixed.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])
