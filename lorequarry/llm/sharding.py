"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import gapless, materialize


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of a key: that with the largest weight / -ln(u), u being a hash of key and shard in (0, 1).

    The choice depends on the key and the weights alone. A further shard takes over just the keys for which its
    own score is the largest, and a weight that grows draws keys to its shard only. A null key is a key like others.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a positive weight")

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        return F.lit(float(weight)) / -F.log((bits.cast("double") + 0.5) / float(1 << 53))

    scored = [F.struct(score(i, w).alias("score"), F.lit(-i).alias("shard")) for i, w in enumerate(weights)]
    return -(F.greatest(*scored) if len(scored) > 1 else scored[0])["shard"]


def shard(docs: DataFrame, weights: Sequence[float], grown: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each row's shard, its gapless slot there, and its shard once the weights are `grown`.

    Returns key, size (UTF-8 bytes of the text plus 1), text_crc32, law, shard, slot, grown_shard.
    Null text: as an empty one. Null keys all go to one shard, their slots are dealt by size and checksum. Rows that
    are equal throughout get slots of their own. An empty table gives an empty table. Other columns are ignored.
    """
    data = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    narrow = docs.select(
        F.col(key),
        (F.octet_length(data).cast("long") + 1).alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).cast("int").alias("shard"),
        rendezvous(F.col(key), grown).cast("int").alias("grown_shard"),
    )
    placed = gapless(materialize(narrow, "shards"), "shard", [key, "size", "text_crc32"], "slot")
    return placed.select(key, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
