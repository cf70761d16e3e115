"""Helpers shared by the operators: shared storage, gapless positions, connected components."""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or what the session was told by setCheckpointDir.

    Only a local session, whose executors are the driver's own threads, may do without: it gets a folder of its own
    in the warehouse. Anywhere else a folder that isn't named is an error, as no other is known to be shared.
    """
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not path:
        if not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/checkpoints/{context.applicationId}"
        context.setCheckpointDir(path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}/{name}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: a cut in the lineage that survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_by_value(spark: SparkSession, value) -> Callable:
    """A function that gives value on an executor, whatever classes of this library it is made of: a broadcast alone
    would look them up by their names there, where the library need not be installed."""
    shared = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: cloudpickle.loads(shared.value)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def private(taken: Iterable[str]) -> Callable[[str], str]:
    """Names for columns of our own that clash with no name of taken, whatever the case of its letters."""
    lower = [t.lower() for t in taken]
    prefix = next(p for p in itertools.chain(["__"], (f"__{i}_" for i in itertools.count())) if not any(t.startswith(p) for t in lower))
    return lambda name: prefix + name


def gapless(df: DataFrame, group: str, order: list[str], out: str) -> DataFrame:
    """Adds out: positions 0, 1, ... within each value of group (never null), without bringing a group into one task.

    Rows are dealt into buckets by a hash of the order columns, about the square root of the largest group's size of
    them; the table of bucket sizes gives each bucket its first position, and rows are counted within their bucket.
    So nothing that one task sorts is larger than that root, about. The sizes are joined by the keys that rows are
    dealt by already, and broadcast only where Spark finds them small.
    df is read three times, so pass a stored table. Only rows that agree in all order columns are interchangeable.
    Columns of any name are left alone, but for out.
    """
    bucket, row, g, b, n, start = map(private([*df.columns, out]), ("bucket", "row", "group", "b", "n", "start"))
    largest = df.groupBy(group).agg(F.count(F.lit(1)).alias(n)).agg(F.max(n)).first()[0] or 0
    buckets = math.isqrt(largest) + 1
    dealt = df.withColumn(bucket, F.pmod(F.xxhash64(*order, F.lit("bucket")), F.lit(buckets)))
    sizes = dealt.groupBy(F.col(group).alias(g), F.col(bucket).alias(b)).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(g).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(g, b, F.coalesce(F.sum(n).over(before), F.lit(0)).alias(start))
    within = Window.partitionBy(group, bucket).orderBy(*order)
    placed = dealt.withColumn(row, F.row_number().over(within) - 1)
    joined = placed.join(starts, (F.col(group) == F.col(g)) & (F.col(bucket) == F.col(b)))
    return joined.withColumn(out, (F.col(start) + F.col(row)).cast("long")).drop(bucket, row, g, b, start)


def connected_components(edges: DataFrame, name: str = "components", rounds: int = 200) -> DataFrame:
    """(node, component) for every node of edges (src, dst: long); component is the smallest node reachable.

    Alternating large-star and small-star steps. Every step is a grouped minimum, which is combined before the
    shuffle, and an equi join, which Spark may split by skew; no neighbourhood is gathered anywhere.
    Each round is written to the shared folder, so a lost executor costs one round at most. Rounds go on until
    nothing changes, which takes about the logarithm of the longest path; should that not be so after `rounds` of
    them, that is an error, never an unfinished labelling.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))

    def large_star(pairs: DataFrame) -> DataFrame:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        return both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))

    def small_star(pairs: DataFrame) -> DataFrame:
        down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = minima(down)
        hung = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return hung.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    given = edges.where("src is not null and dst is not null")
    nodes = given.select(F.col("src").alias("node")).union(given.select(F.col("dst").alias("node")))
    pairs = materialize(given.where("src <> dst").select(F.col("src").alias("u"), F.col("dst").alias("v")).distinct(), name)
    seen = state(pairs)
    for _ in range(rounds):
        if not seen[0]:
            break
        pairs = materialize(small_star(large_star(pairs)), name)
        now = state(pairs)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still change after {rounds} rounds")
    found = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = pairs.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = nodes.select("node", F.col("node").alias("component"))
    return reduce(DataFrame.union, [found, roots, alone]).groupBy("node").agg(F.min("component").alias("component"))
