"""Audit of how five text filters interact, over all orders of applying them. DataFrame functions only.

Duplicates are found by refining a partition of the rows: by length in code points, then by the hash of one block of the
text after another; whoever is alone in its class is dropped. The full texts of those that are left are compared, and
all but the smallest id are marked. Then a row is a mask of the filters that it fails, and the masks are counted: every
figure of every order follows from these counts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, text_or_empty

FILTERS = "ABCDE"
#: Where a block begins, in code points; the last one is the rest of the text.
BLOCKS = [0, 64, 512, 4096, 32768]
WORD_GAPS = r"[\x20\x09-\x0D]+"
FIGURES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (not null) fails each of the filters that look at it alone."""

    def by_words(words: Column) -> Column:
        size, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
        return F.struct((size < 200).alias("A"), (100 * distinct < 50 * size).alias("B"))

    words = F.filter(F.split(text, WORD_GAPS), lambda w: w != "")
    both = F.get(F.transform(F.array(words), by_words), F.lit(0))  # words are a variable of a lambda: made once for a row
    length = F.length(text).cast("long")
    capitals = length - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    return {"A": both["A"], "B": both["B"], "C": 100 * capitals > 3 * length, "D": text.rlike(r"[#$%&*|]")}


def blocks_of(text: Column, hashed: Callable[..., Column] = F.xxhash64) -> list[Column]:
    """The hash of each block of a text, null for those it doesn't reach."""
    ends = [*BLOCKS[1:], (1 << 31) - 1]
    return [F.when(F.length(text) > begin, hashed(F.substring(text, begin + 1, end - begin))) for begin, end in zip(BLOCKS, ends)]


def refined(rows: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """rows (n, b0, b1, ...: length and block hashes) that share all of these with another one, with class, a hash of them.

    A round counts the rows of each class, which is combined before the shuffle, and keeps the rows of classes of two
    or more. What can't be told apart by hashes stays together, so nothing is lost.
    """
    now = rows.withColumn("class", F.xxhash64("n"))
    for i in range(len(BLOCKS) + 1):
        if i:
            now = now.withColumn("class", hashed("class", f"b{i - 1}"))
        shared = now.groupBy("class").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("class")
        now = materialize(now.join(shared, "class", "left_semi").select(*rows.columns, "class"), f"audit-classes-{i}")
    return now


def whole_class(n: Column, blocks: list[Column], hashed: Callable[..., Column] = F.xxhash64) -> Column:
    """The class that refined() ends with."""
    return reduce(hashed, blocks, F.xxhash64(n))


def orders() -> Column:
    """(filter_order, step, bit, before): each step of each order, with the masks of its filter and of those before it."""
    steps = []
    for order in permutations(FILTERS):
        bits = [1 << FILTERS.index(f) for f in order]
        steps += [("".join(order), i + 1, bit, sum(bits[:i])) for i, bit in enumerate(bits)]
    names = ["filter_order", "step", "bit", "before"]
    return F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(names, s)]) for s in steps])


def audited(counts: DataFrame) -> DataFrame:
    """(part, filter_order, step, FIGURES) from counts (part, mask, good, toxic, rows)."""
    at = counts.select("*", F.inline(orders()))
    fails, earlier = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    removed = fails & ~earlier
    total = lambda condition, value=F.col("rows"): F.sum(F.when(condition, value).otherwise(F.lit(0).cast("long"))).cast("long")
    # of a row that fails m filters each removes it in 1 / m of all orders
    share = (F.col("rows") * factorial(len(FILTERS)) / F.bit_count("mask")).cast("long")
    figures = [
        total(~fails & ~earlier), total(removed), total(fails & earlier), total(F.col("mask") == F.col("bit")),
        total(removed & F.col("good")), total(removed & F.col("toxic")), total(fails, share),
    ]
    return at.groupBy("part", "filter_order", "step").agg(*[f.alias(n) for f, n in zip(figures, FIGURES)])


def audit(docs: DataFrame, labels: DataFrame, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """part, filter_order, step and FIGURES: for each lang value, each order of the five filters and each step of it.

    A text fails A with fewer than 200 words, B if less than half of its words are distinct, C if more than 3 % of its
    code points are A to Z, D if it holds any of # $ % & * |, and E if a smaller doc_id has the same text, in any part.
    Words are runs of what isn't ASCII white space. kept and removed are the rows left after the step and removed in
    it, redundant those that fail its filter and were removed before, unique_fails those that fail no other filter,
    good_lost and toxic_lost those of removed with a label of quality 1 and of toxic 1, and shapley the removals by its
    filter, summed over all orders.

    Null text: as an empty one. Null lang: as an empty one, one part with ''. Null doc_id: never fails E, makes no other
    row fail it, and has no labels. Rows that share a doc_id and a text are no duplicates of each other, and each
    counts. Of several labels of a document any counts; labels of others, and those without an id, don't. Very long
    texts are read whole. A filter that removes nothing has zeros. An empty table gives no rows. Further columns are
    ignored, whatever their names.

    Every text is hashed where it is read; the rounds group and join ids and hashes alone. Only the texts of classes
    that are left are compared, by a grouped minimum that is combined before the shuffle, so of a large group of
    copies each task puts out one. hashed is the hash function of the blocks: any one gives the same result, as classes
    that hold different texts are told apart by the comparison.
    """
    text = text_or_empty()
    fails = failures(text)
    mask = sum((F.when(fails[f], 1 << i).otherwise(0) for i, f in enumerate(FILTERS[:-1])), F.lit(0))
    blocks = blocks_of(text, hashed)
    names = [f"b{i}" for i in range(len(BLOCKS))]
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), mask.alias("mask"),
        F.length(text).alias("n"), *[b.alias(n) for b, n in zip(blocks, names)], text.alias("text"),
    )
    rows = materialize(whole.drop("text").withColumn("row", F.monotonically_increasing_id()), "audit-rows")

    shared = refined(rows.where("doc_id is not null").select("row", "doc_id", "n", *names), hashed)
    texts = whole.where("doc_id is not null").select("doc_id", "part", "mask", "text", whole_class(F.col("n"), [F.col(n) for n in names], hashed).alias("class"))
    texts = texts.join(shared.select("class").distinct(), "class", "left_semi")
    compared = texts.groupBy("class", "text").agg(F.min("doc_id").alias("least"))
    classes = materialize(compared.groupBy("class").agg(F.count(F.lit(1)).alias("texts"), F.min("least").alias("least")), "audit-compared")

    copies = shared.join(classes, "class").where("texts = 1 and doc_id > least").select("row", F.lit(1 << FILTERS.index("E")).alias("e"))
    masks = rows.join(copies, "row", "left").withColumn("mask", F.col("mask") + F.coalesce("e", F.lit(0)))
    mixed = classes.where("texts > 1").select("class")
    if not mixed.isEmpty():  # classes whose texts have equal hashes only: these rows are read again
        again = texts.join(mixed, "class", "left_semi")
        least = again.groupBy("class", "text").agg(F.min("doc_id").alias("least"))
        retold = again.join(least, ["class", "text"]).withColumn("mask", F.col("mask") + F.when(F.col("doc_id") > F.col("least"), 1 << FILTERS.index("E")).otherwise(0))
        aside = shared.join(mixed, "class", "left_semi").select("row")
        masks = masks.join(aside, "row", "left_anti").select("doc_id", "part", "mask").unionByName(retold.select("doc_id", "part", "mask"))

    holds = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(holds("quality").alias("good"), holds("toxic").alias("toxic"))
    told = masks.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    counts = told.groupBy("part", "mask", flag("good"), flag("toxic")).agg(F.count(F.lit(1)).alias("rows"))
    return audited(materialize(counts, "audit-masks")).select("part", "filter_order", "step", *FIGURES)
