"""Consistent weighted sampling of documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import materialize

SHINGLE = 5
#: Samples of a fingerprint, of four hexadecimal digits each.
SAMPLES = 64
DIGITS = 4


def _let(value: Column, use) -> Column:
    """use(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def draw(term: Column, sample: Column, i: int = 0) -> Column:
    """52 bits, as a number from 0, that hang on the arguments alone. For a sample that is a literal it takes one hash."""
    return F.shiftrightunsigned(F.xxhash64(term.bitwiseXOR(F.xxhash64(sample, F.lit(i)))), 12)


def level(drawn: Column) -> Column:
    """A draw as a number in (0, 1)."""
    return (drawn.cast("double") + 0.5) / float(1 << 52)


def exponential(drawn: Column) -> Column:
    """An exponential variable, the less the larger the draw is; never 0."""
    return -F.log(level(drawn))


def log_sample(term: Column, sample: Column, weight: Column) -> Column:
    """ln a of a term of this weight for a sample; the term with the least is the sample's result.

    r and c are gamma (2, 1) and b is uniform, all fixed by term and sample. With t = floor(ln weight / r + b) and
    ln y = r (t - b), ln a = ln c - ln y - r. Two sets agree in a sample's least a with a probability that is the sum
    of the smaller weights of all terms over that of the larger ones. a stands for the term and y at once.

    They are drawn from exponential variables x, e and f, which gives them these very distributions: c = x + e,
    r = ln(c / x) + f and b = f / r. So t = floor((ln weight + f) / r), and ln a = ln x - r t: at weight 1 it is ln x.
    """
    x, q, t = steps(term, sample, F.log(weight))
    return F.log(x) + F.log(q) * t


def steps(term: Column, sample: Column, log_weight: Column) -> tuple[Column, Column, Column]:
    """x, exp(-r) and t of log_sample(). f is -ln u of a uniform u, so exp(-r) is u x / (x + e) and takes no logarithm of
    its own: what is compiled for each sample is the shorter for that."""
    x, e = [exponential(draw(term, sample, i)) for i in range(2)]
    u = level(draw(term, sample, 2))
    q = u / (1.0 + e / x)
    return x, q, F.floor((F.log(u) - log_weight) / F.log(q))


def weighted_terms(text: Column) -> Column:
    """The text's 5-word shingles, hashed to 64 bits, as (term, times); of fewer words the sequence of all; none without words."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def shingled(h: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(SHINGLE)]))
        few = F.when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(h) >= SHINGLE, many).otherwise(few)

    hashed = _let(F.transform(words, lambda w: F.xxhash64(w)), shingled)
    terms = F.sort_array(hashed)

    def counted(s: Column) -> Column:
        ends = F.filter(F.transform(s, lambda x, i: F.when(x.eqNullSafe(F.get(s, i + 1)), F.lit(None).cast("int")).otherwise(i)), lambda e: e.isNotNull())
        return _let(ends, lambda e: F.transform(e, lambda x, i: F.struct(F.get(s, x).alias("term"), (x - F.coalesce(F.get(e, i - 1), F.lit(-1))).alias("times"))))

    return _let(terms, counted)


def shared_terms(pairs: DataFrame, keys: list[str], one: str, two: str) -> DataFrame:
    """keys, _kind, term, times for the terms of two texts of each row of pairs; _kind: 0 of one, 1 of two, 2 of both.

    Terms that occur once in either text, which are nearly all that two versions of a text share, come once. A row
    whose texts have no terms comes once, with nulls.
    """
    once = lambda t: F.transform(F.filter(t, lambda x: x["times"] == 1), lambda x: x["term"])
    more = lambda t: F.filter(t, lambda x: x["times"] > 1)
    # step by step, so that each column is computed once
    rows = pairs.select(*keys, weighted_terms(F.col(one)).alias("_a"), weighted_terms(F.col(two)).alias("_b"))
    rows = rows.select(*keys, once(F.col("_a")).alias("_a1"), once(F.col("_b")).alias("_b1"), more(F.col("_a")).alias("_am"), more(F.col("_b")).alias("_bm"))
    rows = rows.select(*keys, F.array_except("_a1", "_b1").alias("_a1"), F.array_except("_b1", "_a1").alias("_b1"), F.array_intersect("_a1", "_b1").alias("_ab"), "_am", "_bm")
    single = lambda c, kind: F.transform(c, lambda t: F.struct(F.lit(kind).alias("_kind"), t.alias("term"), F.lit(1).alias("times")))
    several = lambda c, kind: F.transform(c, lambda x: F.struct(F.lit(kind).alias("_kind"), x["term"].alias("term"), x["times"].alias("times")))
    return rows.select(*keys, F.inline_outer(F.concat(single("_ab", 2), single("_a1", 0), single("_b1", 1), several("_am", 0), several("_bm", 1))))


def signatures(pairs: DataFrame, keys: list[str], one: str, two: str, samples: int = SAMPLES) -> DataFrame:
    """keys, _one and _two, the fingerprints of two texts, for each row of pairs. keys must tell rows apart; where pairs
    is dealt by some of them, nothing is shuffled.

    Kept is the largest exp(-a) of a sample, that is exp(-x exp(-r t)): at weight 1, and where t is 0, the draw itself.
    It is written as the draw times exp(x (1 - exp(-r t))), so that it is exactly that, and without functions of arrays,
    so that it is compiled.
    """
    rows = shared_terms(pairs, keys, one, two).withColumn("_log", F.log("times"))
    term, times = F.col("term"), F.col("times")

    def value(j: Column) -> Column:
        x, q, t = steps(term, j, F.col("_log"))
        return level(draw(term, j)) * F.when(times == 1, 1.0).otherwise(F.exp(x * (1.0 - F.pow(q, t))))

    most = rows.groupBy(*keys, "_kind").agg(*[F.max(value(F.lit(j))).alias(f"_m{j}") for j in range(samples)])
    held = most.select(*keys, "_kind", F.array(*[f"_m{j}" for j in range(samples)]).alias("_m"))
    of = lambda kind: F.max(F.when(F.col("_kind") == kind, F.col("_m"))).alias(f"_k{kind}")
    each = held.groupBy(*keys).agg(of(0), of(1), of(2))
    digits = lambda m: F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(m), F.lit(16**DIGITS)))), DIGITS, "0")
    places = F.sequence(F.lit(0), F.lit(samples - 1))
    sign = lambda own: F.array_join(F.transform(places, lambda j: digits(F.greatest(F.get(own, j), F.get("_k2", j)))), "")
    return each.select(*keys, sign("_k0").alias("_one"), sign("_k1").alias("_two"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of samples in which two fingerprints agree: an estimate of the generalised Jaccard similarity."""
    part = lambda x, i: F.substring(x, i * DIGITS + 1, F.lit(DIGITS))
    same = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda i: (part(a, i) == part(b, i)).cast("int"))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y) / float(samples)


def following(docs: DataFrame) -> DataFrame:
    """(_key, _next, _need) for each key of docs (_key, _quarter): the next larger key, after the last the first; the largest quarter."""
    keys = docs.groupBy("_key").agg(F.max("_quarter").alias("_need"))
    ranged = materialize(keys.repartitionByRange("_key").withColumn("_part", F.spark_partition_id()), "keys-in-order")
    firsts = ranged.groupBy("_part").agg(F.min("_key").alias("_first"))
    # a row for each partition only
    ahead = firsts.select(F.col("_part").alias("_p"), F.lead("_first").over(Window.orderBy("_part")).alias("_ahead"), F.min("_first").over(Window.partitionBy()).alias("_least"))
    in_part = F.lead("_key").over(Window.partitionBy("_part").orderBy("_key"))
    joined = ranged.withColumn("_in_part", in_part).join(F.broadcast(ahead), F.col("_part") == F.col("_p"))
    return joined.select("_key", F.coalesce("_in_part", "_ahead", "_least").alias("_next"), "_need")


def fingerprint_documents(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike they, and neighbours, are.

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many (or all) of the next
    document in ascending doc_id; after the last comes the first.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Null text: as an empty one; a text without words has no terms, and is like any other such text (1) and no text
    with words (0). A null doc_id comes first, as the id -2**63, which is returned as null too. Where rows share a doc_id each has its row here, and as somebody's next
    document the one with the least text, or fingerprint, counts. A single document is its own next. An empty table
    gives an empty table. Other columns are ignored.
    """
    none = F.lit(-(2**63)).cast("long")
    key = F.coalesce(F.col("doc_id").cast("long"), none)
    # read by both sides of the join below with the same columns, so its shuffle is made once and reused
    base = docs.select(key.alias("_key"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lengths = docs.select(key.alias("_key"), F.floor(F.length(F.coalesce(F.col("text"), F.lit(""))) / 4).alias("_quarter"))
    pairs = materialize(following(lengths), "following")

    wanted = pairs.select(F.col("_next").alias("_key"), F.col("_key").alias("_of"), "_need")
    heads = base.join(wanted, "_key").select(F.col("_of").alias("_key"), F.substring(F.col("text"), F.lit(1), F.col("_need").cast("int")).alias("_head"))
    heads = heads.groupBy("_key").agg(F.min("_head").alias("_head"))
    joined = base.join(heads, "_key", "left").select("_key", "text", "_head", F.length("text").cast("int").alias("_n"))
    quarter = F.floor(F.col("_n") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("_n") - quarter), F.substring(F.coalesce("_head", F.lit("")), F.lit(1), quarter))
    both = joined.select("_key", F.monotonically_increasing_id().alias("_row"), "_n", "text", edited.alias("_edited"))
    both = both.withColumn("_sha", F.unhex(F.sha2("_edited", 256)))
    signed = signatures(both, ["_key", "_row", "_n", "_sha"], "text", "_edited", samples)
    found = materialize(signed.withColumnsRenamed({"_one": "fingerprint", "_two": "edited_fingerprint"}), "fingerprints")

    next_ones = found.groupBy("_key").agg(F.min("fingerprint").alias("_next_fingerprint"))
    ahead = pairs.select("_key", "_next").join(next_ones.withColumnRenamed("_key", "_next"), "_next").select("_key", "_next_fingerprint")
    return found.join(ahead, "_key").select(
        F.nullif("_key", none).alias("doc_id"),
        F.col("_n").cast("long").alias("n_chars"),
        F.lower(F.hex("_sha")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("_next_fingerprint"), samples).alias("near_next"),
    )
