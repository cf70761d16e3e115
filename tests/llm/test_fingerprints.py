import hashlib
import random
from collections import Counter

import numpy as np

from lorequarry.llm import fingerprints

from .conftest import paragraphs, sentence


def neighbours(rows):
    """(doc_id, text) sorted -> (doc_id, n, sha of the edited text, edited, next text)."""
    rows = sorted(rows)
    out = []
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        m = len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), edited, after))
    return out


def weights(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    return Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])


def jaccard(a, b):
    top = sum((a | b).values())
    return sum((a & b).values()) / top if top else 1.0


def test_edited_texts_and_likeness(spark):
    rng = random.Random(6)
    repeated = "\n".join([sentence(rng, 9)] * 12)
    rows = [(i * 7 - 50, rng.choice([paragraphs(rng, rng.randrange(1, 12)), repeated, sentence(rng, rng.randrange(1, 9)), "漢字 é😀 " * 5, "", None])) for i in range(60)]
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = dict(rows)
    assert len(out) == len(rows)
    errors, by_text = [], {}
    for doc, n, sha, edited, after in neighbours(rows):
        r = out[doc]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        text = texts[doc] or ""
        errors += [r.near_edited - jaccard(weights(text), weights(edited)), r.near_next - jaccard(weights(text), weights(after))]
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert by_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert len(r.fingerprint) == 4 * fingerprints.SAMPLES
    assert abs(np.mean(errors)) < 0.02 and np.sqrt(np.mean(np.square(errors))) < 0.07


def test_collision_rate_is_the_generalised_jaccard_similarity(spark):
    """Of weighted sets given directly, over many samples."""
    from pyspark.sql import functions as F

    a, b = {1: 3, 2: 1, 3: 7, 4: 2}, {1: 1, 3: 9, 4: 2, 5: 4}
    rows = [(s, t, float(w)) for s, x in (("a", a), ("b", b)) for t, w in x.items()]
    df = spark.createDataFrame(rows, "s string, term int, w double").crossJoin(spark.range(4000).withColumnRenamed("id", "j"))
    least = df.withColumn("v", fingerprints.log_sample(F.col("term"), F.col("j").cast("int"), F.col("w"))).groupBy("s", "j").agg(F.min("v").alias("v"))
    same = least.groupBy("j").agg((F.count_distinct("v") == 1).cast("double").alias("same")).agg(F.avg("same")).first()[0]
    expected = sum(min(a.get(t, 0), b.get(t, 0)) for t in a | b) / sum(max(a.get(t, 0), b.get(t, 0)) for t in a | b)
    assert abs(same - expected) < 0.03


def test_very_long_texts(spark):
    """100,000 words: unrelated texts aren't alike, and an edited text is no more alike than it is."""
    rng = random.Random(3)
    rows = [(i, sentence(rng, 100_000)) for i in range(3)]
    rows.append((3, " ".join(sentence(rng, 2500) for _ in range(20)) + " " + " ".join([sentence(rng, 2500)] * 20)))
    out = {r.doc_id: r for r in fingerprints.fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(out[i].near_next < 0.05 for i in range(4))
    errors = [out[doc].near_edited - jaccard(weights(dict(rows)[doc]), weights(edited)) for doc, _, _, edited, _ in neighbours(rows)]
    assert abs(np.mean(errors)) < 0.08


def test_the_least_sample_of_single_and_repeated_terms_is_that_of_log_sample(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(t, float(w)) for t in range(300) for w in (1, 2, 5)], "term long, w double")
    got = df.select("w", fingerprints.log_sample(F.col("term"), F.lit(7), F.col("w")).alias("a"), F.log(fingerprints.exponential(fingerprints.draw(F.col("term"), F.lit(7)))).alias("x")).collect()
    assert all(r.a == r.x if r.w == 1 else r.a <= r.x for r in got) and any(r.a == r.x for r in got if r.w == 5)


def test_a_single_document_and_equal_texts(spark):
    one = fingerprints.fingerprint_documents(spark.createDataFrame([(5, "abcd efgh")], "doc_id long, text string")).collect()
    assert one[0].near_next == 1.0 and one[0].edited_sha256 == hashlib.sha256(b"abcd efab").hexdigest()


def test_odd_rows(spark, odd, odd_rows):
    out = fingerprints.fingerprint_documents(odd).collect()
    assert sorted(((r.doc_id, r.n_chars) for r in out), key=str) == sorted(((r[0], len(r[1] or "")) for r in odd_rows), key=str)
    same = [r.fingerprint for r in out if r.doc_id in (1, 2)]
    assert same[0] == same[1]


def test_empty_table(none):
    assert fingerprints.fingerprint_documents(none).count() == 0
