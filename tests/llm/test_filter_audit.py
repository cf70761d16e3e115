import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import filter_audit, oracle
from tests.llm.conftest import SCHEMA, sentence


def brute(rows, labels):
    """{(part, order, step): figures} of rows (doc_id, text, lang)."""
    least, good, toxic = {}, set(), set()
    for doc_id, text, _ in rows:
        if doc_id is not None:
            least[text or ""] = min(least.get(text or "", doc_id), doc_id)
    for doc_id, q, t in labels:
        good |= {doc_id} if q == 1 else set()
        toxic |= {doc_id} if t == 1 else set()
    parts = {}
    for doc_id, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", text) else set()
        fails |= {"E"} if doc_id is not None and doc_id > least[text] else set()
        parts.setdefault(lang or "", []).append((doc_id, fails))
    out, shapley = {}, Counter()
    for part, own in parts.items():
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [d for d, fails in left if f in fails]
                before = [d for d, fails in own if f in fails and fails & set(order[: step - 1])]
                alone = sum(fails == {f} for _, fails in own)
                left = [x for x in left if f not in x[1]]
                out[part, "".join(order), step] = [len(left), len(removed), len(before), alone, sum(d in good and d is not None for d in removed), sum(d in toxic and d is not None for d in removed)]
                shapley[part, f] += len(removed)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def checked(spark, rows, labels, **how):
    docs = spark.createDataFrame([(i, t, lang, None, None, 1, "k", 0.5) for i, t, lang in rows], SCHEMA).withColumns({"part": F.lit("p"), "mask": F.lit("m"), "class": F.lit(1), "row": F.lit(2), "b0": F.lit(3)})
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **how).collect()
    assert len(got) == 600 * len({lang or "" for _, _, lang in rows})
    want = brute(rows, labels)
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == want
    return want


LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, 0, 1), (9, None, 1), (9, 1, None), (None, 1, 1), (10, 0, 0), (77, 1, 1)]


def test_odd_rows_equal_brute_force(spark, odd_rows):
    want = checked(spark, [(r[0], r[1], r[2]) for r in odd_rows], LABELS)
    assert want["en", "EABCD", 1][1] == 1  # document 2 has the text of document 1


@pytest.fixture(scope="module")
def many():
    rng = random.Random(8)
    long = sentence(rng, 9000)  # some 36,000 code points: into the last block
    texts = ["", None, "Aa", "a b c", "A B C", long, long[:-1] + "Z", "Y" + long[1:], long[:5000] + "!" + long[5001:], long[:40000] + "é" * 40, sentence(rng, 300), sentence(rng, 300) + " #1", "x y " * 150, "one\x0btwo　three " * 80]
    rows = [(rng.choice([None, *range(60)]) if rng.random() < 0.1 else i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(150)]
    return rows, [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 150, 2)]


def test_copies_and_near_copies_equal_brute_force(spark, many):
    checked(spark, *many)


@pytest.mark.parametrize("hashed", [lambda *c: F.lit(0).cast("long"), lambda *c: F.pmod(F.xxhash64(*c), F.lit(2))])
def test_classes_that_hold_different_texts_are_told_apart(spark, many, hashed):
    checked(spark, *many, hashed=hashed)


def test_sql_equals_brute_force(many):
    rows, labels = [r for r in many[0] if r[0] is not None], many[1]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    con.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)")
    con.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    got = con.sql(oracle.oracle_sql()["op13_filter_audit"]).fetchall()
    assert {r[:3]: r[3:] for r in got} == brute(rows, labels)


def test_rounds_drop_what_is_alone(spark):
    texts = ["a" * 100, "a" * 100, "a" * 99 + "b", "a" * 63 + "c" + "a" * 36, "a" * 101]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    blocks = filter_audit.blocks_of(F.col("text"))
    left = filter_audit.refined(docs.select("doc_id", F.length("text").alias("n"), *[b.alias(f"b{i}") for i, b in enumerate(blocks)]))
    assert sorted(r.doc_id for r in left.collect()) == [0, 1]


def test_empty_tables(spark, none):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(none, no_labels).count() == 0
    checked(spark, [(1, "a", "en"), (2, "a", "en")], [(3, 1, 1)])
