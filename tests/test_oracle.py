"""Every registered query against its SQL, on the smallest tables."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from lorequarry.operators import search
from lorequarry.plans import oracle, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def shown(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted(oracle.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(oracle.oracle_sql()[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


def test_approximate_search_finds_most_of_the_exact_answers(spark):
    exact = {(r.query_id, r.id) for r in queries.vector_topk_batch(spark, DATA).where("rank <= 5").collect()}
    near = {(r.query_id, r.id) for r in queries.lsh_topk(spark, DATA).collect()}
    assert len(near & exact) >= 0.9 * len(exact)
    assert {(q, q) for q, _ in exact} <= near


def test_chunks_by_a_tokenizer_file_equal_brute_force(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rules, expected = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), set()
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        spans = rules.encode(r.text, add_special_tokens=False).offsets
        for idx, start in enumerate(range(0, max(1, len(spans) - 64), 512 - 64)):
            part = spans[start : start + 512]
            if part:
                expected.add((f"{r.doc_id}#{idx}", idx, len(part), part[-1][1] - part[0][0]))
    got = queries.hf_chunking(spark, DATA).collect()
    assert len(got) == len(expected) and {tuple(r) for r in got} == expected


def test_search_with_the_hashing_embedder_equals_brute_force(spark):
    terms = re.compile(r"[^\W\d_]+|\d+")

    def vector(text):
        v = np.zeros(64)
        for t in terms.findall(text.lower()):
            c = zlib.crc32(t.encode())
            v[c % 64] += 1 - 2 * (c // 64 % 2)
        n = np.linalg.norm(v)
        return (v / n if n else v).astype(np.float32).astype(float)

    read = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").collect()
    docs = {r.doc_id: vector(r.text) for r in read("documents")}
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in queries.hashing_search(spark, DATA).collect()}
    for item in read("benchmark"):
        v = vector(item.text)
        scores = sorted(((-round(float(v @ w / np.linalg.norm(v) / np.linalg.norm(w)), 6), i) for i, w in docs.items() if w.any()))[:3]
        for rank, (score, _) in enumerate(scores, 1):
            assert abs(got[item.item_id, rank][1] + score) < 2e-6
    assert len(got) == 3 * len(read("benchmark"))


def test_ties_of_vector_search_go_by_id(spark):
    rows = spark.createDataFrame([(f"c{i:04d}", [1.0, 0.0] if i % 3 else [0.6, 0.8]) for i in range(3000)] + [("z", None), ("y", [0.0, 0.0]), ("x", [1.0])], "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame([(0, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [0.0, 0.0]), (3, None)], "query_id long, vector array<float>")
    got = [(r.query_id, r.id, r.score) for r in search.vector_search(rows, asked, 4).orderBy("query_id", "rank").collect()]
    assert got == [(0, f"c{i:04d}", 1.0) for i in (1, 2, 4, 5)] + [(1, f"c{i:04d}", 0.8) for i in (0, 3, 6, 9)]
    pairs = search.top_k(search.vector_scores(rows, asked), 4).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id, r.score) for r in pairs] == got


@pytest.mark.parametrize("name", ["kb_as_of", "kb_delete", "kb_reindex_partial"])
def test_of_equal_texts_that_of_the_least_id_is_stored_whichever_file_is_read_first(spark, tmp_path, name):
    at = tmp_path / "documents.parquet"
    at.mkdir()
    con = duckdb.connect()
    rows = "SELECT i AS doc_id, 'text ' || i % 10 AS text, 'en' AS lang, 'src' || (i // 10 % 2 = {0})::INT AS source, 6::BIGINT AS n_chars FROM range({1}, {2}) r(i)"
    con.sql(f"COPY ({rows.format(0, 0, 5)}) TO '{at}/a.parquet'")
    con.sql(f"COPY ({rows.format(0, 5, 10)}) TO '{at}/b.parquet'")
    con.sql(f"COPY ({rows.format(0, 10, 40)}) TO '{at}/c.parquet'")  # the largest is read first
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{at}/*.parquet'")
    got = sorted(tuple(sorted(r.asDict().items())) for r in queries.queries()[name](spark, str(tmp_path)).collect())
    rel = con.sql(oracle.oracle_sql()[name])
    assert got == sorted(tuple(sorted(zip(rel.columns, r))) for r in rel.fetchall())
