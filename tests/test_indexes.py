"""The stored indexes: cells of vectors, blocks of postings, and what a search reads of them."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.config import Chunking, Config, Embedding, Storage
from lorequarry.engine import KnowledgeBase
from lorequarry.operators import cells, index, ingest, search
from lorequarry.plans.fixtures import LetterEmbedder


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(40, 16))
    made = (centers[rng.integers(0, 40, 4000)] + 0.35 * rng.normal(size=(4000, 16))).astype(np.float32)
    rows = [(f"c{i:05d}", f"d{i}", v.tolist()) for i, v in enumerate(made)] + [("zero", "d", [0.0] * 16), ("none", "d", None), ("null", "d", [None] * 16), ("like", "d", made[7].tolist())]
    return spark.createDataFrame(rows, "chunk_id string, document_id string, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def stored(spark, vectors, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("cells") / "vector")
    centers = cells.trained(vectors, 4000)
    placed = cells.assigned(vectors, centers)
    placed.drop("angle").write.partitionBy("cell").parquet(at)
    return spark.read.parquet(at), centers, {r["cell"]: (r["rows"], r["radius"]) for r in cells.reach(placed).collect()}


@pytest.fixture(scope="module")
def asked(spark, vectors):
    own = [(i, r["embedding"]) for i, r in enumerate(vectors.where("chunk_id like 'c%'").orderBy("chunk_id").limit(60).collect())]
    rng = np.random.default_rng(9)
    far = [(100 + i, rng.normal(size=16).astype(np.float32).tolist()) for i in range(10)]
    return spark.createDataFrame([*own, *far, (200, [0.0] * 16), (201, None), (202, [1.0])], "query_id long, vector array<float>")


def got(hits):
    return sorted((r.query_id, r["rank"], r.id, round(r.score, 5)) for r in hits.collect())


def test_exact_cells_equal_a_scan(vectors, stored, asked):
    want = got(search.vector_search(vectors.where("not (chunk_id in ('none', 'null'))"), asked, 10))
    hits, report = cells.cell_search(*stored, asked, 10)
    assert got(hits) == want and len(want) == 700 and all(report.certain.values())
    pairs = search.top_k(search.vector_scores(vectors.where("not (chunk_id in ('none', 'null'))"), asked), 10)
    assert got(pairs) == want


def test_near_cells_find_nearly_all_and_tell_what_is_certain(spark, vectors, stored, asked):
    near = asked.where("query_id < 100")
    want = {(q, i) for q, _, i, _ in got(search.vector_search(vectors.where("chunk_id <> 'null'"), near, 10))}
    hits, report = cells.cell_search(*stored, near, 10, exact=False, probes=4)
    found = {}
    for q, _, i, _ in got(hits):
        found.setdefault(q, set()).add((q, i))
    assert len(want & set().union(*found.values())) >= 0.95 * len(want)
    sure = [q for q, known in report.certain.items() if known]
    assert all(found[q] <= want for q in sure) and report.read < 60 * report.cells
    one = near.where("query_id = 3")
    hits, report = cells.cell_search(*stored, one, 10, exact=False, probes=4)
    assert report.read == 4 and report.vectors_read < 0.3 * report.vectors
    rows = stored[0].where(F.col("cell").isin([1, 2]))
    assert "PartitionFilters: [cell" in plan(rows)


def test_few_vectors_are_found_though_cells_are_small(spark, stored):
    few = stored[0].where("chunk_id < 'c00003'")
    asked = spark.createDataFrame([(0, [1.0] * 16)], "query_id long, vector array<float>")
    for exact in (True, False):
        hits, _ = cells.cell_search(few, stored[1], stored[2], asked, 10, exact=exact, probes=1)
        assert {r.id for r in hits.collect()} == {"c00000", "c00001", "c00002"}


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    rows = []
    for i in range(6000):
        n = rng.choice([5, 20, 60, 200])
        own = ["alpha"] * rng.choice([0, 1, 1, 2, 9 if i % 200 == 0 else 1]) + ["beta"] * (rng.random() < 0.5) + ["gamma"] * (rng.random() < 0.02)
        rows.append((f"d{i}#0", f"d{i}", " ".join(rng.sample(own + rng.choices(words, k=n), len(own) + n))))
    return spark.createDataFrame(rows, "chunk_id string, document_id string, content string").repartition(4)


@pytest.fixture(scope="module")
def blocks(spark, texts, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("blocks") / "posting")
    index.blocked(index.postings(texts, "chunk_id", "content").select("term", F.col("id").alias("chunk_id"), F.regexp_replace("id", "#0", "").alias("document_id"), "tf", "length")).write.parquet(at)
    return spark.read.parquet(at).withColumn("v", F.lit(1))


@pytest.mark.parametrize("match_all", [True, False])
@pytest.mark.parametrize("queries", [{0: ["alpha"]}, {0: ["alpha", "beta"], 1: ["gamma", "alpha"], 2: ["nothing", "beta"], 3: ["waa", "wab", "wac"]}])
def test_blocks_give_what_a_scan_gives(spark, texts, blocks, queries, match_all):
    asked = spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts], "query_id long, term string")
    sums = texts.select(F.size(F.split("content", " ")).alias("n")).agg(F.count(F.lit(1)), F.sum("n")).first()
    scores, read = index.block_search(blocks, lambda rows: rows, spark.createDataFrame([], "term string, df long"), *sums, asked, 10, match_all=match_all)
    want = search.keyword_search(texts, asked, 10, match_all=match_all)
    found = got(search.top_k(scores, 10))
    assert [x[:3] for x in found] == [x[:3] for x in got(want)] and found
    assert max(abs(a[3] - b[3]) for a, b in zip(found, got(want))) < 2e-5
    if queries == {0: ["alpha"]}:
        assert read.blocks >= 15 and read.read <= read.blocks / 2


def test_many_terms_are_joined_instead_of_named(spark, texts, blocks, monkeypatch):
    asked = spark.createDataFrame([(0, "alpha"), (0, "beta"), (1, "waa"), (1, "gamma")], "query_id long, term string")
    none = spark.createDataFrame([], "term string, df long")
    named = got(search.top_k(index.block_search(blocks, lambda rows: rows, none, 6000, 400_000, asked, 5, match_all=False)[0], 5))
    monkeypatch.setattr(index, "PUSHED_TERMS", 1)
    assert got(search.top_k(index.block_search(blocks, lambda rows: rows, none, 6000, 400_000, asked, 5, match_all=False)[0], 5)) == named


def test_blocks_hold_all_postings_and_their_bounds(blocks, texts):
    r = blocks.select("term", F.inline("postings"), "max_tf", "min_length", "n").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("tf") > F.col("max_tf")).alias("a"), F.max(F.col("length") < F.col("min_length")).alias("b"), F.max("n").alias("most")).first()
    assert r["n"] == index.postings(texts, "chunk_id", "content").count() and not r["a"] and not r["b"] and r["most"] <= index.BLOCK


def test_blocks_are_made_where_postings_are_and_name_a_chunk_once(spark, tmp_path, monkeypatch):
    """Before, all postings were shuffled by term, and a part had the names of a chunk for each of its terms."""
    from lorequarry.store import Store

    ids = [f"{i:064x}" for i in range(1, 401)]
    posted = spark.createDataFrame([(f"t{j:03d}", f"{d}#0", d, 1 + (i * j) % 3, 200) for i, d in enumerate(ids) for j in range(200)], "term string, chunk_id string, document_id string, tf long, length long")
    posted = posted.select("term", F.sha2("chunk_id", 256).alias("chunk_id"), F.sha2("document_id", 256).alias("document_id"), "tf", "length").repartition(2, "document_id")
    posted.write.parquet(str(tmp_path / "posted"))
    posted = spark.read.parquet(str(tmp_path / "posted"))
    assert "Exchange" not in plan(index.blocked(posted))
    store = Store(spark, str(tmp_path / "store"))
    store.commit({"posting": index.blocked(posted)})
    assert sum(f.stat().st_size for f in (tmp_path / "store").rglob("*.parquet")) < 80_000 * 16
    monkeypatch.setattr(index, "SEGMENT", 10_000)  # in several segments
    for made in (store.blocks(store.pointer()), index.blocked(posted)):
        rows = made.select("term", F.inline("postings"))
        assert rows.count() == 80_000 and rows.exceptAll(posted.select(*rows.columns)).isEmpty()
        assert made.where("n <> size(postings) or n > 256").isEmpty()


def test_a_knowledge_base_keeps_its_indexes_right(spark, tmp_path):
    """Uploads, replacement, deletion and compaction: both indexes give what the tables themselves give."""
    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]
    text = lambda i: " ".join(rng.choices(words, k=rng.randrange(3, 40))) + f" n{chr(97 + i % 26)}"
    config = Config(storage=Storage(path=str(tmp_path / "kb")), embedding=Embedding(onnx_path="mock", dimension=8), chunking=Chunking(20, 2))
    base = KnowledgeBase(spark, config, LetterEmbedder())
    texts = [text(i) for i in range(500)]
    ids = [r.document_id for r in base.upload(content=texts).collect()]

    def check():
        chunks = base.table("chunk")
        sums = chunks.agg(F.count(F.lit(1)), F.sum("terms")).first()
        assert (base.store.pointer()["stats"]["chunks"], base.store.pointer()["stats"]["terms"]) == tuple(sums)
        terms = spark.createDataFrame([(0, "alpha"), (0, "beta")], "query_id long, term string")
        want = got(search.keyword_search(chunks, terms, 10))
        assert got(base.search("alpha beta", mode="keyword", top_k=10).withColumnRenamed("chunk_id", "id")) == want
        vector = spark.createDataFrame([(0, "alpha beta nc")], "query_id long, t string").select("query_id", LetterEmbedder().embed(F.col("t"), F.lit(0)).alias("vector"))
        want = got(search.vector_search(chunks, vector, 10))
        assert got(base.search("alpha beta nc", mode="vector", top_k=10).withColumnRenamed("chunk_id", "id")) == want
        assert base.read["vector"].cells > 1 and base.table("vector").count() == sums[0]

    check()
    base.delete(ids[:40])
    base.upload(content=[text(7), texts[60]], force=True)
    check()
    base.compact()
    check()
    # text is read by name, within the ranges that may hold it
    hits = base.search("alpha beta", mode="keyword", top_k=3)
    shown = plan(hits)
    assert "In(chunk_id" in shown or "chunk_id IN" in shown or "EqualTo(chunk_id" in shown
    assert shown.count("FileScan") == 2 and "postings" not in shown


def test_hops_rank_by_distance(spark, tmp_path):
    config = Config(storage=Storage(path=str(tmp_path / "kb")), embedding=Embedding(onnx_path="mock", dimension=8))
    base = KnowledgeBase(spark, config)
    told = base.upload(content=["needle here #aa", "about #bb", "about #cc", "about #dd", "also #aa"]).collect()
    base.link_entities("aa", "bb", "r", 1.0)
    base.link_entities("bb", "cc", "r", 0.5)
    base.link_entities("cc", "dd", "r", 1.0)
    rows = base.search("needle", mode="keyword", graph_expand=5, hops=2).collect()
    score = rows[0].score / 1.5  # its own, and half of it by its entity
    of = {told[i].document_id: i for i in range(5)}
    assert [(of[r.document_id], round(r.score / score, 3), list(r.matched_entities)) for r in rows] == [(0, 1.5, []), (4, 0.5, ["aa"]), (1, 0.25, ["bb"]), (2, 0.062, ["cc"])]
    assert {r["rank"] for r in rows} == {1, 2, 3, 4}
    assert len(base.search("needle", mode="keyword", graph_expand=1, hops=3).collect()) == 2


def test_chunks_tell_where_they_begin_and_their_heading(spark, tmp_path):
    import public_tokenizers

    from lorequarry.functions.embedders import FileTokenizer, WhitespaceTokenizer
    from lorequarry.operators import ingest

    texts = ["  lead é in\n# One\nword word word\n## Two #\nmore words here\n#### Deep\nx y z\n### Three\nq r\n## Last\nend of all it", "no heading at all", "", None, "# \n\n# A1\n# B's\nbody text", "#\n\nOdd one\n\n" + "w " * 30]
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "document_id string, content string")
    for tokenizer in (WhitespaceTokenizer(), FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))):
        for r in ingest.chunk_rows(docs, tokenizer, 4, 1).collect():
            text = texts[int(r.document_id)]
            assert text[r.start :].startswith(r.content)
    rows = ingest.chunk_rows(docs, WhitespaceTokenizer(), 4, 1).orderBy("document_id", "idx").collect()
    paths = [r.heading for r in rows if r.document_id == "0"]
    assert paths[0] is None and {"One", "One > Two #", "One > Two # > Deep", "One > Two # > Three", "One > Last"} >= set(paths[1:]) and paths[-1] == "One > Last"
    assert {r.heading for r in rows if r.document_id == "1"} == {None}


def test_hyperplanes_shuffle_no_vectors(spark, vectors):
    """Before, each vector was shuffled once for each of 20 tables, and pairs were scored by Spark's array functions."""
    few = vectors.where("chunk_id like 'c00%' or chunk_id in ('zero', 'none', 'null', 'like')")
    asked = few.where("chunk_id like 'c000%'").select(F.substring("chunk_id", 2, 5).cast("long").alias("query_id"), F.col("embedding").alias("vector"))
    hits = search.lsh_search(few, asked, 5)
    assert plan(hits).count("Exchange hashpartitioning") == 1 and "embedding" not in plan(hits).split("MapInArrow")[0]
    want = {(r.query_id, r.id): r.score for r in search.vector_search(few.where("chunk_id not in ('none', 'null')"), asked, 5).collect()}
    found = {(r.query_id, r.id): r.score for r in hits.collect()}
    assert len(found) == len(want) and len(found.keys() & want) >= 0.9 * len(want)
    assert all(abs(found[x] - want[x]) < 2e-6 for x in found.keys() & want)


@pytest.mark.parametrize("name", ["kb_vector", "kb_hybrid"])
def test_chunks_without_a_letter_equal_sql(spark, tmp_path, name):
    """Their cosine isn't defined; SQL has it as NaN, before all others. Before, they weren't among the hits."""
    import duckdb

    from lorequarry.plans import oracle, queries

    docs = [(i, f"ther hein text {chr(97 + i)} " * (1 + i % 4), "en", f"src{i % 2}") for i in range(20)] + [(100 + i, "éç, " * (i + 1), "fr", "src0") for i in range(3)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "text a b"), (1, "éç"), (2, "hein")], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = queries.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        want = con.sql(f"SELECT {', '.join(rows.columns)} FROM ({oracle.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["expand_nhop", "graph_expand_hits"])
def test_texts_are_searched_and_extracted_once(spark, name):
    """Before, the final plan read and analysed the texts again for each use of hits and mentions."""
    from lorequarry.plans import queries

    assert "text:string" not in plan(queries.queries()[name](spark, "/root/testdata/sf0.001"))


def test_centers_are_trained_without_a_sort_and_on_vectors_that_have_a_direction(spark, monkeypatch):
    from pyspark.ml.feature import Normalizer

    rows = [(f"c{i:04d}", f"d{i}", [float(i % 7 - 3), float(i % 5 - 2)]) for i in range(2000)] + [("inf", "d", [float("inf"), 1.0]), ("nan", "d", [float("nan"), 1.0]), ("half", "d", [1.0, None])]
    given = spark.createDataFrame(rows, "chunk_id string, document_id string, embedding array<float>").repartition(8)
    fitted, own = [], Normalizer.transform
    monkeypatch.setattr(Normalizer, "transform", lambda self, df: fitted.append(df) or own(self, df))
    centers = cells.trained(given, len(rows))
    assert 2 <= len(centers) <= 44 and all(abs(x * x + y * y - 1) < 1e-9 for x, y in centers)
    assert "Sort" not in plan(fitted[0]) and "TakeOrdered" not in plan(fitted[0]) and "Limit" not in plan(fitted[0])
    assert 0 < fitted[0].count() <= len(rows)
    assert cells.trained(given.where("chunk_id = 'inf'"), 600) == []
    placed = {r.chunk_id: r for r in cells.assigned(given, centers).collect()}
    assert placed["inf"].cell == cells.UNASSIGNED and "nan" not in placed and "half" not in placed
    for i in range(100):
        v = np.array(rows[i][2]) / (np.linalg.norm(rows[i][2]) or 1)
        if v.any():
            r = placed[f"c{i:04d}"]
            assert abs(np.cos(r.angle) - max(v @ np.array(centers).T)) < 1e-9 and abs(v @ np.array(centers[r.cell - 1]) - np.cos(r.angle)) < 1e-9
        else:
            assert f"c{i:04d}" not in placed


def test_a_row_hands_over_its_terms_once_and_segments_hold_all_postings(spark, texts, monkeypatch):
    docs = texts.unionByName(spark.createDataFrame([("e#0", "e", ""), ("n#0", "n", None), ("m#0", "m", " ".join(f"w{i % 50} x" for i in range(1000)))], texts.schema)).repartition(2)
    monkeypatch.setattr(index, "SEGMENT", 500)
    made = ingest.posted(docs)
    assert "Generate" not in plan(made) and "Exchange" not in plan(made).split("MapInArrow")[0]
    got = sorted(tuple(r) for r in made.select(F.col("term").alias("t"), F.inline("postings")).collect())
    assert got == sorted(tuple(r) for r in ingest.plain_postings(docs).select("term", "chunk_id", "document_id", "tf", "length").collect())
    blocks = made.collect()
    assert {b.n for b in blocks if b.n != len(b.postings)} == set() and all(b.n <= index.BLOCK for b in blocks)
    assert all(b.max_tf == max(p.tf for p in b.postings) and b.min_length == min(p.length for p in b.postings) for b in blocks)
