import json
import random

import pytest
from pyspark.sql import functions as F

from lorequarry import sources
from lorequarry.config import Chunking, Config, Embedding, Graph, Search, Storage, Upload
from lorequarry.engine import KnowledgeBase
from lorequarry.errors import KnowledgeError
from lorequarry.functions.embedders import HashingEmbedder
from lorequarry.operators import graph, index, search
from lorequarry.schema import SCHEMA_VERSION, TABLES
from lorequarry.store import Store
from lorequarry.streaming import watch

MD = "# PebbleStore\n\nMulti-model database. [HNSW](https://hns.wiki). #database"


def mock(path, **more):
    return Config(storage=Storage(path=str(path)), embedding=Embedding(onnx_path="mock", dimension=8), **more)


@pytest.fixture()
def base(spark, tmp_path):
    return KnowledgeBase(spark, mock(tmp_path / "kb"))


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_upload_states(base):
    first = rows(base.upload(content=["one two three", "one two three", "", MD], title="t", tags=["test"], metadata={"k": "v"}))
    assert [r["status"] for r in first] == ["created", "skipped", "empty", "created"]
    assert first[1]["document_id"] is None and first[2]["document_id"] is None
    assert first[3]["entities"] == ["HNSW", "PebbleStore", "database"] and (first[0]["chunks"], first[0]["tokens"]) == (1, 3)
    assert [r["status"] for r in rows(base.upload(content="one two three"))] == ["skipped"]
    assert [r["status"] for r in rows(base.upload(content="one two three", title="new", force=True))] == ["updated"]
    doc = rows(base.get(first[0]["document_id"], with_chunks=True))[0]
    assert doc["title"] == "new" and doc["chunks"] == [{"idx": 0, "content": "one two three", "token_count": 3}]
    assert base.stats()["document_count"] == 2 and base.table("document").where("get(tags, 0) = 'test' and metadata['k'] = 'v'").count() == 1


def test_search_modes(base):
    base.upload(content=["Apache Arrow is a columnar format", "vector search over embeddings", "keyword search over text, search again"])
    for mode in ("vector", "keyword", "hybrid"):
        assert base.search("search", mode=mode, top_k=5).count() >= 2
    hits = rows(base.search("search", mode="keyword"))
    assert hits[0]["content"].startswith("keyword") and [h["rank"] for h in hits] == [1, 2] and hits[0]["title"] == "inline"
    # every list gives different chunks their own score: nothing collapses
    assert len({h["chunk_id"] for h in rows(base.search("search", mode="hybrid"))}) == 3
    many = rows(base.search(["search", "arrow", "nothing"], mode="keyword"))
    assert {(h["query_id"], h["rank"]) for h in many} == {(0, 1), (0, 2), (1, 1)}


def test_similar_texts_are_near_with_the_hashing_embedder(spark, tmp_path):
    kb = KnowledgeBase(spark, Config(storage=Storage(path=str(tmp_path / "h"))))
    kb.upload(content=["red green blue", "cats and dogs run", "stocks rose sharply"])
    assert rows(kb.search("dogs and cats", mode="vector", top_k=1))[0]["content"] == "cats and dogs run"


def test_filters(base):
    base.upload(content="alpha beta", title="a")
    base.upload(content="alpha gamma", title="b")
    assert [h["title"] for h in rows(base.search("alpha", mode="keyword", filter={"title": "b"}))] == ["b"]
    assert base.search("alpha", mode="keyword", top_k=1, filter={"title": "b"}).count() == 0
    assert base.search("alpha", mode="keyword", top_k=1, filter={"title": "b"}, prefilter=True).count() == 1
    for bad in ({"filter": {"unsupported": "x"}}, {"mode": "magic"}):
        with pytest.raises(KnowledgeError) as e:
            base.search("nothing at all", **bad)
        assert e.value.code == "E_VALIDATION"


def test_graph_expansion(base):
    base.upload(content=["alpha text #shared", "other words #shared", "third one #shared", "unrelated #else"])
    hits = rows(base.search("alpha", mode="keyword", graph_expand=5))
    assert [h["score"] for h in hits[1:]] == [1.0, 1.0] and {h["content"] for h in hits} == {"alpha text #shared", "other words #shared", "third one #shared"}
    assert base.search("alpha", mode="keyword", graph_expand=1).count() <= 2  # the limit may be used up by the hit itself


def test_graph_queries(base):
    for a, b in (("A", "B"), ("B", "C"), ("A", "D"), ("C", "A")):
        base.link_entities(a, b, "related")
    base.link_entities("A", "E", "other", 0.5)
    for name in "ABCDE":
        base.upsert_entity(name, "test")
    nodes, edges = base.graph_query("A", depth=2, limit=10, relation="related")
    assert {(r["id"], r["depth"]) for r in rows(nodes)} == {("entity:A", 0), ("entity:B", 1), ("entity:D", 1), ("entity:C", 2)}
    assert {(r["from"], r["to"], r["relation"]) for r in rows(edges)} == {("entity:A", "entity:B", "related"), ("entity:A", "entity:D", "related"), ("entity:B", "entity:C", "related")}
    assert rows(base.graph_query("entity:A", depth=9)[0])[0]["id"] == "entity:A" and base.graph_query("A", depth=0)[0].count() == 1
    assert base.graph_query("A", depth=5, limit=1)[0].count() == 2
    for start, code in (("thing:x", "E_VALIDATION"), ("⟨⟩", "E_VALIDATION"), ("document:no", "E_DOCUMENT_NOT_FOUND")):
        with pytest.raises(KnowledgeError) as e:
            base.graph_query(start)
        assert e.value.code == code


def test_a_start_may_be_a_name(spark):
    entities = spark.createDataFrame([("k1", "Long name", "x", None), ("k2", "b", "x", None), ("b", "other", "x", None)], "entity_id string, name string, kind string, description string")
    edges = spark.createDataFrame([("k1", "k2", "r", 1.0)], TABLES["related_to"])
    none = [spark.createDataFrame([], TABLES[t]) for t in ("document", "chunk", "mentions")]
    walk = lambda start: {(r["id"], r["name"], r["depth"]) for r in rows(graph.traverse(start, none[0], none[1], entities, none[2], edges)[0])}
    assert walk("Long name") == walk("entity:k1") == {("entity:k1", "Long name", 0), ("entity:k2", "b", 1)}
    assert walk("b") == {("entity:b", "other", 0)}  # an id comes first


def test_graph_from_a_document(base):
    doc = rows(base.upload(content=MD))[0]["document_id"]
    base.link_entities("HNSW", "graph", "uses")
    base.upsert_entity("graph", "topic", "a graph")
    nodes, edges = base.graph_query(f"document:{doc}", depth=2)
    assert {(r["name"], r["kind"], r["depth"]) for r in rows(nodes)} == {("inline", "document", 0), ("HNSW", "reference", 1), ("database", "tag", 1), ("PebbleStore", "section", 1), ("graph", "topic", 2)}
    assert {r["relation"] for r in rows(edges)} == {"mentions", "uses"}
    assert base.graph_query(f"document:{doc}", depth=0)[0].count() == 1


def test_entities_keep_kind_and_description(base):
    base.upsert_entity("HNSW", "index", "a graph index")
    base.upload(content=MD)
    r = rows(base.table("entity").where("entity_id = 'HNSW'"))[0]
    assert (r["kind"], r["description"]) == ("index", "a graph index")
    base.upsert_entity("HNSW", "other", "new")
    r = rows(base.table("entity").where("entity_id = 'HNSW'"))[0]
    assert (r["kind"], r["description"]) == ("index", "new")
    doc = base.list().first().document_id
    assert {r["name"] for r in rows(base.extract_and_save_entities(doc))} == {"HNSW", "database", "PebbleStore"}


def test_list_delete(base):
    for t in ("b", "a", "c"):
        base.upload(content=f"text of {t} #tag{t}", title=t)
    assert [r["title"] for r in rows(base.list(order="title_asc"))] == ["a", "b", "c"]
    assert [r["title"] for r in rows(base.list(1, 1, "title_desc"))] == ["b"] and rows(base.list(order="created_asc"))[0]["chunk_count"] == 1
    for bad in ({"order": "x"}, {"limit": -1}):
        with pytest.raises(KnowledgeError):
            base.list(**bad)
    gone = base.list(order="title_asc").first().document_id
    assert rows(base.delete([gone, "no"])) == [{"document_id": gone, "chunks_deleted": 1}, {"document_id": "no", "chunks_deleted": 0}]
    assert base.stats()["chunk_count"] == 2 and base.table("mentions").count() == 2 and base.table("entity").count() == 3
    with pytest.raises(KnowledgeError) as e:
        base.get(gone)
    assert e.value.code == "E_DOCUMENT_NOT_FOUND"


def test_reindex(spark, base):
    base.upload(content=[MD, " ".join(f"w{i}" for i in range(30))])
    assert base.reindex(dry_run=True) == {"dry_run": True, "documents_processed": 2, "chunks_created": 2, "tokens_total": 36, "entities_extracted": 3}
    other = mock(base.config.storage.path, chunking=Chunking(10, 2))
    done = KnowledgeBase(spark, other).reindex()
    assert done["chunks_created"] == 5 and done["documents_processed"] == 2 and base.stats()["chunk_count"] == 5


def test_an_interrupted_reindex_goes_on_where_it_stopped(spark, base):
    texts = [" ".join(f"d{i}w{j}" for j in range(20 + i)) for i in range(12)]
    base.upload(content=texts)
    config, told = mock(base.config.storage.path, chunking=Chunking(10, 2)), []

    def stop(stage, numbers):
        told.append((stage, numbers))
        if [s for s, _ in told].count("chunks") == 2:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        KnowledgeBase(spark, config, progress=stop).reindex(batch_rows=3)
    kept = base.store.finished("reindex/*/*/chunks")
    done = {r[0] for r in spark.read.schema(TABLES["chunk"]).parquet(*kept).select("document_id").distinct().collect()}
    # searches see the old chunks until the commit
    assert len(kept) == 2 and 0 < len(done) < 12 and base.stats()["chunk_count"] == 12
    # one of the kept ones goes, and a new one comes, before it is taken up
    base.delete(min(done))
    base.upload(content="a new text " * 8)
    told.clear()
    again = KnowledgeBase(spark, config, progress=lambda stage, n: told.append((stage, n)))
    assert again.reindex(batch_rows=3)["documents_processed"] == 12
    fresh = KnowledgeBase(spark, mock(base.config.storage.path + "_fresh", chunking=Chunking(10, 2)))
    fresh.upload(content=[r["content"] for r in base.table("document").collect()])
    names = ["document_id", "idx", "content", "token_count", "heading", "embedding", "terms", "start", "made"]
    seen = lambda kb: sorted(map(str, rows(kb.table("chunk").select(*names))))
    assert seen(again) == seen(fresh)
    for name in ("posting", "mentions", "vector"):
        assert again.table(name).count() == fresh.table(name).count()
    # what was kept wasn't made again
    made = sum(n["rows"] for stage, n in told if stage == "chunks")
    assert made == again.table("chunk").where(~F.col("document_id").isin([*done])).count()
    assert not base.store.finished("reindex/*/*/chunks")


def test_a_reindex_that_goes_on_writes_only_what_was_kept_again(spark, base):
    texts = [" ".join(f"d{i}w{j}" for j in range(20 + i)) for i in range(12)]
    base.upload(content=texts)
    config, told = mock(base.config.storage.path, chunking=Chunking(10, 2)), []

    def stop(stage, numbers):
        if stage == "chunks":
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        KnowledgeBase(spark, config, progress=stop).reindex(batch_rows=3)
    kept = spark.read.schema(TABLES["chunk"]).parquet(*base.store.finished("reindex/*/*/chunks"))
    done = sorted({r[0] for r in kept.select("document_id").distinct().collect()})
    base.delete(done[0])
    left = kept.where(F.col("document_id") != done[0]).count()
    again = KnowledgeBase(spark, config, progress=lambda stage, n: told.append((stage, n)))
    assert again.reindex(batch_rows=3)["documents_processed"] == 11
    assert dict(told)["taken"]["rows"] == left and left + sum(n["rows"] for stage, n in told if stage == "chunks") == again.table("chunk").count()
    terms = again.table("posting").groupBy("document_id").agg(F.sum("tf").alias("n"))
    assert {r.document_id for r in terms.collect()} == {r.document_id for r in again.table("document").collect()}


def test_a_stale_only_reindex_makes_what_was_made_otherwise(spark, base):
    base.upload(content=[" ".join(f"a{j}" for j in range(30)), MD])
    told = []
    other = KnowledgeBase(spark, mock(base.config.storage.path, chunking=Chunking(10, 2)), progress=lambda stage, n: told.append((stage, n)))
    other.upload(content=" ".join(f"b{j}" for j in range(30)))
    told.clear()
    assert other.reindex(stale_only=True)["documents_processed"] == 3
    counts = {r["c"] for r in other.table("chunk").groupBy("document_id").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert dict(told)["chunks"]["rows"] == 5 and counts == {4, 1} and dict(told)["taken"]["rows"] == 9
    version = other.store.pointer()["version"]
    told.clear()
    assert other.reindex(stale_only=True)["chunks_created"] == 9 and not told and other.store.pointer()["version"] == version
    assert other.search("b7", mode="keyword").count() >= 1


def test_shares_of_documents_are_whole_and_read_their_folders_only(base):
    base.upload(content=[f"text {i}" for i in range(9)])
    now = base.store.pointer()
    shares = [base.store.filed(now, i, 4) for i in range(4)]
    ids = [r["document_id"] for s in shares for r in s.collect()]
    assert sorted(ids) == sorted(r["document_id"] for r in base.table("document").collect())
    assert "PartitionFilters: [(pmod(xxhash64(prefix" in shares[0]._jdf.queryExecution().executedPlan().toString()


def test_progress_tells_the_rows_of_each_stage_without_jobs_of_its_own(spark, tmp_path):
    told = []
    kb = KnowledgeBase(spark, mock(tmp_path / "told"), progress=lambda stage, n: told.append((stage, n)))
    quiet = KnowledgeBase(spark, mock(tmp_path / "quiet"))
    tracker = spark.sparkContext.statusTracker()

    def jobs(name, base, **given):
        spark.sparkContext.setJobGroup(name, name)
        try:
            base.upload(**given)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(tracker.getJobIdsForGroup(name))

    given = {"content": ["one two three", "one two three", "", MD]}
    assert jobs("told", kb, **given) == jobs("quiet", quiet, **given)
    tokens = kb.table("chunk").agg(F.sum("token_count")).first()[0]
    stages = dict(told)
    assert [stage for stage, _ in told] == ["rows", "marked", "chunks", "found", "committed"]
    assert stages["rows"] == {"rows": 4, "failed": 0} and stages["marked"] == {"rows": 3, "known": 0}
    assert stages["chunks"] == {"rows": 2, "tokens": tokens} and stages["found"]["rows"] >= 3
    assert stages["committed"] == {"version": kb.store.pointer()["version"]}
    told.clear()
    kb.upload(content=["one two three", "four"])
    assert dict(told)["marked"] == {"rows": 2, "known": 1} and dict(told)["chunks"] == {"rows": 1, "tokens": 1}
    told.clear()
    kb.reindex()
    assert [stage for stage, _ in told] == ["chunks", "found", "committed"] and dict(told)["chunks"]["rows"] == 3


def test_a_mismatched_store_can_be_reindexed(spark, base):
    base.upload(content="some text here")
    hashing = HashingEmbedder(32)
    with pytest.raises(KnowledgeError) as e:
        KnowledgeBase(spark, base.config, embedder=hashing)
    assert e.value.code == "E_MODEL_MISMATCH"
    KnowledgeBase(spark, base.config, embedder=hashing, check_model=False).reindex()
    again = KnowledgeBase(spark, base.config, embedder=hashing)
    assert again.table("chunk").where(F.size("embedding") != 32).count() == 0 and "32" in again.doctor()[2]


def test_commits_are_whole_and_seen(base):
    before = base.store.pointer()
    old = base.table("document")
    base.upload(content="x y z")
    with pytest.raises(KnowledgeError):
        base.store.commit({"document": old}, since=before["version"])
    assert base.stats()["document_count"] == 1
    with pytest.raises(Exception):
        base.store.commit({"document": old.withColumn("title", F.raise_error(F.lit("no")).cast("string")).unionByName(base.table("document").withColumn("title", F.raise_error(F.lit("no")).cast("string")))})
    assert base.stats()["document_count"] == 1


def test_sql_over_views(spark, base):
    base.upload(content="x y z")
    base.create_views()
    assert spark.sql("SELECT count(*) AS n FROM document JOIN chunk USING (document_id)").first().n == 1


def test_sources(spark, tmp_path):
    d = tmp_path / "in"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# A <b>kept</b>")
    (d / "b.html").write_text("<p>B</p>  text")
    (d / "sub" / "c.txt").write_text("C")
    c = mock(tmp_path / "kb2", upload=Upload(allowed_dirs=(str(d),)))
    got = {r["title"]: r for r in rows(sources.extracted(sources.from_files(spark, str(d), c, recursive=True)))}
    assert set(got) == {"a.md", "b.html", "c.txt"}
    assert (got["b.html"]["content"], got["b.html"]["mime"], got["a.md"]["content"]) == ("B text", "text/html", "# A <b>kept</b>")
    assert got["a.md"]["source"] == str(d / "a.md") and got["a.md"]["source_type"] == "file"
    with pytest.raises(KnowledgeError) as e:
        sources.from_files(spark, "/etc/hostname", c)
    assert e.value.code == "E_VALIDATION"
    (d / "x.pdf").write_bytes(b"%PDF")
    with pytest.raises(Exception, match="E_UNSUPPORTED_FORMAT"):
        sources.raised(sources.from_files(spark, str(d / "x.pdf"), c)).collect()
    (d / "bad.txt").write_bytes(b"\xff\xfe")
    with pytest.raises(Exception, match="E_IO"):
        sources.raised(sources.from_files(spark, str(d / "bad.txt"), c)).collect()
    with pytest.raises(KnowledgeError):
        sources.from_urls(spark, ["ftp://x/y"], c)
    with pytest.raises(KnowledgeError):
        sources.from_request(spark, c)
    assert rows(sources.from_request(spark, c, content="c", content_base64="eA=="))[0]["raw"] == "c"
    assert rows(sources.from_request(spark, c, content_base64="aGVs bG8="))[0]["raw"] == "hello"
    with pytest.raises(Exception, match="E_VALIDATION"):
        sources.raised(sources.from_base64(spark, ["%%"])).collect()


def test_inbox(spark, base, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(2):
        (inbox / f"n{i}.txt").write_text(f"note number {i}")
        watch(base, str(inbox), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert base.stats()["document_count"] == 2


def test_defaults_come_from_the_configuration(spark, tmp_path):
    kb = KnowledgeBase(spark, mock(tmp_path / "s", search=Search(default_mode="keyword", top_k=1)))
    kb.upload(content=["same word", "word same too"])
    assert kb.search("word").count() == 1


def test_of_two_writers_one_wins(spark, base):
    """Both have read the same version; the second to log its commit fails, and what it wrote is never read."""
    first, second = Store(spark, base.config.storage.path), Store(spark, base.config.storage.path)
    version = first.pointer()["version"]
    edge = lambda dst: graph.link(spark.createDataFrame([], TABLES["related_to"]), "a", dst, "r")
    late = second._written(second.pointer(), version + 1, {"related_to": edge("late")}, {}, None)
    assert first.commit({"related_to": edge("early")}, since=version) == version + 1
    assert not second._logged(late)
    with pytest.raises(KnowledgeError) as e:
        second.commit({"related_to": edge("late")}, since=version)
    assert e.value.code == "E_DB" and [r["dst"] for r in rows(base.table("related_to"))] == ["early"]
    # one that doesn't hang on what was read comes after
    assert second.commit({"related_to": edge("third")}) == version + 2
    assert {r["dst"] for r in rows(base.table("related_to"))} == {"early", "third"}


def test_writers_at_the_same_time(spark, base):
    from concurrent.futures import ThreadPoolExecutor

    def one(i):
        base.link_entities("A", f"n{i}", "r")

    with ThreadPoolExecutor(3) as pool:
        list(pool.map(one, range(3)))
    assert {r["dst"] for r in rows(base.table("related_to"))} == {"n0", "n1", "n2"} and base.store.pointer()["version"] == 4


def test_an_upload_writes_no_old_row(spark, base):
    base.upload(content=[f"old text number {i}" for i in range(50)])
    before = base.store.pointer()
    base.upload(content="one more text")
    after = base.store.pointer()
    for name in ("document", "chunk", "mentions", "posting"):
        assert after["tables"][name][:-1] == before["tables"][name]
        new = spark.read.schema(TABLES[name]).parquet(f"{base.store.path}/{after['tables'][name][-1]}")
        assert new.count() == {"document": 1, "chunk": 1, "mentions": 0, "posting": 3}[name]
    gone = base.list(1).first().document_id
    base.delete(gone)
    assert base.store.pointer()["tables"] == after["tables"] and base.stats()["document_count"] == 50
    base.compact()
    assert all(len(p) == 1 for p in base.store.pointer()["tables"].values()) and base.store.pointer()["deleted"] == []
    assert base.stats()["document_count"] == 50 and base.search("number", mode="keyword", top_k=100).count() >= 49
    assert [r["status"] for r in rows(base.upload(content="old text number 3"))] == ["skipped"]


def test_deleted_documents_can_come_back(base):
    doc = rows(base.upload(content="here and gone"))[0]["document_id"]
    base.delete(doc)
    assert base.search("gone", mode="keyword").count() == 0 and base.search("gone", mode="vector").count() == 0
    assert rows(base.upload(content="here and gone"))[0]["status"] == "created"
    assert base.search("gone", mode="keyword").count() == 1


def test_stored_postings_give_what_a_scan_gives(base):
    rng = random.Random(5)
    words = ["w" + "abcdefghijklmnopqrstuvwxyzäöüé"[i] for i in range(30)]
    base.upload(content=[" ".join(rng.choices(words, range(1, 31), k=rng.randrange(1, 40))) for _ in range(60)])
    base.delete(base.list(1).first().document_id)
    asked = [["wa"], ["wz", "wä"], ["wf", "wy"], ["nothing"]]
    queries = base.spark.createDataFrame([(i, t) for i, ts in enumerate(asked) for t in ts], "query_id long, term string")
    chunks = base.table("chunk")
    scan = {tuple(r) for r in search.top_k(index.keyword_scores(chunks, queries), 100).collect()}
    kept = {tuple(r) for r in search.top_k(index.stored_scores(base.table("posting"), chunks.select("terms"), queries), 100).collect()}
    assert scan == kept and len(scan) > 30


def test_failed_files_are_reported_and_the_others_stored(spark, base, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "a.txt").write_text("a good file")
    (d / "b.txt").write_bytes(b"\xff\xfe\xfa")
    (d / "c.pdf").write_bytes(b"%PDF-1.4 text")
    done = {r["title"]: r for r in rows(base.upload(path=str(d)))}
    assert {t: r["status"] for t, r in done.items()} == {"a.txt": "created", "b.txt": "failed", "c.pdf": "failed"}
    assert done["b.txt"]["error"].startswith("E_IO") and done["c.pdf"]["error"].startswith("E_UNSUPPORTED_FORMAT")
    assert base.stats()["document_count"] == 1 and base.table("failure").count() == 2
    with pytest.raises(KnowledgeError) as e:
        base.upload(path=str(d / "c.pdf"))
    assert e.value.code == "E_UNSUPPORTED_FORMAT"
    some = rows(base.upload(content_base64=["eA==", "%%"]))
    assert [r["status"] for r in some] == ["created", "failed"]
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "x.bin").write_bytes(b"\xff")
    (inbox / "y.txt").write_text("fine and new")
    watch(base, str(inbox), str(tmp_path / "cp"), once=True).awaitTermination(60)
    assert base.stats()["document_count"] == 3 and base.table("failure").where("source like '%x.bin'").count() == 1


def test_a_reader_for_another_format_plugs_in(base, tmp_path, monkeypatch):
    monkeypatch.setitem(sources.READERS, "pdf", lambda data: data.removeprefix(b"%PDF").decode())
    (tmp_path / "good.pdf").write_bytes(b"%PDFtext of it")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    done = {r["title"]: r["status"] for r in rows(base.upload(path=[str(tmp_path / "good.pdf"), str(tmp_path / "bad.pdf")]))}
    assert done == {"good.pdf": "created", "bad.pdf": "failed"}
    assert base.search("text", mode="keyword").first().content == "text of it"


def test_hits_tell_where_and_why(base):
    base.upload(content=["the Alpha text is long and has alpha twice #shared", "other words #shared #more"])
    hits = rows(base.search("alpha", mode="keyword", graph_expand=5))
    assert len(hits[0]["highlights"]) >= 1 and "Alpha" in hits[0]["highlights"][0] and hits[0]["matched_entities"] == []
    assert hits[1]["matched_entities"] == ["shared"] and hits[1]["highlights"] == []


def test_a_store_of_the_first_schema_is_migrated(spark, tmp_path):
    """Whole tables in v=N/, and a pointer CURRENT."""
    path = tmp_path / "old"
    new = KnowledgeBase(spark, mock(tmp_path / "new"))
    new.upload(content=["alpha beta", MD])
    for name in ("document", "chunk", "entity", "mentions", "related_to"):
        new.table(name).drop("terms").write.parquet(f"{path}/v=3/{name}")
    spark.createDataFrame([("schema_version", "1"), ("embedding_model", "mock"), ("embedding_dimension", "8"), ("tokenizer", "whitespace")], TABLES["meta"]).write.parquet(f"{path}/v=3/meta")
    (path / "CURRENT").write_text(json.dumps({"version": 3, "tables": {t: f"v=3/{t}" for t in ("document", "chunk", "entity", "mentions", "related_to", "meta")}}))
    kb = KnowledgeBase(spark, mock(path))
    assert kb.store.pointer()["version"] == 4 and kb.store.meta()["schema_version"] == SCHEMA_VERSION
    assert kb.stats()["document_count"] == 2 and kb.search("alpha", mode="keyword").count() == 1 and kb.table("entity").count() == 3
    assert not KnowledgeBase(spark, mock(path)).migrate() and kb.store.pointer()["version"] == 4


def test_extended_rules(spark, tmp_path):
    kb = KnowledgeBase(spark, mock(tmp_path / "x", graph=Graph(extended=True)))
    text = "---\ntags: [one, 'two']\naliases:\n  - Other Name\n  - \"Third\"\n---\n# Top\n\n## Middle A\n\nSee [[Wiki Page]] and [[Page|shown]] and [link](x).\n\n#### Deep\n\n## Middle B\n"
    done = rows(kb.upload(content=text))[0]
    assert {"Wiki Page", "Page", "link", "one", "two", "Other Name", "Third", "Top"} <= set(done["entities"])
    kinds = {r["name"]: r["kind"] for r in rows(kb.table("entity"))}
    assert (kinds["one"], kinds["Other Name"], kinds["Wiki Page"], kinds["Top"]) == ("tag", "alias", "reference", "section")
    edges = {(r["src"], r["dst"]) for r in rows(kb.table("related_to").where("relation = 'part-of'"))}
    assert edges == {("Middle A", "Top"), ("Deep", "Middle A"), ("Middle B", "Top")}
    plain = KnowledgeBase(spark, mock(tmp_path / "y"))
    assert set(rows(plain.upload(content=text))[0]["entities"]) == {"link", "Top", "Middle A", "Deep", "Middle B"}
