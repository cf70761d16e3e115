import random

from pyspark.sql import functions as F

import corpus_pipeline

from .conftest import paragraphs, sentence


def test_stages(spark, tmp_path):
    rng = random.Random(12)
    passage = paragraphs(rng, 4, 16)
    rows, labels = [], []
    for i in range(160):
        text = paragraphs(rng, rng.randrange(3, 9))
        if i % 5 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif i % 5 == 2:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(i % 5 != 1), 0))
    base = sentence(rng, 200).split()
    for i in range(6):  # near copies with an edit in every window of three lines, so that they are left to the join
        # sentences of 16 words: in unmarked text what is equal between two edits would be a passage by itself
        text = " ".join((f"v{i}" if at in (20, 68, 116, 164) else w) + ("." if at % 16 == 15 else "") for at, w in enumerate(base))
        rows.append((200 + i, text, "en", "s1", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = tmp_path / name
        stage(spark, docs, str(tmp_path)).write.parquet(str(out))
        seen[name] = spark.read.parquet(str(out))
        if name != "packing":
            assert seen[name].columns == docs.columns
        docs = seen[name]
    ids = {name: {r.doc_id for r in df.select("doc_id").collect()} for name, df in seen.items()}
    good = {r[0] for r in rows if r[0] >= 200 or r[0] % 5 != 1}
    assert len(ids["quality classifier"] & good) >= 0.97 * len(good) and len(ids["quality classifier"] - good) <= 2
    texts = {r.doc_id: r.text for r in seen["line dedup"].collect()}
    assert sum(passage in t for t in texts.values()) == 1
    assert len({i for i in ids["n-gram Jaccard join"] if i >= 200}) == 1
    assert ids["n-gram Jaccard join"] == ids["mixing"] == ids["packing"]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r.doc_id, r.doc_tokens) for r in whole.collect()) and whole.columns == seen["packing"].columns


def test_an_empty_table_passes_all_stages(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_all_stages(spark, odd, odd_rows, tmp_path):
    """Clashing columns come back from every stage but the last, and nothing crashes."""
    names = ["__row", "__rank", "__key", "__mark", "__text", "__source", "__bucket", "n_removed", "removed", "component_id", "mix_slot"]
    docs = odd.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))) for n in names})
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / str(i)))
        out = spark.read.parquet(str(tmp_path / str(i)))
        rows = out.collect()
        assert len(rows) >= 8
        if name != "packing":
            assert out.columns == docs.columns
            assert all(r[n] == f"{n}{'-' if r.doc_id is None else r.doc_id}" for r in rows for n in names)
            docs = out
