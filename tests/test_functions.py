import pytest
from pyspark.sql import functions as F

from lorequarry.errors import KnowledgeError
from lorequarry.functions import text, vectors
from lorequarry.functions.embedders import FileTokenizer, HashingEmbedder, MockEmbedder


def value(spark, expression, **columns):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()])
    return df.select(expression.alias("v")).first().v


@pytest.mark.parametrize(
    "html,expected",
    [("a<b>c > d", "ac d"), ("x <unclosed rest", "x "), ("<p>a</p>\n\t <p>b</p>", "a b"), ("&amp;", "&amp;"), ("", ""), ("a  b", "a b"), ("<a<b>c>d", "cd")],
)
def test_html(spark, html, expected):
    assert value(spark, text.html_to_text(F.col("h")), h=html) == expected


@pytest.mark.parametrize(
    "source,kept", [("x.html", False), ("x.HTM", False), ("x.md", True), ("markdown/x.html", True), ("x.html?p", True), ("x.txt", True), ("a.markdown", True)]
)
def test_extraction_goes_by_source(spark, source, kept):
    out = value(spark, text.extract_text(F.col("c"), F.col("s")), c="<b>x</b>", s=source)
    assert out == ("<b>x</b>" if kept else "x")


@pytest.mark.parametrize(
    "name,mime",
    [("a.md", "text/markdown"), ("A.MARKDOWN", "text/markdown"), ("dir.txt/file", None), (".html", None), ("x.html?page=2", None), ("a.b.rs", "text/x-rust"), ("x.docx", None), ("x.", None), ("d/x.yml", "application/x-yaml")],
)
def test_mime(spark, name, mime):
    assert value(spark, text.mime_of(F.col("n")), n=name) == mime


@pytest.mark.parametrize("encoded,decoded", [("aGVs\nbG8=", "hello"), ("!!!", None), ("/w==", None), ("", "")])
def test_base64(spark, encoded, decoded):
    assert value(spark, text.decode_base64(F.col("b")), b=encoded) == decoded


def windows_by_loop(words, m, o):
    out, start = [], 0
    while start < len(words):
        end = min(start + m, len(words))
        out.append((len(out), " ".join(words[start:end]), end - start))
        if end == len(words):
            break
        start += m - o
    return out


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 7, 8, 30])
@pytest.mark.parametrize("m,o", [(4, 0), (4, 1), (4, 3), (1, 0)])
def test_windows(spark, n, m, o):
    words = [f"w{i}" for i in range(n)]
    got = value(spark, text.windows(text.whitespace_tokens(F.col("t")), m, o), t="  " + " ".join(words) + " \n")
    assert [tuple(r) for r in got] == windows_by_loop(words, m, o)
    assert value(spark, text.window_count(F.col("n"), m, o), n=n) == len(got)


@pytest.mark.parametrize("m,o", [(0, 0), (4, 4), (4, 5), (4, -1)])
def test_windows_must_move_on(m, o):
    with pytest.raises(KnowledgeError) as e:
        text.window_count(F.lit(1), m, o)
    assert e.value.code == "E_VALIDATION"


def test_inner_space_is_kept(spark):
    got = value(spark, text.windows(text.whitespace_tokens(F.col("t")), 2, 0), t="a \n b  c\td ")
    assert [r.content for r in got] == ["a \n b", "c\td"]


def test_file_tokenizer_cuts_at_offsets(spark):
    import public_tokenizers

    df = spark.createDataFrame([("Hello wide world, again and again",), ("",), (None,)], "c string")
    rows = df.select(FileTokenizer(public_tokenizers.path("byte_bpe_50k.json")).chunks(F.col("c"), 3, 1).alias("v")).collect()
    assert rows[0].v[0].token_count == 3 and rows[0].v[0].content.startswith("Hello") and rows[1].v == rows[2].v == []
    assert [c.idx for c in rows[0].v] == list(range(len(rows[0].v)))


def test_entities(spark):
    md = "# PebbleStore\n\nMulti-model database. [HNSW](https://hns.wiki). #database"
    got = [tuple(r) for r in value(spark, text.entities(F.col("c")), c=md)]
    assert got == [("HNSW", "reference"), ("database", "tag"), ("PebbleStore", "section")]


@pytest.mark.parametrize(
    "md,expected",
    [("#a", []), ("#ab-c", [("ab-c", "tag")]), ("x#tag", []), ("## x", []), ("## xyz ", [("xyz", "section")]), ("###\nnext", [("next", "section")]), ("# é1", [("é1", "section")]), ("# line on", [("line on", "section")]), ("[⟨⟩](x)", []), ("[](x) [a]()", [])],
)
def test_entity_rules(spark, md, expected):
    assert [tuple(r) for r in value(spark, text.entities(F.col("c")), c=md)] == expected


def test_analyzer(spark):
    assert value(spark, text.analyzed(F.col("c")), c="BM25, 日本語 x_y Ünï") == ["bm", "25", "日本語", "x", "y", "ünï"]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0])], "a array<float>, z array<float>, s array<float>")
    r = df.select(vectors.l2_normalize("a").alias("n"), vectors.l2_normalize("z").alias("zn"), vectors.cosine(F.col("a"), F.col("a")).alias("one"), vectors.cosine(F.col("a"), F.col("z")).alias("none"), vectors.cosine(F.col("a"), F.col("s")).alias("other")).first()
    assert r.n == [0.6, 0.8] and r.zn == [0.0, 0.0] and abs(r.one - 1) < 1e-12 and r.none is None and r.other is None


def test_embedders(spark):
    df = spark.createDataFrame([(0, "alpha beta"), (9, "beta alpha"), (33, ""), (1, None)], "i long, c string")
    rows = df.select(MockEmbedder(8, 32).embed(F.col("c"), F.col("i")).alias("m"), HashingEmbedder(16).embed(F.col("c"), F.col("i")).alias("h")).collect()
    assert [r.m.index(1.0) for r in rows] == [0, 1, 1, 1]
    assert rows[0].h == rows[1].h and abs(sum(x * x for x in rows[0].h) - 1) < 1e-6 and not any(rows[2].h) and not any(rows[3].h)


def test_a_tokenizer_file_takes_few_texts_at_once(spark, monkeypatch):
    """Before, a whole Arrow batch of texts was encoded at once, and all that the library holds for its tokens kept."""
    import public_tokenizers

    from lorequarry.functions import embedders

    monkeypatch.setattr(embedders, "AT_ONCE", 40)
    assert [len(x) for x in embedders.parted(["a" * 30] * 5 + ["b" * 100])] == [2, 2, 2]
    texts = ["", None, "one two three", "x" * 200, "Ünï – 中文 <|endoftext|> end", *["word " * i for i in range(30)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").coalesce(1)
    rules = FileTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    rows = df.select("i", rules.encode(F.col("c")).alias("ids"), rules.chunks(F.col("c"), 7, 2).alias("w")).select("*", rules.decode(F.col("ids")).alias("t")).orderBy("i").collect()
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for row, text in zip(rows, texts):
        assert row.t == text and row.ids == (None if text is None else own.encode(text, add_special_tokens=False).ids)
        assert sum(w.token_count for w in row.w) - 2 * max(0, len(row.w) - 1) == len(row.ids or [])


def test_texts_without_the_marks_of_links_and_headings_are_not_searched_for_them(spark):
    """What is found is that of the rules alone, also in texts that hold a mark without a match, and in null ones."""
    given = ["", None, "no mark", "# A\nx [b](c) #tag", "a](b [c] (d)", "#", "# ", "#1 x\n##  B ", "[a](b)", "x#y", "[x]\n(y) #z"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")

    def found():
        made = rows.select("i", text.entities(F.col("t")).alias("e"), text.heading_paths(F.col("t")).alias("h"))
        return [tuple(map(str, r)) for r in made.orderBy("i").collect()], made._jdf.queryExecution().optimizedPlan().toString()

    got, plan = found()
    assert "contains(t" in plan.lower()
    keep, text.with_mark = text.with_mark, lambda t, mark, found, kind: found
    try:
        want, _ = found()
    finally:
        text.with_mark = keep
    assert got == want and len({r[1] for r in got}) == 4


def test_terms_and_tokens_are_runs_of_letters_digits_and_others(spark):
    import re

    given = ["Ab1c2 d_E", "été ÉTÉ x٣٤½y", "a b c  d\te\n", "", "İstanbul ΣΑΣ", "９９ａｂ", "ab" * 3000 + "1" * 3000]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string")
    plain = lambda t, rule: F.regexp_extract_all(t, F.lit(rule), F.lit(0))
    made = rows.select("t", text.analyzed(F.col("t")).alias("a"), plain(F.lower("t"), r"\p{L}+|\p{N}+").alias("pa"), text.whitespace_tokens(F.col("t")).alias("w"), plain(F.col("t"), r"\S+\s*").alias("pw"))
    for r in made.collect():
        assert list(r.a) == list(r.pa) and list(r.w) == list(r.pw) == re.findall(r"[^ \t\n\x0b\f\r]+[ \t\n\x0b\f\r]*", r.t)
