import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorequarry.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rules():
    return Tokenizer.from_file(PATH)


def count(rules, text):
    return len(rules.encode(text or "", add_special_tokens=False).ids)


def test_counts_equal_the_library_on_whole_texts(spark, odd, odd_rows, rules):
    rows = token_counts.count_tokens(odd, limit=30).collect()
    got = sorted((str(r.doc_id), str(r.text), r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    assert got == sorted((str(r[0]), str(r[1]), len((r[1] or "").encode()), n := count(rules, r[1]), n > 30) for r in odd_rows)
    assert rows[0].asDict().keys() == {*odd.columns, "n_bytes", "n_tokens", "over_limit"}


def test_special_strings_are_the_library_s(spark, rules):
    texts = ["a <|endoftext|> b", "<|endoftext|>" * 3, "<|endof text|>", "x" * 70_000 + "<|endoftext|> y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs).collect()}
    assert got == {i: count(rules, t) for i, t in enumerate(texts)} and got[1] == 3


def test_pieces_make_up_the_text_and_add_up(rules):
    rng = random.Random(3)
    parts = ["word", "Word's", "it's", "12", "x1y", "漢字", "é", "é", "😀", "...", "--", "<|endoftext|>", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\x85", "\xa0", " ", "᠎", "​", "'", "'s", "_"]
    measure, cut = token_counts.load_lengths(PATH)
    assert cut
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 80)))
        for size in (1, 7, 40):
            cut_up = token_counts.pieces(text, size)
            assert "".join(cut_up) == text
            assert sum(measure(cut_up)) == count(rules, text), (text, cut_up)
    assert {len(p) for p in token_counts.pieces("ab " * 1000, 30)[:-1]} <= {30, 31, 32}
    assert token_counts.pieces("a" * 1000, 10) == ["a" * 1000]


def test_batches_hold_about_as_many_bytes():
    sizes = []

    def measure(texts):
        sizes.append(sum(len(t.encode()) for t in texts))
        return [len(t.split()) for t in texts]

    texts = ["ab cd " * 50_000, "é", "", *["x y" * 30] * 500]
    found = token_counts.lengths_of(iter(texts), measure, True, piece=1000, batch_bytes=10_000)
    assert list(found) == [len(t.split()) for t in texts]
    assert max(sizes) < 12_000 and min(sizes[:-1]) >= 10_000


def test_other_tokenizers_take_texts_whole(spark):
    import sentencepiece

    words, pieces = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    texts = ["The  cat\nsat ", None, "", "Ünï code 漢字 <s> </s>", "one two  three " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    other, model = Tokenizer.from_file(words), sentencepiece.SentencePieceProcessor(model_file=pieces)
    assert not token_counts.load_lengths(words)[1] and not token_counts.load_lengths(pieces)[1]
    of = lambda path: {r.doc_id: r.n_tokens for r in token_counts.count_tokens(docs, tokenizer_path=path).collect()}
    assert of(words) == {i: count(other, t) for i, t in enumerate(texts)}
    assert of(pieces) == {i: len(model.encode(t or "")) for i, t in enumerate(texts)}


def test_query_equals_the_library(spark, rules):
    from lorequarry.llm import queries

    d = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = queries.op11_token_counts(spark, d).collect()
    assert sorted(map(tuple, got)) == sorted((i, len(t.encode()), n := count(rules, t), n > 1024) for i, t in texts.items())


def test_empty_table_and_clashing_names(none, spark):
    assert token_counts.count_tokens(none).count() == 0
    docs = spark.createDataFrame([(1, "a b", 9, "k", "v")], "doc_id long, text string, N_Tokens int, `a.b` string, over_limit string")
    row = token_counts.count_tokens(docs).first().asDict()
    assert row == {"doc_id": 1, "text": "a b", "a.b": "k", "n_bytes": 3, "n_tokens": 2, "over_limit": False}
