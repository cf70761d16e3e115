"""Token counts of whole texts: batches are encoded in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a piece of a long text, about; a piece ends at the first safe boundary from there on.
PIECE = 1 << 16
#: Bytes that are encoded at once, about: a batch is closed when it has so many.
BATCH_BYTES = 1 << 20
#: A safe boundary: a byte-level pattern never joins a character that isn't white space to white space after it, and
#: goes on from the white space as it would at the start of a text.
BOUNDARY = r"(?<=[^\s\x1c-\x1f\x85᠎])[ \t\n\r]"


def may_split(rules: dict) -> bool:
    """Whether texts may be cut at BOUNDARY for a tokenizer.json: with the byte-level pattern and nothing before it that
    changes the text, and no added token that holds or takes in white space."""
    before = rules.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    tokens = [t for t in rules["added_tokens"] if t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"])]
    return bool(plain) and rules.get("normalizer") is None and not tokens


def pieces(text: str, size: int = PIECE) -> list[str]:
    """text in pieces that end at safe boundaries, each the first one from `size` characters on; a stretch without any stays whole."""
    import re

    safe, out, start = re.compile(BOUNDARY), [], 0
    while len(text) - start > size and (found := safe.search(text, start + size)):
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


def load_lengths(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """A function from texts to their numbers of tokens by the library of the file, and whether texts may be cut.

    No tokens are added and nothing is cut off or filled up; strings of special tokens are handled as by default.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)], False
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    rules = Tokenizer.from_file(path)
    rules.no_truncation()
    rules.no_padding()
    with open(path, encoding="utf-8") as f:
        cut = may_split(json.load(f))
    return lambda texts: [len(x) for x in rules.encode_batch_fast(texts, add_special_tokens=False)], cut


def lengths_of(texts: Iterator[str], measure: Callable[[list[str]], list[int]], cut: bool, piece: int = PIECE, batch_bytes: int = BATCH_BYTES) -> list[int]:
    """The number of tokens of each text. Pieces go to measure() in batches of about as many bytes each."""
    import numpy as np

    owners, found, held, size, n = [], [], [], 0, 0
    for n, text in enumerate(texts, 1):
        for part in pieces(text, piece) if cut else [text]:
            owners.append(n - 1)
            held.append(part)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= batch_bytes:
                found += measure(held)
                held, size = [], 0
    if held:
        found += measure(held)
    return np.bincount(np.asarray(owners, np.int64), np.asarray(found, np.int64), minlength=n).astype(np.int64)


def token_count(text: Column, tokenizer_path: str, piece: int = PIECE, batch_bytes: int = BATCH_BYTES) -> Column:
    """The number of tokens of a text (long); a null one is empty. The tokenizer is read once for a task.

    Of texts that are equal within an Arrow batch one is encoded.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        measure, cut = load_lengths(tokenizer_path)
        for batch in batches:
            coded = batch.dictionary_encode()
            counts = lengths_of((t.as_py() for t in coded.dictionary), measure, cut, piece, batch_bytes)
            yield pa.array(counts, pa.int64()).take(coded.indices)

    # bytes that aren't valid UTF-8 can't reach Python as text; they count as the replacement character
    return F.arrow_udf(run, "long")(F.make_valid_utf8(F.coalesce(text, F.lit(""))))


def count_tokens(docs: DataFrame, limit: int = 1024, tokenizer_path: str | None = None) -> DataFrame:
    """docs with n_bytes (of the text in UTF-8), n_tokens and over_limit (n_tokens > limit) added.

    The tokenizer is a tokenizer.json or a sentencepiece .model that every executor can read, by default
    byte_bpe_50k.json. Its own library encodes, without begin, end or other added tokens; the string of a special token
    within a text is what that library takes it for by default. Nothing is cut off: every whole text counts.

    Long texts are encoded in pieces that end before white space after another character, where the byte-level pattern
    always ends a token too, so the sum is the whole text's count (tests compare them); with other tokenizers, whose
    rules may look across such a place, texts aren't cut. Batches hold about as many bytes each, whatever the lengths
    of the texts. Nothing is shuffled, and the only thing that comes back from Python is one number for each row.

    Null text: as an empty one, no bytes and no tokens. Null doc_id: kept. Equal rows are counted each. An empty table
    gives an empty one. Further columns stay, but for the three added names, which are replaced.
    """
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("byte_bpe_50k.json")
    added = ("n_bytes", "n_tokens", "over_limit")
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in added]
    n_bytes = F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long")
    counted = docs.select(*kept, n_bytes.alias("n_bytes"), token_count(F.col("text"), tokenizer_path).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
