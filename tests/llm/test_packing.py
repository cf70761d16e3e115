import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lorequarry.llm import packing
from lorequarry.llm.packing import TierPacker

from .conftest import paragraphs


def encode(texts):
    rules = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array([*e.ids, 0], "<u4") for e in rules.encode_batch(texts, add_special_tokens=False)]


def check_pieces(rows, wanted, window):
    """wanted: id lists of the documents, by a key; rows: (key, start, length, crc, doc_tokens, sequence, offset)."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for key, start, length, crc, whole, sequence, offset in rows:
        pieces[key].append((start, length))
        sequences[sequence].append((offset, length))
        assert whole == len(wanted[key])
        assert crc == zlib.crc32(wanted[key][start : start + length].tobytes())
    assert pieces.keys() == wanted.keys()
    for key, own in pieces.items():
        at = 0
        for start, length in sorted(own):
            assert start == at and length > 0
            at += length
        assert at == len(wanted[key])
    padding = 0
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_pack_equals_the_tokenizer_and_covers_every_id(spark, odd, odd_rows):
    texts = [(r[0], r[1] or "") for r in odd_rows]
    rows = packing.pack(odd.repartition(3)).collect()
    by_text = defaultdict(list)
    ids = encode([t for _, t in texts])
    for (doc, _), x in zip(texts, ids):
        by_text[doc].append(x)
    unique = {doc: x[0] for doc, x in by_text.items() if len(x) == 1}
    own = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, r.sequence_id, r.offset) for r in rows if r.doc_id in unique]
    check = defaultdict(int)
    for r in rows:
        check[r.doc_id] += r.length
    assert check == {doc: sum(map(len, x)) for doc, x in by_text.items()}
    covered = defaultdict(list)
    for doc, start, length, crc, *_ in own:
        covered[doc].append((start, length))
        assert crc == zlib.crc32(unique[doc][start : start + length].tobytes())
    for doc, spans in covered.items():
        at = 0
        for start, length in sorted(spans):
            assert start == at
            at += length
        assert at == len(unique[doc])


@pytest.mark.parametrize("window,tiers,flush", [(16, 3, 2), (1024, 4, 8), (64, 1, 1)])
def test_packer_pads_the_last_sequence_only(window, tiers, flush):
    rng = random.Random(window)
    packer = TierPacker(window, tiers, flush, group=4)
    wanted = {i: np.arange(rng.choice([1, 2, 5, window // 2, window, window + 1, 3 * window - 1, rng.randrange(1, 4 * window)]), dtype="<u4") for i in range(300)}
    rows = [r for i, ids in wanted.items() for out in packer.add(i, ids) for r in out] + [r for out in packer.finish() for r in out]
    assert check_pieces([r[:7] for r in rows], wanted, window) < window
    total, lengths = sum(map(len, wanted.values())), defaultdict(int)
    for r in rows:
        lengths[r[5], r[7]] += r[2]
    sizes = [window >> i for i in range(tiers)]
    assert all(tier in sizes and n <= tier for (_, tier), n in lengths.items())
    assert sorted(tier - n for (_, tier), n in lengths.items() if n < tier) == ([sizes[-1] - total % sizes[-1]] if total % sizes[-1] else [])
    costs = defaultdict(int)
    for doc, start, length, _, _, sequence, _, tier, step in rows:
        costs[tier, step] += length**2
    held = [r for r in rows]
    sizes = defaultdict(set)
    for r in held:
        sizes[r[7], r[8]].add(r[5])
    assert max(map(len, sizes.values())) <= 4


def test_sequence_numbers_are_unique_over_partitions(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, paragraphs(rng, rng.randrange(1, 60))) for i in range(120)], "doc_id long, text string").repartition(4)
    rows = packing.pack(docs).collect()
    wanted = dict(zip((r.doc_id for r in docs.collect()), encode([r.text for r in docs.collect()])))
    padding = check_pieces([tuple(r)[:7] for r in rows], wanted, 1024)
    assert padding < 4 * 1024


def test_ids_are_those_of_the_tokenizer():
    encode_one = packing.load_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    rng = random.Random(8)
    alphabet = "abc DE\t\n  .,'s'll 0123 é漢字😀\u200b\xa0\x00\u0301<|>"
    texts = ["a<|endoftext|>b", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext", "<|endoftext|>|>", "", "x" * 3000, "=" * 700, paragraphs(rng, 30)]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    for text, ids in zip(texts, encode(texts)):
        assert encode_one(text).tolist() == ids[:-1].tolist()
    assert encode_one("a<|endoftext|>b").tolist() == [64, 50256, 65]


def test_empty_table(none):
    assert packing.pack(none).count() == 0
