"""Hierarchical multi-length packing of tokenised documents."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


class TierPacker:
    """Packs a stream of documents; holds at most the pieces of one flush.

    A document gives whole windows of the longest size, and a rest that is routed to the shortest tier that can hold
    it. At a flush the tiers are packed from the longest: each piece opens a window, whose gap is filled with the
    longest fitting pieces of the shorter tiers, and at last with a cut from the next piece, so the window is full.
    What is left at the end is split at the tiers' sizes; only the very last sequence, of less than the shortest tier,
    is to be padded. Sequences of a flush are dealt to step groups of one tier in turns of falling and rising
    attention cost.
    """

    def __init__(self, window: int = 1024, tiers: int = 4, flush_windows: int = 256, group: int = 8, first: int = 0):
        self.sizes = [window >> i for i in range(tiers)]  # longest first
        self.window, self.flush_windows, self.group = window, flush_windows, group
        self.pools: list[list[tuple]] = [[] for _ in self.sizes]  # of (length, number, doc, start, ids, doc length)
        self.held = self.number = 0
        self.sequence = self.step = first
        self.ready: list[tuple[int, list[tuple]]] = []  # of a tier and its pieces

    def route(self, piece: tuple) -> None:
        tier = max(i for i, size in enumerate(self.sizes) if size >= piece[0])
        insort(self.pools[tier], piece, key=lambda p: p[:2])
        self.held += piece[0]

    def piece(self, doc, start: int, ids, whole: int) -> tuple:
        self.number += 1
        return (len(ids), self.number, doc, start, ids, whole)

    def add(self, doc, ids) -> Iterator[list[tuple]]:
        """Rows of the sequences that are full, a flush at a time."""
        whole = len(ids)
        full = whole // self.window * self.window
        for start in range(0, full, self.window):
            self.ready.append((self.window, [self.piece(doc, start, ids[start : start + self.window], whole)]))
            if len(self.ready) >= 4 * self.flush_windows:
                yield self.emit()
        if whole > full:
            self.route(self.piece(doc, full, ids[full:], whole))
        if self.held >= self.flush_windows * self.window:
            self.pack(last=False)
            yield self.emit()

    def finish(self) -> Iterator[list[tuple]]:
        self.pack(last=True)
        yield self.emit()

    def take(self, tier: int, room: int) -> tuple | None:
        """The longest piece of this tier or a shorter one that fits into room."""
        for i in range(tier, len(self.pools)):
            at = bisect_right(self.pools[i], (room, float("inf")), key=lambda p: p[:2]) - 1
            if at >= 0:
                piece = self.pools[i].pop(at)
                self.held -= piece[0]
                return piece
        return None

    def pack(self, last: bool) -> None:
        for tier, size in enumerate(self.sizes):
            while self.pools[tier]:
                opened = self.pools[tier].pop()  # the longest
                self.held -= opened[0]
                pieces, room = [opened], size - opened[0]
                while room and (filler := self.take(tier, room)):
                    pieces.append(filler)
                    room -= filler[0]
                while room and (source := next((p for p in reversed(self.pools) if p), None)):
                    length, _, doc, start, ids, whole = source.pop(0)
                    self.held -= length
                    cut = min(room, length)
                    pieces.append(self.piece(doc, start, ids[:cut], whole))
                    room -= cut
                    if cut < length:
                        self.route(self.piece(doc, start + cut, ids[cut:], whole))
                if not room:
                    self.ready.append((size, pieces))
                elif last:
                    self.split(pieces)
                else:
                    for p in pieces:
                        self.route(p)
                    return

    def split(self, pieces: list[tuple]) -> None:
        """The last pieces as sequences of the tiers' sizes, and what is left then as one of the shortest tier."""
        left = sum(p[0] for p in pieces)
        while left:
            size = next((x for x in self.sizes if x <= left), left)
            left -= size
            own, room = [], size
            while room:
                length, _, doc, start, ids, whole = pieces.pop(0)
                cut = min(room, length)
                own.append(self.piece(doc, start, ids[:cut], whole))
                room -= cut
                if cut < length:
                    pieces.insert(0, self.piece(doc, start + cut, ids[cut:], whole))
            self.ready.append((max(size, self.sizes[-1]), own))

    def emit(self) -> list[tuple]:
        rows: list[tuple] = []
        for size in {s for s, _ in self.ready}:
            own = sorted((p for s, p in self.ready if s == size), key=lambda p: -sum(x[0] ** 2 for x in p))
            groups = -(-len(own) // self.group)
            for i, pieces in enumerate(own):
                turn, place = divmod(i, groups)
                step = self.step + (groups - 1 - place if turn % 2 else place)
                offset = 0
                for length, _, doc, start, ids, whole in pieces:
                    rows.append((doc, start, length, zlib.crc32(ids.tobytes()), whole, self.sequence, offset, size, step))
                    offset += length
                self.sequence += 1
            self.step += groups
        self.ready = []
        return rows


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones of Latin-1 stand for themselves, the
    others, in order, for those from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def load_encoder(path: str, pattern: str):
    """A function from text to ids as numpy uint32: those of the byte-level tokenizer in the file, without tokens that
    mark begin or end. Its added tokens are found in the text, as the file's own library does by default."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    alphabet = byte_alphabet()
    added = {t["content"]: t["id"] for t in rules["added_tokens"]}
    ranks = {bytes(alphabet[c] for c in token): rank for token, rank in rules["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def pack(docs: DataFrame, window: int = 1024, tiers: int = 4, tokenizer_path: str | None = None, pattern: str | None = None, end_id: int = 0) -> DataFrame:
    """Packs whole documents into sequences of at most `window` tokens; a row for each piece (see SCHEMA).

    Each document is its ids and then end_id. The ids are those of the tokenizer in tokenizer_path, byte_bpe_50k.json
    unless another byte-level one is named; a faster library encodes by its vocabulary (tests compare both). The
    string of an added token within a text, such as <|endoftext|>, gives that token. The file must be readable on
    every executor; it defaults to the installed tokenizer package's.
    A partition of the input is packed by itself, in its order, without a shuffle: only the last sequence of a
    partition, of less than the shortest tier, is to be padded. Sequence numbers are unique over all partitions.
    Null text: as an empty one, a single end_id. Null doc_id: kept. Equal rows are packed each. An empty table gives
    no rows. Very long texts are cut. Columns other than doc_id and text are ignored, whatever their names.
    """
    import public_tokenizers

    tokenizer_path, pattern = tokenizer_path or public_tokenizers.path("byte_bpe_50k.json"), pattern or public_tokenizers.PATTERN
    names = [field.split()[0] for field in SCHEMA.split(", ")]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        encode = load_encoder(tokenizer_path, pattern)
        packer = TierPacker(window, tiers, first=TaskContext.get().partitionId() << 40)
        types = [pa.int32() if name == "tier" else pa.int64() for name in names]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) if text.is_valid else ()
                ids = np.append(np.asarray(ids, "<u4"), np.array([end_id], "<u4"))
                for rows in packer.add(doc, ids):
                    if rows:
                        yield table(rows)
        for rows in packer.finish():
            if rows:
                yield table(rows)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
