"""Exact Jaccard join of documents on word shingles: a size-aware heavy-light join.

Steps
1. Every whole text becomes the set of its distinct 5-word shingles (64-bit hashes). Per document the size, a digest
   of the set, eight minima and a parity bitmap are stored. Documents with equal sets are one class from here on.
2. Large groups of near copies are joined first: classes that share a minimum are compared with one class there, that
   whose minima are the most common, and the pairs that hold exactly are united. This finds some of the links, in
   linear time.
3. The join proper finds every link between classes that aren't united yet. Sets up to a boundary (light) enumerate
   all pairs of elements of their prefix, larger ones (heavy) put single elements of their prefix into inverted
   lists, which are scanned; light sets near the boundary join those lists as possible partners of heavy ones. The
   boundary is where the estimated cost of both, over the sizes of all documents, is least. Prefixes follow an order
   in which shingles counted often come last, so common passages seldom meet. Both filters lose no pair.
4. A parity bitmap bounds the symmetric difference of a pair from below and drops most false candidates: in long lists
   before a pair is put out at all. What is left is compared set by set. Components come from the links of both steps.
   A list is scanned in one task only up to a size; a token that is counted more often has its documents dealt into
   blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

import math
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import connected_components, materialize

SHINGLE = 5
#: A pair links when NEED[0] * union <= NEED[1] * intersection, that is, at 0.8.
NEED = (80, 100)
#: Shingles are counted over all documents in 2**SKETCH_BITS buckets, which are summed in blocks of 2**BLOCK_BITS.
SKETCH_BITS, BLOCK_BITS = 22, 14
MINIMA = 8
#: Estimated cost of scanning a posting against that of enumerating a subset.
SCAN_COST = 8
#: Inverted lists up to SHORT documents give their pairs at once; in longer ones pairs are tested by bitmap first.
SHORT = 4
#: A token counted far more often than PART times is dealt out over groups of about two PART documents each.
PART = 4096
#: Bytes of the table of bitmaps that pairs are tested against at once, and rows that a worker holds before it puts them out.
TABLE_BYTES, HELD = 16 << 20, 100_000


class WordHashes(dict):
    """64-bit hashes of words, remembered; forgets all when it grows past its limit."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 100_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x):
    """A bijective finaliser over uint64 arrays."""
    import numpy as np

    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes, words: WordHashes):
    """The sorted distinct shingle hashes of a text: A-Z lower-cased, split at ASCII white space."""
    import numpy as np

    parts = text.lower().split()
    n = len(parts)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, n)
    take = min(n, SHINGLE)
    total = np.full(n - take + 1, take, np.uint64)
    factor = 0x9E3779B97F4A7C15
    for i in range(take):
        total = total + h[i : n - take + 1 + i] * np.uint64(factor)
        factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1
    return np.unique(mixed(total))


def parity_bitmap(tokens) -> bytes:
    """A bit for each low part of the hashes, set if an odd number of elements have it; as many bits as elements, about."""
    import numpy as np

    bits = max(64, 1 << (max(1, len(tokens)) - 1).bit_length())
    odd = np.bincount((tokens & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference, by their bitmaps."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    long, short = len(a), len(b)
    if long < short:
        x, y, long, short = y, x, short, long
    while long > short:
        long //= 2
        x = (x >> (8 * long)) ^ (x & ((1 << (8 * long)) - 1))
    return (x ^ y).bit_count()


def may_link(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """False only if sizes and bitmaps prove that the sets are less alike than asked for."""
    if NEED[1] * min(na, nb) < NEED[0] * max(na, nb):
        return False
    return (NEED[1] + NEED[0]) * apart(a, b) <= (NEED[1] - NEED[0]) * (na + nb)


def links(a, b) -> bool:
    import numpy as np

    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and NEED[1] * common >= NEED[0] * (len(a) + len(b) - common)


def profile(docs: DataFrame) -> DataFrame:
    """A row per document; and, with block set, the partition's counts of shingles in that block of buckets."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import xxhash
        from pyspark import TaskContext

        words, counts, size = WordHashes(), np.zeros(1 << SKETCH_BITS, np.int32), 1 << SKETCH_BITS
        odd = np.array([0x9E3779B97F4A7C15 * (2 * i + 1) % (1 << 64) | 1 for i in range(MINIMA)], np.uint64)[:, None]
        names = ["doc_id", "n", "d1", "d2", "minima", "bitmap", "block", "task", "counts"]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.int32(), pa.binary()]

        def table(columns):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingles(text.as_py() or b"", words)
                if not len(s):
                    rows.append((doc, 0, None, None, None, None, None, None, None))
                    continue
                np.add.at(counts, (s & np.uint64(size - 1)).astype(np.int64), 1)
                d = xxhash.xxh3_128_digest(s.tobytes())
                least = np.concatenate([mixed(s[i : i + 65536] * odd).min(1)[:, None] for i in range(0, len(s), 65536)], 1).min(1)
                rows.append((doc, len(s), int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), least.view(np.int64).tolist(), parity_bitmap(s), None, None, None))
            if rows:
                yield table(zip(*rows))
        words.clear()  # workers are used again
        task = TaskContext.get().partitionId()
        for block, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield table([[x] for x in (None, None, None, None, None, None, block, task, zlib.compress(part.tobytes(), 1))])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").cast("binary")).mapInArrow(
        run, "doc_id long, n long, d1 long, d2 long, minima array<long>, bitmap binary, block int, task int, counts binary"
    )


def prefix_length(n: int, k: int, smaller: bool = False) -> int:
    """So many first elements of a set share k elements with those of any set it links with; smaller: with any not smaller."""
    need = -(-2 * NEED[0] * n // (NEED[0] + NEED[1])) if smaller else -(-NEED[0] * n // NEED[1])
    return min(n, n - need + k)


def choose_boundary(sizes: dict[int, int]) -> int:
    """The largest size whose sets enumerate pairs, such that the estimated cost over all sizes is least."""

    def cost(x: int) -> int:
        light = sum(c * prefix_length(n, 2) * (prefix_length(n, 2) - 1) // 2 for n, c in sizes.items() if n <= x)
        joined = sum(c * prefix_length(n, 1, True) for n, c in sizes.items() if n <= x and NEED[1] * n >= NEED[0] * x)
        heavy = sum(c * prefix_length(n, 1) for n, c in sizes.items() if n > x)
        return light + SCAN_COST * (joined + heavy)

    return min(sorted({0, *(n for n in sizes if n <= 512)}), key=cost)


def postings(texts: DataFrame, weights, boundary: int) -> DataFrame:
    """(token, doc, comp, n, kind) for the prefixes of all sets. kind: 0 a pair of a light set; 1 an element of a light
    set near the boundary, or early enough in a heavy one to meet larger sets; 2 another element of a heavy one; plus 4
    or 8 for the two sides where a token's documents are dealt into blocks, and only those of different sides meet."""
    import numpy

    mean = float(numpy.mean(weights))
    usual = mean + 6 * mean**0.5  # of counts that chance alone brings together in a bucket
    weights = texts.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa
        import xxhash

        words, often, low = WordHashes(), weights.value, np.uint64((1 << SKETCH_BITS) - 1)

        def dealt(doc, tokens, kinds, counts):
            if not len(counts) or counts.max() <= usual + PART:
                return tokens, kinds
            out_t, out_k = [], []
            for t, k, c in zip(tokens, kinds, counts):
                blocks = max(1, math.ceil((float(c) - usual) / PART))
                if blocks == 1:
                    out_t.append(t)
                    out_k.append(k)
                    continue
                own = xxhash.xxh3_64_intdigest(b"%d" % doc) % blocks
                for other in range(blocks):
                    pair = min(own, other) * blocks + max(own, other)
                    out_t.append(mixed(t + np.uint64(pair + 1) * np.uint64(0xD1342543DE82EF95)))
                    out_k.append(k + (0 if own == other else 4 if own < other else 8))
            return np.array(out_t, np.uint64), np.array(out_k, np.int8)

        def rows(made):
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made)], ["token", "doc", "comp", "n", "kind"])

        for batch in batches:
            held, made = 0, []
            for doc, comp, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingles(text.as_py() or b"", words)
                n = len(s)
                if not n:
                    continue
                s = s[np.lexsort((s, often[(s & low).astype(np.int64)]))]
                parts = []
                if n <= boundary:
                    p = s[: prefix_length(n, 2)]
                    i, j = np.triu_indices(len(p), 1)
                    a, b = np.minimum(p[i], p[j]), np.maximum(p[i], p[j])
                    count = np.minimum(often[(p[i] & low).astype(np.int64)], often[(p[j] & low).astype(np.int64)])
                    parts.append(dealt(doc, mixed(a * np.uint64(0x9E3779B97F4A7C15) + b), np.zeros(len(a), np.int8), count))
                    if NEED[1] * n >= NEED[0] * boundary:
                        p = s[: prefix_length(n, 1, True)]
                        parts.append(dealt(doc, p, np.ones(len(p), np.int8), often[(p & low).astype(np.int64)]))
                else:
                    p = s[: prefix_length(n, 1)]
                    kind = np.full(len(p), 2, np.int8)
                    kind[: prefix_length(n, 1, True)] = 1
                    parts.append(dealt(doc, p, kind, often[(p & low).astype(np.int64)]))
                for t, k in parts:
                    one = np.ones(len(t), np.int64)
                    made.append((t.view(np.int64), doc * one, comp * one, n * one, k))
                    held += len(t)
                if held >= HELD:
                    yield rows(made)
                    held, made = 0, []
            if made:
                yield rows(made)
        words.clear()

    return texts.select("doc_id", "comp", F.col("text").cast("binary")).mapInArrow(run, "token long, doc long, comp long, n long, kind byte")


def grouped(batches):
    """The columns of all rows with one value in the first column, group by group; batches come sorted by it.

    Yields runs of columns, and the (start, stop) of the groups of more than one row in them. Only the last group of a
    batch is held over to the next.
    """
    import numpy as np

    held = None

    def runs(columns):
        token = columns[0]
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        stops = np.r_[starts[1:], len(token)]
        several = stops - starts > 1
        return columns, list(zip(starts[several].tolist(), stops[several].tolist()))

    for columns in batches:
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1], "left"))
        held = [c[last:] for c in columns]
        if last:
            yield runs([c[:last] for c in columns])
    if held is not None:
        yield runs(held)


def pairs_of(comp, n, kind, boundary: int, ones=None, low: int = 0, high: int | None = None):
    """(i, places j) of the rows of one token that can link by component and size: of light sets, or of a heavy set and one no larger.

    Rows come sorted by n. The pair's smaller set, i, has the token among its first elements (kind 0 or 1). ones: only
    these i; low, high: only j from low to before high.
    """
    import numpy as np

    side, kind = kind >> 2, kind & 3
    ones = np.arange(len(n)) if ones is None else ones
    ones = ones[kind[ones] < 2]
    begins = np.maximum(low, np.searchsorted(n, n[ones], "left"))
    ends = np.minimum(len(n) if high is None else high, np.searchsorted(n, n[ones] * NEED[1] // NEED[0], "right"))
    for i, begin, end in zip(ones, begins, ends):
        if begin >= end:
            continue
        j = np.arange(begin, end)  # with those of equal size on either side
        fits = (kind[j] == 0) if kind[i] == 0 else (kind[j] > 0) & (n[j] > boundary)
        j = j[(comp[j] != comp[i]) & fits & ((side[j] != side[i]) | (side[i] == 0))]
        if len(j):
            yield i, j


def by_list(rows: DataFrame, boundary: int) -> DataFrame:
    """Of the inverted lists that hold more than one component: the pairs (a, b) of short ones; the postings of longer ones."""
    ordered = rows.repartition("token").sortWithinPartitions("token")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("token", pa.int64()), ("doc", pa.int64()), ("comp", pa.int64()), ("n", pa.int64()), ("kind", pa.int8())])

        def made(pairs, long):
            if pairs[0]:
                nothing = [pa.nulls(len(pairs[0]), f.type) for f in list(schema)[2:]]
                yield pa.RecordBatch.from_arrays([*(pa.array(np.frombuffer(p, np.int64)) for p in pairs), *nothing], schema=schema)
            if long:
                columns = [np.concatenate(c) for c in zip(*long)]
                nothing = [pa.nulls(len(columns[0]), f.type) for f in list(schema)[:2]]
                yield pa.RecordBatch.from_arrays([*nothing, *map(pa.array, columns)], schema=schema)

        for columns, groups in grouped([c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches):
            pairs, long = (array("q"), array("q")), []  # put out for each batch: slices would hold on to whole batches
            for s, e in groups:
                token, doc, comp, n, kind = own = [c[s:e] for c in columns]
                if (comp == comp[0]).all():
                    continue
                if e - s > SHORT:
                    long.append(own)
                    continue
                order = np.argsort(n, kind="stable")
                doc = doc[order]
                for i, js in pairs_of(comp[order], n[order], kind[order], boundary):
                    for j in js:
                        pairs[0].append(min(doc[i], doc[j]))
                        pairs[1].append(max(doc[i], doc[j]))
            yield from made(pairs, long)

    return ordered.mapInArrow(run, "a long, b long, token long, doc long, comp long, n long, kind byte")


def long_pairs(rows: DataFrame, reps: DataFrame, boundary: int) -> DataFrame:
    """The pairs (a, b) of longer lists whose bitmaps allow a link. Pairs that don't pass are never put out.

    A node whose rows have several sets of one size has several bitmaps; they come as rows of their own, so a pair
    is dropped only if all of its bitmaps rule it out.
    """
    maps = reps.select(F.col("doc_id").alias("doc"), "n", "bitmap")
    ordered = rows.join(maps, ["doc", "n"]).select("token", "doc", "comp", "n", "kind", "bitmap").repartition("token").sortWithinPartitions("token")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def read(batch):
            bitmaps = np.empty(batch.num_rows, object)
            bitmaps[:] = batch.column(5).to_pylist()
            return [*(c.to_numpy(zero_copy_only=False) for c in batch.columns[:5]), bitmaps]

        def folded(bitmaps, words):
            """Those of `words` or twice as many words, at `words`; others are left zero."""
            out = np.zeros((len(bitmaps), words), np.uint64)
            for i, m in enumerate(bitmaps):
                if len(m) == 8 * words:
                    out[i] = np.frombuffer(m, "<u8")
                elif len(m) == 16 * words:
                    out[i] = np.frombuffer(m[: 8 * words], "<u8") ^ np.frombuffer(m[8 * words :], "<u8")
            return out

        def tested(doc, comp, n, kind, bitmaps):
            """(one, others) by pairs_of() that their bitmaps allow. A table of bitmaps has a bounded size, and is made once."""
            words = np.array([len(m) // 8 for m in bitmaps])  # rising, as n is
            for own in np.unique(words).tolist():
                ones = np.flatnonzero(words == own)
                # the smaller set's bitmap is as long as the other's, or half as long
                low, high = np.searchsorted(n, n[ones[0]], "left"), np.searchsorted(n, n[ones[-1]] * NEED[1] // NEED[0], "right")
                most = max(1, TABLE_BYTES // (8 * own))
                for x in range(int(low), int(high), most):
                    y = min(int(high), x + most)
                    table = folded(bitmaps[x:y], own)
                    for i, j in pairs_of(comp, n, kind, boundary, ones, x, y):
                        mine = table[i - x] if x <= i < y else folded(bitmaps[i : i + 1], own)[0]
                        least = np.bitwise_count(table[j - x] ^ mine).sum(1, dtype=np.int64)
                        yield int(doc[i]), doc[j[(NEED[1] + NEED[0]) * least <= (NEED[1] - NEED[0]) * (n[i] + n[j])]]

        def table_of(found):
            return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in found], ["a", "b"])

        found = (array("q"), array("q"))
        for columns, groups in grouped(map(read, batches)):
            for s, e in groups:
                own = [c[s:e] for c in columns[1:]]
                order = np.argsort(own[2], kind="stable")
                for one, others in tested(*(c[order] for c in own)):
                    found[0].frombytes(np.minimum(others, one).tobytes())
                    found[1].frombytes(np.maximum(others, one).tobytes())
                    if len(found[0]) > HELD:
                        yield table_of(found)
                        found = (array("q"), array("q"))
        if found[0]:
            yield table_of(found)

    return ordered.mapInArrow(run, "a long, b long").where("a <> b")


def candidates(rows: DataFrame, reps: DataFrame, boundary: int) -> DataFrame:
    """Distinct pairs (a, b) of different components that share a token, can link by their sizes, and aren't ruled out by bitmaps."""
    lists = materialize(by_list(rows, boundary), "ngram-lists")
    short = pruned(lists.where("token is null").select("a", "b").distinct(), reps)
    return short.select("a", "b").union(long_pairs(lists.where("token is not null").drop("a", "b"), reps, boundary)).distinct()


def pruned(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose bitmaps don't rule them out, and the share of elements in which they differ at least."""
    side = lambda x: reps.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("bitmap").alias(f"m{x}"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            a, b, na, ma, nb, mb = (batch.column(i).to_pylist() for i in range(6))
            rows = [(x, y, apart(p, q) / (i + j)) for x, y, i, p, j, q in zip(a, b, na, ma, nb, mb) if may_link(p, i, q, j)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "apart"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "ma", "nb", "mb").mapInArrow(run, "a long, b long, apart double")


def stars(reps: DataFrame) -> DataFrame:
    """A pair (a, b) for each class at most: b is the most common class of one of a's minima, and the nearest of these by bitmap."""
    marks = reps.select("doc_id", F.posexplode("minima").alias("i", "value"))
    sizes = marks.groupBy("i", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    weighed = materialize(marks.join(sizes, ["i", "value"]), "ngram-marks")
    common = weighed.groupBy("doc_id").agg(F.sum("size").alias("common"))
    held = weighed.join(common, "doc_id")
    centres = held.groupBy("i", "value").agg(F.max(F.struct("common", F.negative("doc_id").alias("low"))).alias("c")).select("i", "value", F.negative(F.col("c.low")).alias("b"))
    near = weighed.join(centres, ["i", "value"]).where("doc_id <> b").select(F.col("doc_id").alias("a"), "b").distinct()
    best = pruned(near, reps).groupBy("a").agg(F.min(F.struct("apart", "b")).alias("best"))
    return best.select("a", F.col("best.b").alias("b"))


def verified(pairs: DataFrame, docs: DataFrame, filter_bits: int = 18) -> DataFrame:
    """The pairs (a, b) that link, by the sets of their whole texts. pairs is a stored table.

    Before texts are shuffled, those whose id falls into no bucket of an id in question are dropped: a broadcast of
    2**filter_bits buckets at most.
    """
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id"))).distinct()
    bucket = lambda: F.pmod(F.xxhash64("doc_id"), F.lit(1 << filter_bits))
    buckets = F.broadcast(wanted.select(bucket().alias("_bucket")).distinct())
    near = docs.withColumn("_bucket", bucket()).join(buckets, "_bucket", "left_semi").drop("_bucket")
    texts = near.join(wanted, "doc_id", "left_semi")
    side = lambda x: texts.select(F.col("doc_id").alias(x), F.col("text").cast("binary").alias(f"t{x}"))

    def run(batches):
        import pyarrow as pa

        words, last = WordHashes(), (None, None)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch.column(2), batch.column(3)):  # one by one: whole columns would be held twice
                tb = tb.as_py()
                if tb != last[0]:
                    last = (tb, shingles(tb or b"", words))
                keep.append(links(shingles(ta.as_py() or b"", words), last[1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))
        words.clear()

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) per row of docs.

    Null text and texts without words: size 0, linked with nothing. Texts of fewer than five words: one shingle, the
    whole sequence. A null doc_id links with nothing and has a null component. Rows that share a doc_id are one node,
    which has the links of each. Ties don't arise: the result is a function of the rows. Columns other than doc_id and
    text are ignored. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    everything = materialize(profile(docs), "ngram-profile")
    rows = everything.where("block is null")
    named = rows.where("n > 0 and doc_id is not null")
    classes = named.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"))
    member = materialize(rows.select("doc_id", "n", "d1", "d2").join(classes, ["d1", "d2"], "left"), "ngram-classes")
    held = classes.select(F.col("rep").alias("doc_id"), "d1", "d2")
    reps = materialize(named.join(held, ["doc_id", "d1", "d2"], "left_semi").select("doc_id", "d1", "d2", "n", "minima", "bitmap").dropDuplicates(["doc_id", "d1"]), "ngram-reps")

    first = materialize(verified(materialize(stars(reps), "ngram-star"), docs), "ngram-first")
    united = connected_components(first.select(F.col("a").alias("src"), F.col("b").alias("dst")), "ngram-united")
    united = materialize(united, "ngram-united")

    weights = shingle_counts(everything)
    sizes = {int(r["size"]): r["count"] for r in reps.select(_size_bin().alias("size")).groupBy("size").count().collect()}
    boundary = choose_boundary(sizes)
    known = reps.select("doc_id").distinct().join(united.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("comp"))
    found = candidates(postings(docs.join(known, "doc_id"), weights, boundary), reps, boundary)
    second = materialize(verified(materialize(found, "ngram-pairs"), docs), "ngram-second")

    # what is united already comes as stars
    edges = united.select(F.col("node").alias("src"), F.col("component").alias("dst")).union(second.select("a", "b")).union(_same_id(member))
    parts = connected_components(edges, "ngram-components")
    out = member.join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def _size_bin():
    """Sizes to 512 as they are, larger ones by their power of two: a bounded number of values."""
    return F.when(F.col("n") <= 512, F.col("n")).otherwise(F.pow(F.lit(2), F.ceil(F.log2(F.col("n").cast("double")))).cast("long"))


def shingle_counts(everything: DataFrame):
    """In how many documents the shingles of each bucket are, over all documents: 2**SKETCH_BITS numbers.

    They are summed in two steps: of each block, the counts of about the square root of all tasks at a time. A step's
    task adds up what it gets of a block in one array, so its memory hangs on the sketch's size alone.
    """
    import numpy as np

    def summed(parts: DataFrame, kind: str) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            sums: dict = {}
            for batch in batches:
                for block, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                    part = np.frombuffer(zlib.decompress(counts.as_py()), kind)
                    sums[block] = sums[block] + part if block in sums else part.astype(np.int64)
            for block, total in sums.items():
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counts": [zlib.compress(total.tobytes(), 1)]})

        return parts.select("block", "counts").mapInArrow(run, "block int, counts binary")

    parts = everything.where("block is not null").select("block", "task", "counts")
    turns = math.isqrt((parts.agg(F.max("task")).first()[0] or 0) + 1)
    some = summed(parts.repartition("block", F.col("task") % turns), "<i4")
    out = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS), np.int32)
    for r in summed(some.repartition("block"), "<i8").collect():
        out[r["block"]] = np.minimum(np.frombuffer(zlib.decompress(bytes(r["counts"])), np.int64), 2**31 - 1)
    return out.reshape(-1)


def _same_id(member: DataFrame) -> DataFrame:
    """Links between the classes of rows that share a doc_id."""
    several = member.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    return member.join(several.drop("high"), "doc_id").where("rep > low").select(F.col("rep").alias("src"), F.col("low").alias("dst"))
