import math
import zlib
from collections import Counter, defaultdict

import xxhash

from lorequarry.llm import sharding


def brute(doc_id, weights):
    best = None
    for i, w in enumerate(weights):
        seed = 42 if doc_id is None else xxhash.xxh64_intdigest(doc_id.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), seed)
        score = w / -math.log(((h >> 11) + 0.5) / (1 << 53))
        if best is None or score > best[0]:
            best = (score, i)
    return best[1]


def test_shards_equal_brute_force(spark, odd, odd_rows):
    weights, grown = [1.0, 2.0, 0.5, 1.0], [1.0, 2.0, 0.5, 1.0, 1.0]
    rows = sharding.shard(odd, weights, grown).collect()
    assert len(rows) == len(odd_rows)
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), brute(r[0], weights), brute(r[0], grown)) for r in odd_rows)
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r.law == "key"
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_new_shard_takes_rows_only_into_itself_and_weights_hold(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "cast(id as string) as text")
    rows = sharding.shard(docs, [1.0] * 7 + [3.0], [1.0] * 7 + [3.0, 1.0]).collect()
    assert all(r.grown_shard in (r.shard, 8) for r in rows)
    n = Counter(r.shard for r in rows)
    assert abs(n[7] / 20000 - 0.3) < 0.02
    assert abs(sum(r.grown_shard == 8 for r in rows) / 20000 - 1 / 11) < 0.01


def test_empty_table(none):
    assert sharding.shard(none, [1.0] * 16, [1.0] * 17).count() == 0
