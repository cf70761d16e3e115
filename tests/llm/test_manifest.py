import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorequarry.llm import manifest
from tests.llm.conftest import SCHEMA


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    held = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    return h(*(held(x) for x in (doc_id, source, lang, n_chars, text)))


def grow(leaves):
    """The root, and the siblings of each leaf level by level."""
    nodes, at, proofs = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run = nodes[a // 8 * 8 : a // 8 * 8 + 8]
            proofs[i].append(("".join(run[: a % 8]), "".join(run[a % 8 + 1 :])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        at = [a // 8 for a in at]
    return nodes[0], proofs


def brute(rows):
    """Counter of (doc_id, leaf, subroot, root, proof, folded, verified) of rows (doc_id, text, lang, source, n_chars)."""
    lower = str.maketrans({c: chr(ord(c) + 32) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    langs = {}
    for r in rows:
        langs.setdefault(r[2], []).append(r)
    order = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    roots = {}
    for x in order:
        langs[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        roots[x] = grow([leaf(*r) for r in langs[x]])
    root, tops = grow([roots[x][0] for x in order]) if order else (None, [])
    out = Counter()
    for x, top in zip(order, tops):
        subroot, proofs = roots[x]
        for r, own in zip(langs[x], proofs):
            third = zlib.crc32(str(r[0]).encode()) % 3 == 0 if r[0] is not None else False
            node = leaf(r[0], r[1].translate(lower) if third and r[1] is not None else r[1], *r[2:])
            for a, z in own + top:
                node = h(a, node, z)
            out[r[0], leaf(*r), subroot, root, h(*(a + z for a, z in own + top)), node, node == root] += 1
    return out


def made(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "k", 0.5) for r in rows], SCHEMA).withColumns({"tree": F.lit("x"), "node": F.lit(1), "position": F.lit("y"), "block": F.lit(2)})
    got = manifest.verify(docs, manifest.lower_cased_thirds(F.col("doc_id"), F.col("text")))
    return Counter(map(tuple, got.collect()))


def test_odd_rows_equal_brute_force(spark, odd_rows):
    rows = [r[:5] for r in odd_rows]
    assert made(spark, rows) == brute(rows)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8, "de": 9, None: 1}, {"en": 513, "": 512, None: 65, "é": 64, "de": 2}, {"en": 4200, "fr": 1}])
def test_trees_of_many_sizes_equal_brute_force(spark, sizes):
    rng = random.Random(1)
    ids = iter(rng.sample(range(10**6), sum(sizes.values())))
    rows = [(next(ids), f"Text {rng.random()}", lang, rng.choice(["a", None]), rng.choice([3, None])) for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    assert made(spark, rows) == brute(rows)


def test_many_languages_equal_brute_force(spark):
    rows = [(i, "t", f"l{i % 700}", "s", 1) for i in range(1500)]
    assert made(spark, rows) == brute(rows)


def test_equal_rows_get_the_same_set_of_proofs(spark):
    rows = [(5, "Same", "en", "s", 4)] * 700 + [(i, "x", "en", "s", 1) for i in range(300)]
    assert made(spark, rows) == brute(rows)


def test_proofs_hold_and_tampering_shows(spark):
    docs = spark.createDataFrame([(i, f"Doc {i}", "en" if i % 3 else "de", "s", 5) for i in range(100)], "doc_id long, text string, lang string, source string, n_chars long")
    plain = manifest.verify(docs)
    assert plain.where("not verified").count() == 0 and plain.select("root").distinct().count() == 1
    told = manifest.verify(docs, F.when(F.col("doc_id") == 7, F.lit("other"))).collect()
    assert [r.doc_id for r in told if not r.verified] == [7]
    changed = manifest.verify(docs.withColumn("text", F.when(F.col("doc_id") == 7, F.lit("other")).otherwise(F.col("text"))))
    assert changed.first().root != plain.first().root
    sides = manifest.manifest(docs).where("doc_id = 7").first()
    node = sides.leaf
    for a, z in zip(sides.left, sides.right):
        node = h(a, node, z)
    assert node == sides.root


def test_empty_table(none):
    assert manifest.verify(none, manifest.lower_cased_thirds(F.col("doc_id"), F.col("text"))).count() == 0


def test_unwinding_returns_the_root_and_fills_the_leaves():
    leaves = [h(str(i)) for i in range(100)]
    root, proofs = manifest.unwind(leaves, manifest.depth(100))
    assert (root, proofs) == grow(leaves)
    assert manifest.unwind(leaves[:1], 0) == (leaves[0], [[]])
    assert manifest.unwind(leaves[:1], 2)[0] == h(h(leaves[0]))
