import random
import re

import pytest

from lorequarry.llm import ngram_join
from lorequarry.llm.ngram_join import WordHashes, may_link, parity_bitmap, prefix_length, shingles

from .conftest import paragraphs, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    """(doc_id, text): the smallest doc_id reachable, and the set sizes, by comparing all pairs."""
    sets = []
    for doc, text in rows:
        words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append((doc, frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])))
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is not None and b is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                if p != q:
                    parent[max(p, q)] = min(p, q)
    return sorted(((d, len(s), None if d is None else find(d)) for d, s in sets), key=str)


def result(spark, rows, schema="doc_id long, text string"):
    out = ngram_join.near_groups(spark.createDataFrame(rows, schema)).collect()
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def edited(rng, text, share):
    words = text.split(" ")
    for _ in range(max(1, int(len(words) * share))):
        words[rng.randrange(len(words))] = rng.choice(["xx", "yy", "zz"]) + str(rng.randrange(1000))
    return " ".join(words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(11)
    shared = sentence(rng, 60)
    rows = []
    for g in range(25):
        base = sentence(rng, rng.choice([4, 5, 6, 8, 10, 14, 25, 60, 75, 90, 150, 400]))
        rows.append(base)
        rows += [edited(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(rng.randrange(6))]
        rows += [base + " " + sentence(rng, max(1, len(base.split()) // rng.choice([4, 8, 16])))]
        rows += [shared + " " + sentence(rng, rng.choice([20, 80, 200]))]
    rows += [rows[0].upper(), "  " + rows[5].replace(" ", "\n\t"), "", None, "  ", "one", "One", "one two"]
    rng.shuffle(rows)
    numbered = list(enumerate(rows))
    assert result(spark, numbered) == brute(numbered)


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(3)
    base = sentence(rng, 200)
    rows = [(i, edited(rng, base, 0.006)) for i in range(150)] + [(1000 + i, base) for i in range(100)] + [(2000 + i, sentence(rng, 100)) for i in range(30)]
    assert result(spark, rows) == brute(rows)


def test_odd_rows(spark, odd, odd_rows):
    out = ngram_join.near_groups(odd).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == brute([r[:2] for r in odd_rows])


def test_empty_table(none):
    assert ngram_join.near_groups(none).count() == 0


@pytest.mark.parametrize("seed", range(20))
def test_filters_lose_no_link(seed):
    rng, words = random.Random(seed), WordHashes()
    base = sentence(rng, rng.randrange(5, 120))
    a = shingles(base.encode(), words)
    b = shingles(edited(rng, base, 0.02).encode() + b" " + sentence(rng, rng.randrange(1, 12)).encode(), words)
    sa, sb = set(a.tolist()), set(b.tolist())
    if 100 * len(sa & sb) >= 80 * len(sa | sb):
        assert may_link(parity_bitmap(a), len(a), parity_bitmap(b), len(b))
        small, large = sorted((a, b), key=len)
        assert set(small[: prefix_length(len(small), 1, True)].tolist()) & set(large[: prefix_length(len(large), 1)].tolist())
        common = set(a[: prefix_length(len(a), 2)].tolist()) & set(b[: prefix_length(len(b), 2)].tolist())
        assert len(common) >= 2 or sa == sb


def test_the_boundary_follows_the_cost():
    assert ngram_join.choose_boundary({10: 1000}) >= 10
    assert ngram_join.choose_boundary({5000: 1000}) == 0
    assert 10 <= ngram_join.choose_boundary({10: 1000, 400: 1000}) < 400


def test_paragraphs_split_at_ascii_space_only(spark):
    rows = [(1, paragraphs(random.Random(1), 3)), (2, "a b c d e f g"), (3, "a b C d e f g")]
    assert result(spark, rows) == brute(rows)
