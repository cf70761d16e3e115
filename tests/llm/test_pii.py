import hashlib
import random
import re
import time

import pytest

from lorequarry.llm import pii

RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def brute(text):
    out = []
    for k, (kind, rule) in enumerate(RULES):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_equal_the_rules(seed):
    rng = random.Random(seed)
    bits = ["a", "@", ".", "-", "b.c", " ", "+", "1", "255", "256.", "4111 1111 1111 1111", "(030)", "é", "0", "12.34.56.78", "x@y.zz", "%", "\n", "0004"]
    text = "".join(rng.choice(bits) for _ in range(300))
    assert pii.base_spans(text)[0] == brute(text)


def test_long_runs_take_linear_time():
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "1." * 100_000 + "@" * 100_000 + "+1" * 50_000
    assert all(k in (0, 1, 2, 3) for _, k, _ in pii.base_spans(text)[0])


def card(rng):
    body = "4" + "".join(str(rng.randrange(10)) for _ in range(14))
    return next(body + str(d) for d in range(10) if pii.luhn(body + str(d)))


def test_contexts_add_what_the_rules_miss(spark):
    rng = random.Random(8)
    rows = [(i, f"filler {i} my card number {card(rng)} is mine word{i}") for i in range(12)]
    rows += [(20, "now my card number 4111111111111112 is mine too"), (21, "the odd 4111111111111112345 lies here"), (22, "some code 4111111111111113 elsewhere")]
    rows += [(30 + i, f"so please write to jo{i}@mail.example.org for help {i}") for i in range(12)] + [(50, "so please write to jo (at) mail (dot) org for help now")]
    rows += [(60, None), (61, ""), (None, "nothing 1.2.3.4 here")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for doc, r in out.items():
        base = ",".join(f"{RULES[k][0]}:{s}:{e}" for s, k, e in brute(texts[doc] or ""))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        if doc not in (20, 50):
            assert r.spans == base and r.n_found == 0
    assert out[20].spans == "card:19:35" and out[20].n_card == 0 and out[20].n_found == 1
    s = texts[50].index("jo (at)")
    assert out[50].spans == f"email:{s}:{s + len('jo (at) mail (dot) org')}"


def test_patterns_extract_what_stands_in_their_slot(spark):
    rng = random.Random(2)
    number = lambda: f"+49 30 {rng.randrange(10**6, 10**7)}"
    rows = [(i, f"word{i} please call {number()} for help{i}") for i in range(30)]
    rows += [(100 + i, f"word{i} please write to jo{i}@mail.example.org for help{i}") for i in range(30)]
    phones = ["0301234567", "030 1234567", "12 34 56 78 90", "123-45-6789", "(030) 1234567", "030 / 1234567"]
    addresses = ["jane at example dot org", "j[at]example.org", "jane at example.org"]
    rows += [(200 + i, f"now please call {x}, or wait") for i, x in enumerate(phones)]
    rows += [(300 + i, f"now please write to {x}. Then wait") for i, x in enumerate(addresses)]
    rows += [(400 + i, f"the article number {x.replace('1', '9')} is sold out") for i, x in enumerate(phones)]
    rows += [(500, "now please call 5 people or wait"), (501, "now please call somebody or wait")]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for first, kind, values in ((200, "phone", phones), (300, "email", addresses)):
        for i, x in enumerate(values):
            s = texts[first + i].index(x)
            assert out[first + i].spans == f"{kind}:{s}:{s + len(x)}" and out[first + i].n_found == 1
    assert all(out[i].n_found == 0 for i in out if i >= 400 or i < 200)


def test_slots_of_long_runs_take_linear_time():
    assert len(pii.mentions("1 " * 100_000 + "a" * 300_000 + " at" * 50_000 + " (" * 100_000 + "x " * 50_000)[2]) < 10


def test_many_mentions_take_linear_time():
    began = time.time()
    text = "a@b.cc 555 123 4567 4111111111111112 x 1.2.3.4 " * 40_000  # 1.9 MB
    good, _, found = pii.mentions(text)
    assert len(good) >= 80_000 and len(found) > 80_000 and time.time() - began < 30


@pytest.mark.parametrize("seed", range(20))
def test_added_spans_equal_the_plain_rule(seed):
    rng = random.Random(seed)
    found = [(s, rng.randrange(4), s + rng.randrange(1, 9), rng.choice([0.8, 0.9, 1.0])) for s in (rng.randrange(120) for _ in range(80))]
    plain = []
    for s, k, e, _ in sorted(found, key=lambda x: (x[0] - x[2], -x[3], x[0], x[1])):
        if not any(a < e and s < b for a, _, b in plain):
            plain.append((s, k, e))
    assert pii.best_apart(found) == sorted(plain)


@pytest.mark.parametrize("seed", range(20))
def test_bare_equals_the_plain_rule(seed):
    rng = random.Random(seed)
    for _ in range(200):
        text = "".join(rng.choice("([{<)]}>\"'.,a1") for _ in range(rng.randrange(12)))
        start, end, pairs = 0, len(text), dict(zip(")]}>", "([{<"))
        while start < end and text[start] in pii.OPEN and not any(b == text[start] and a in text[start:end] for a, b in pairs.items()):
            start += 1
        while start < end and text[end - 1] in pii.CLOSE and not (text[end - 1] in pairs and pairs[text[end - 1]] in text[start:end]):
            end -= 1
        assert pii.bare(text, 0, len(text)) == (start, end)


def test_many_added_spans_and_long_brackets_take_linear_time():
    began = time.time()
    assert len(pii.best_apart([(10 * i, i % 4, 10 * i + 5 + i % 7, 0.9) for i in range(200_000)])) > 100_000
    assert pii.bare("(" * 500_000 + "1" + "]" * 500_000, 0, 1_000_001) == (500_000, 500_001)
    assert time.time() - began < 20


def test_many_spans_are_added_to_one_text(spark):
    """Contexts add spans to a text of 1 MB that holds thousands of them."""
    rows = [(i, f"word{i} please call +49 30 {1234567 + i} for help{i}") for i in range(30)]
    rows += [(99, " ".join(f"now please call 030{1000000 + i % 5}, or wait" for i in range(26_000)))]
    out = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(rows[-1][1]) > 800_000
    assert out[99].n_found == out[99].spans.count("phone:") == 26_000 and out[0].n_found == 0


def test_secrets_count_and_leave_the_spans_alone(spark):
    rows = [(1, 'api_key = "24be64439e3e49cf46b2d7c9"'), (2, "token: 24be64439e3e49cf46b2d7c9 and mail a@b.cc"), (3, "the token was lost in 24be64439e3e49cf46b2d7c9"), (4, "password=short")]
    out = {r.doc_id: (r.n_secret, r.n_private, r.spans) for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: (1, 1, ""), 2: (1, 2, "email:41:47"), 3: (0, 0, ""), 4: (0, 0, "")}


def test_nothing_personal_is_stored(spark):
    """Intermediate tables hold no identifier and no word around one."""
    docs = spark.createDataFrame([(i, f"word{i} please call +49 30 {1234567 + i} for help{i}") for i in range(5)], "doc_id long, text string")
    stored = str(pii.scan(docs).select("mentions").collect())
    assert "1234567" not in stored and "please" not in stored


def test_odd_rows(odd, odd_rows):
    out = pii.find_personal_data(odd).collect()
    assert len(out) == len(odd_rows)
    assert sorted(str(r.doc_id) for r in out) == sorted(str(r[0]) for r in odd_rows)


def test_empty_table(none):
    assert pii.find_personal_data(none).count() == 0
