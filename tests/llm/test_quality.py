import json
import math
import random
from collections import Counter

import numpy as np
import pytest

from lorequarry.llm import quality

from .conftest import sentence

BAD = ["zonk", "blarg", "quux", "fnord"]


def corpus(rng, n):
    rows, labels = [], []
    for i in range(n):
        kind = rng.choice(["good", "good", "good", "toxic", "junk"])
        text = sentence(rng, rng.randrange(20, 80))
        if kind == "toxic":
            words = text.split()
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(BAD)
            text = " ".join(words)
        elif kind == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split())
        source = "trusty" if kind == "good" and rng.random() < 0.7 else rng.choice(["mixed", "mixed2"])
        rows.append((i, text, "en", source, len(text), kind))
        if rng.random() < 0.5:
            labels.append((i, int(kind != "junk"), int(kind == "toxic")))
    return rows, labels


@pytest.fixture(scope="module")
def made(spark):
    rows, labels = corpus(random.Random(3), 900)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kind string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def test_held_out_accuracy(made):
    docs, labels, rows, known = made
    out = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    seen = {x[0] for x in known}
    unseen = [r for r in rows if r[0] not in seen]
    right = sum(out[r[0]].keep == (r[5] == "good") for r in unseen)
    assert len(out) == len(rows) and right / len(unseen) > 0.93
    kept = [out[r[0]].keep for r in unseen if r[5] == "good"]
    assert sum(kept) / len(kept) > 0.97
    assert all(0 <= x <= 1 for r in out.values() for x in (r.text_score, r.meta_score, r.score))


def test_views_exchange_labels_both_ways(made):
    """Metadata tell here: a source holds wanted documents only."""
    docs, labels, *_ = made
    model, _ = quality.train(docs, labels)
    log = json.loads(quality.report(model))
    given = {v: sum(x["rows"] for x in log if x.get("from") == v) for v in quality.VIEWS}
    assert given["text"] > 100 and given["meta"] > 100
    assert any(model.odds["text"]) and any(model.odds["meta"])
    assert log[-1]["tested"] > 50 and log[-1]["accuracy"] > 0.9


def test_the_exchange_equals_brute_force(spark, made):
    """Counted row by row, feature by feature, in plain Python."""
    docs, labels, rows, _ = made
    model, features = quality.train(docs, labels)
    some = docs.where("doc_id < 60")
    limits = {("text", 0): 0.9, ("text", 1): 0.8, ("meta", 0): 0.7, ("meta", 1): None}
    got = quality.exchanged(quality.features_of(some, model.chosen), model, limits)
    ids, wanted = quality.WordIds(), {}
    place = {int(w): i for i, w in enumerate(model.chosen)}

    def probability(view, own, numbers):
        fitted, (a, b) = model.views[view], model.slopes[view]
        numbers = [*(numbers if view == "text" else []), sum(model.odds[view][i] for i in own) / max(1, len(own)) ** 0.5]
        z = fitted.b + sum(fitted.w[i] for i in own) + sum((x - m) / s * d for x, m, s, d in zip(numbers, fitted.mean, fitted.scale, fitted.d))
        return 1 / (1 + math.exp(-(a * z + b)))

    for i, text, lang, source, n, _ in rows[:60]:
        words, numbers = quality.text_features(text, ids)
        held = {"text": [place[int(w)] for w in words if int(w) in place], "meta": quality.meta_features(lang, source, n)}
        for view, other in (("text", "meta"), ("meta", "text")):
            p = probability(view, held[view], [float(x) for x in numbers])
            for label, q in ((0, 1 - p), (1, p)):
                if limits[view, label] is not None and q >= limits[view, label]:
                    wanted.setdefault((other, label), Counter()).update([*held[other], "rows"])
    assert sum(wanted.get(k, Counter())["rows"] > 0 for k in got) >= 2
    for key, counts in got.items():
        expected = wanted.get(key, Counter())
        assert counts[-1] == expected["rows"]
        assert {i: n for i, n in enumerate(counts[:-1].tolist()) if n} == {i: n for i, n in expected.items() if i != "rows"}


def test_a_view_gives_labels_only_if_it_is_right():
    rng = np.random.default_rng(1)
    y = (rng.random(500) < 0.3).astype(float)
    sure = np.clip(0.5 + (y - 0.5) * 0.9 + rng.normal(0, 0.05, 500), 0, 1)
    assert quality.surety(sure, y, 1, 0.9) is not None and quality.surety(sure, y, 0, 0.9) is not None
    blind = rng.random(500)  # says much, knows nothing
    assert quality.surety(blind, y, 1, 0.9) is None
    assert quality.surety(blind, y, 0, 0.9) is None or (1 - blind >= quality.surety(blind, y, 0, 0.9)).mean() < 0.1


def test_results_do_not_hang_on_partitions(made):
    docs, labels, *_ = made
    a = quality.classify(docs, labels, labelled_rows=150).collect()
    b = quality.classify(docs.repartition(5), labels.repartition(3), labelled_rows=150).collect()
    assert {(r.doc_id, r.keep) for r in a} == {(r.doc_id, r.keep) for r in b}


def test_rows_that_stay_keep_their_columns(made):
    docs, labels, *_ = made
    kept = quality.keep_wanted(docs, labels)
    same = {r.doc_id for r in quality.classify(docs, labels).where("keep").collect()}
    assert kept.schema == docs.schema and {r.doc_id for r in kept.collect()} == same


def test_odd_rows_with_and_without_labels(spark, odd, odd_rows, made):
    for labels in (made[1], spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, None)], "doc_id long, quality int, toxic int")):
        out = quality.classify(odd, labels).collect()
        assert len(out) == len(odd_rows) and all(r.keep is not None for r in out)
        assert quality.keep_wanted(odd, labels).columns == odd.columns


def test_empty_table(none, made):
    assert quality.classify(none, made[1]).count() == 0
    assert quality.keep_wanted(none, made[1]).count() == 0


def test_no_row_is_sure_to_be_both():
    rng = np.random.default_rng(2)
    y = (rng.random(500) < 0.2).astype(float)
    p = np.clip(0.5 + (y - 0.5) * 0.9 + rng.normal(0, 0.1, 500), 0, 1)
    p[:5] = 0.5  # a few that it can't tell don't spoil its record
    bad, good = (quality.surety(p, y, label, 0.9) for label in (1, 0))
    assert bad > 0.5 and good > 0.5
    assert not ((p >= bad) & (1 - p >= good)).any()
