"""Co-training of a quality classifier from a text view and a metadata view.

Steps
1. Labelled rows, at most a stated number, are split in three: to fit on, to calibrate on, and to test on, which no
   step but the report sees. The vocabulary is chosen on the executors, from the rows to fit on.
2. Every document's features are stored: its words of the vocabulary, a few numbers and its metadata ids.
3. In a round each view is fitted and calibrated, and scores every document of the table. Those it is sure of become
   pseudo-labels for the other view, which takes them as counts: how many pseudo-labelled documents of each class hold
   each of its features, over the whole table. The log odds of these counts are an input of the other view's next fit.
   How sure a view has to be is measured on the calibration rows, for each class, never claimed by its own score.
4. The calibrated views are combined, and every document is scored.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import broadcast_by_value, materialize

WORD_BITS = 18
META = 512
DENSE = ["log_words", "distinct", "top_word", "upper", "symbols", "bars", "digits", "word_length", "line_length", "repeated_lines", "letters"]
SCHEMA = "doc_id long, text_score double, meta_score double, score double, keep boolean"


class WordIds(dict):
    """Hashed ids of words without the marks around them; forgets all when it grows past its limit."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 200_000:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]{}*#$%&|<>")
        value = self[word] = xxhash.xxh3_64_intdigest(bare) & ((1 << WORD_BITS) - 1) if bare else 0
        return value


def text_features(text: str, ids: WordIds):
    """Distinct word ids, and the numbers named in DENSE, of a whole text."""
    import numpy as np

    raw = text.split()
    n = max(1, len(raw))
    counts = Counter(raw)
    size = max(1, len(text))
    upper = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1)
    marked = sum(c for w, c in counts.items() if w[-1] in "*#$%&!|" and w != "|")
    lines = text.split("\n")
    word_chars = sum(len(w) * c for w, c in counts.items())
    letters = sum(c for w, c in counts.items() if w[:1].isalpha())
    digits = sum(c for w, c in counts.items() if w[:1].isdigit())
    dense = [np.log1p(len(raw)) / 10, len(counts) / n, max(counts.values(), default=0) / n, upper / n, marked / n, counts.get("|", 0) / n, digits / n, word_chars / n / 20, min(1.0, size / len(lines) / 2000), 1 - len(set(lines)) / len(lines), letters / n]
    words = np.unique(np.fromiter((ids[w.lower()] for w in counts), np.int64, len(counts)))
    return words[words > 0], np.asarray(dense, np.float32)


def meta_features(lang, source, n_chars) -> list[int]:
    """Hashed ids of language, source, length class and their pairs."""
    import xxhash

    length = "none" if n_chars is None else str(min(20, int(n_chars).bit_length()))
    named = [f"l:{lang}", f"s:{source}", f"n:{length}", f"ln:{lang}:{length}", f"sl:{source}:{lang}"]
    return sorted({xxhash.xxh3_64_intdigest(x) % META for x in named})


def logistic(z):
    import numpy as np

    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class SparseLogistic:
    """Logistic regression over id lists and a few dense columns; full gradients with momentum, a fixed number of steps."""

    def __init__(self, size: int, dense: int, penalty: float = 1e-4, steps: int = 400, rate: float = 2.0):
        import numpy as np

        self.w, self.d, self.b = np.zeros(size), np.zeros(dense), 0.0
        self.penalty, self.steps, self.rate = penalty, steps, rate
        self.mean, self.scale = np.zeros(dense), np.ones(dense)

    def flat(self, rows):
        import numpy as np

        lengths = np.array([len(r) for r in rows], np.int64)
        return np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), lengths)

    def fit(self, rows, dense, y, weight):
        import numpy as np

        ids, owner = self.flat(rows)
        if dense.shape[1]:
            self.mean, self.scale = dense.mean(0), dense.std(0) + 1e-6
        x = (dense - self.mean) / self.scale
        weight = weight / weight.sum()
        base = np.clip((weight * y).sum(), 1e-3, 1 - 1e-3)
        self.b = float(np.log(base / (1 - base)))
        m = [np.zeros_like(self.w), np.zeros_like(self.d), 0.0]
        for step in range(self.steps):
            z = np.bincount(owner, self.w[ids], minlength=len(rows)) + x @ self.d + self.b
            g = weight * (logistic(z) - y)
            grads = (np.bincount(ids, g[owner], minlength=len(self.w)) + self.penalty * self.w, x.T @ g + self.penalty * self.d, g.sum())
            rate = self.rate * (1 if step < self.steps * 0.7 else 0.3)
            m = [0.9 * a + b for a, b in zip(m, grads)]
            self.w, self.d, self.b = self.w - rate * m[0], self.d - rate * m[1], self.b - rate * m[2]
        return self

    def logit(self, rows, dense):
        import numpy as np

        ids, owner = self.flat(rows)
        return np.bincount(owner, self.w[ids], minlength=len(rows)) + ((dense - self.mean) / self.scale) @ self.d + self.b


VIEWS = ("text", "meta")
#: Of an array of counts, that of documents comes after those of the features.
FEATURES_SCHEMA = "doc_id long, words binary, dense binary, meta binary"


class Model:
    """Both views and their combination; it travels to executors as one broadcast by value."""

    def __init__(self, chosen=None, prior: float = 0.0):
        import numpy as np

        self.chosen, self.prior, self.log = chosen, prior, []
        self.views, self.slopes, self.blend = {}, {}, None
        self.odds = {"text": np.zeros(0 if chosen is None else len(chosen)), "meta": np.zeros(META)}

    def inputs(self, view: str, rows, dense):
        """The numbers that a view reads beside its ids; the last is the mean log odds by the pseudo-labels it was given."""
        import numpy as np

        mean = np.array([self.odds[view][r].sum() / len(r) ** 0.5 if len(r) else 0.0 for r in rows])[:, None]
        return np.hstack([dense, mean]) if view == "text" else mean

    def logit(self, view: str, rows, dense):
        """The calibrated logit of being unwanted."""
        a, b = self.slopes[view]
        return a * self.views[view].logit(rows, self.inputs(view, rows, dense)) + b

    def scores(self, words, dense, metas):
        """Probabilities of being unwanted by the text, by the metadata, and by both."""
        import numpy as np

        if not self.views:
            same = np.full(len(metas), self.prior)
            return same, same, same
        zs = np.column_stack([self.logit("text", words, dense), self.logit("meta", metas, dense)])
        return logistic(zs[:, 0]), logistic(zs[:, 1]), logistic(zs @ self.blend["w"] + self.blend["b"])


def select(row, chosen):
    """A row's word ids as places in the chosen vocabulary."""
    import numpy as np

    if not len(chosen):
        return np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(chosen, row), len(chosen) - 1)
    return at[chosen[at] == row]


def calibrate(z, y, steps: int = 300):
    """Slope and shift of a logit by Platt's method, with smoothed targets."""
    import numpy as np

    a, b = 1.0, 0.0
    high, low = (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2)
    t = np.where(y > 0.5, high, low)
    for _ in range(steps):
        p = logistic(a * z + b)
        w = np.maximum(1e-6, p * (1 - p))
        h = np.array([[(w * z * z).sum() + 1e-6, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-6]])
        g = np.array([((p - t) * z).sum(), (p - t).sum()])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -1, 1))
        if abs(da) + abs(db) < 1e-7:
            break
    return a, b


def surety(p, y, label: int, confident: float) -> float | None:
    """From which probability of the label on a view may give it; None: it may not.

    Of the rows with labels that are at least so sure, as many as hold the label as `confident` asks for, and at most a
    fourth as many don't as when every row were given it; shares are smoothed by one row of each kind.
    """
    import numpy as np

    q, right = (p if label else 1 - p), y == label
    need = max(confident, 1 - (1 - right.mean()) / 4)
    order = np.argsort(-q, kind="stable")
    share = (np.cumsum(right[order]) + 1) / (np.arange(len(q)) + 3)
    good = np.flatnonzero(share >= need)
    # more likely than not, so that no document is given both labels
    return max(float(q[order][good[-1]]), float(np.nextafter(0.5, 1))) if len(good) else None


def pseudo_counts(model: Model, limits: dict, words, dense, metas) -> dict:
    """For (receiving view, label) how many of these documents hold each feature of that view, and last how many they
    are: of those that the other view is sure of."""
    import numpy as np

    rows, out = {"text": words, "meta": metas}, {}
    for view, other in (("text", "meta"), ("meta", "text")):
        p = logistic(model.logit(view, rows[view], dense))
        for label in (0, 1):
            if limits[view, label] is None:
                continue
            sure = np.flatnonzero((p if label else 1 - p) >= limits[view, label])
            size = len(model.odds[other])
            held = np.concatenate([*(rows[other][i] for i in sure), np.empty(0, np.int64)]).astype(np.int64)
            out[other, label] = np.append(np.bincount(held, minlength=size), len(sure))
    return out


def log_odds(bad, good):
    """Of each feature's share in the unwanted and in the wanted documents, both smoothed; the arrays end with their numbers."""
    import numpy as np

    return np.log((bad[:-1] + 1) / (bad[-1] + 2)) - np.log((good[:-1] + 1) / (good[-1] + 2))


def co_train(chosen, words, dense, metas, y, part, exchange, rounds: int = 3, confident: float = 0.9) -> Model:
    """Fits both views on rows with labels (y: 1 unwanted, 0 wanted): on those of part 0, calibrated and combined on
    part 1, tested on part 2. exchange(model, limits) is pseudo_counts() over all documents of the table."""
    import numpy as np

    y = np.asarray(y, np.float64)
    fit, held, test = (np.flatnonzero(part == k) for k in range(3))
    if len(y) < 20 or any(not 0 < y[at].sum() < len(at) for at in (fit, held)):
        return Model(prior=float(y.mean()) if len(y) else 0.0)
    model, rows = Model(chosen, float(y.mean())), {"text": words, "meta": metas}
    sizes = {"text": len(chosen), "meta": META}
    of = lambda rows, at: [rows[i] for i in at]
    for turn in range(rounds + 1):
        for view in VIEWS:
            numbers = model.inputs(view, rows[view], dense)
            own = SparseLogistic(sizes[view], numbers.shape[1]).fit(of(rows[view], fit), numbers[fit], y[fit], np.ones(len(fit)))
            model.views[view], model.slopes[view] = own, calibrate(own.logit(of(rows[view], held), numbers[held]), y[held])
        if turn == rounds:
            break
        limits = {}
        for view in VIEWS:
            p = logistic(model.logit(view, of(rows[view], held), dense[held]))
            limits |= {(view, label): surety(p, y[held], label, confident) for label in (0, 1)}
        given = exchange(model, limits) if any(x is not None for x in limits.values()) else {}
        for view, other in (("text", "meta"), ("meta", "text")):
            model.log += [{"round": turn + 1, "from": view, "label": label, "rows": int(given[other, label][-1]) if (other, label) in given else 0} for label in (0, 1)]
            # one kind alone tells nothing of the odds; the counts of the rows with labels to fit on stand for the other
            if any((other, label) in given and given[other, label][-1] for label in (0, 1)):
                known = {label: np.append(np.bincount(np.concatenate([*of(rows[other], fit[y[fit] == label]), np.empty(0, np.int64)]).astype(np.int64), minlength=sizes[other]), (y[fit] == label).sum()) for label in (0, 1)}
                model.odds[other] = log_odds(*(given[other, label] if (other, label) in given and given[other, label][-1] else known[label] for label in (1, 0)))
    zs = np.column_stack([model.logit(v, rows[v], dense) for v in VIEWS])
    blend = SparseLogistic(0, 2, penalty=1e-4, steps=800, rate=0.5).fit([np.empty(0, np.int64)] * len(held), zs[held], y[held], np.ones(len(held)))
    w = blend.d / blend.scale
    model.blend = {"w": w, "b": float(blend.b - w @ blend.mean)}
    found, true = logistic(zs[test] @ w + model.blend["b"]) >= 0.5, y[test] > 0.5
    share = lambda x: float(x.mean()) if len(x) else None
    model.log.append({"tested": len(test), "accuracy": share(found == true), "precision": share(true[found]), "recall": share(found[true])})
    return model


def _view(docs: DataFrame) -> DataFrame:
    """The columns the views read; those that a table lacks are null."""
    get = lambda c, t: F.col(c).cast(t) if c in docs.columns else F.lit(None).cast(t).alias(c)
    return docs.select(get("doc_id", "long"), get("text", "string"), get("lang", "string"), get("source", "string"), get("n_chars", "long"))


def features_of(docs: DataFrame, chosen=None) -> DataFrame:
    """FEATURES_SCHEMA: as bytes the word ids (i4; with `chosen`, places in that vocabulary, u2), numbers (f4) and metadata ids (u2)."""
    shared = docs.sparkSession.sparkContext.broadcast(chosen)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids = WordIds()
        for batch in batches:
            rows = []
            for doc, text, lang, source, n in zip(batch.column(0).to_pylist(), batch.column(1), *(c.to_pylist() for c in batch.columns[2:])):
                words, dense = text_features(text.as_py() or "", ids)
                words = words.astype("<i4") if shared.value is None else select(words, shared.value).astype("<u2")
                rows.append((doc, words.tobytes(), dense.astype("<f4").tobytes(), np.asarray(meta_features(lang, source, n), "<u2").tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), *[pa.binary()] * 3])], ["doc_id", "words", "dense", "meta"])
        ids.clear()

    return _view(docs).mapInArrow(run, FEATURES_SCHEMA)


def unpacked(words, dense, metas):
    """Columns of features_of() with a vocabulary, as lists of id arrays and a matrix."""
    import numpy as np

    ids = lambda column: [np.frombuffer(x, "<u2").astype(np.int64) for x in column]
    return ids(words), np.frombuffer(b"".join(dense), "<f4").reshape(-1, len(DENSE)).astype(np.float64), ids(metas)


def vocabulary_of(labelled: DataFrame, size: int, least: int = 4):
    """The word ids whose presence tells the classes apart most, by chi-squared; sorted. labelled: words and bad."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            words = [np.frombuffer(w.as_py(), "<i4") for w in batch.column(0)]
            bad = np.repeat(batch.column(1).to_numpy(zero_copy_only=False), [len(w) for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*words, np.empty(0, np.int32)]).astype(np.int32)), pa.array(bad.astype(np.int64))], ["word", "bad"])

    total, share = labelled.agg(F.count(F.lit(1)), F.avg("bad")).first()
    if not total or not 0 < share < 1:
        return np.empty(0, np.int64)
    counts = labelled.select("words", "bad").mapInArrow(run, "word int, bad long").groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"))
    expected = F.col("n") * share
    chi = (F.col("bad") - expected) ** 2 / (expected * (1 - share)) * total / F.greatest(F.lit(1), total - F.col("n"))
    best = counts.where(F.col("n") >= least).select("word", chi.alias("chi")).where("chi > 0").orderBy(F.desc("chi"), "word").limit(size)
    return np.sort(np.array([r["word"] for r in best.collect()], np.int64))


def exchanged(features: DataFrame, model: Model, limits: dict) -> dict:
    """pseudo_counts() over all rows of features. A task gives a row for each count that isn't 0; they are summed by key."""
    import numpy as np

    shared = broadcast_by_value(features.sparkSession, (model, limits))
    receivers = [(view, label) for view in VIEWS for label in (0, 1)]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        given = shared()
        for batch in batches:
            if batch.num_rows:
                for key, counts in pseudo_counts(*given, *unpacked(*(c.to_pylist() for c in batch.columns[1:]))).items():
                    sums[key] = sums[key] + counts if key in sums else counts
        for key, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), receivers.index(key), np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["receiver", "feature", "n"])

    out = {key: np.zeros(len(model.odds[key[0]]) + 1, np.int64) for key in receivers}
    # at most a row for each feature and class
    for r in features.mapInArrow(run, "receiver int, feature int, n long").groupBy("receiver", "feature").agg(F.sum("n").alias("n")).collect():
        out[receivers[r["receiver"]]][r["feature"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, labelled_rows: int = 10_000, vocabulary: int = 4096, **how) -> tuple[Model, DataFrame | None]:
    """The model, fitted on at most labelled_rows labels, by the least hash of their ids, and on pseudo-labels among all
    documents; and the stored features of all documents, or None where there was nothing to fit.

    A label is unwanted where quality is 0 or toxic is not 0. Labels without an id, or with neither, are left out; of
    several labels of a document any that is unwanted counts. Of the labelled rows `vocabulary` places, numbers and
    metadata ids reach the driver, of the other documents only counts.
    """
    import numpy as np

    bad = ((F.col("quality") == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) != 0)).cast("int")
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long")).agg(F.max(F.coalesce(bad, F.lit(0))).alias("bad"))
    # the labels of documents that are there, before the limit counts
    known = known.join(docs.where("doc_id is not null").select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
    wanted = materialize(known.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(labelled_rows), "quality-labels")
    fifth = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(5))
    part = F.when(fifth < 3, 0).when(fifth == 3, 1).otherwise(2)
    rows = features_of(docs.join(F.broadcast(wanted.select("doc_id")), "doc_id", "left_semi"))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("words", "dense", "meta")).alias("f")).select("doc_id", "f.*")
    labelled = materialize(rows.join(F.broadcast(wanted), "doc_id").withColumn("part", part), "quality-labelled")
    chosen = vocabulary_of(labelled.where("part = 0"), min(vocabulary, 1 << 16))

    def picked(batches):
        import pyarrow as pa

        for batch in batches:
            words = [select(np.frombuffer(w.as_py(), "<i4"), chosen).astype("<u2").tobytes() for w in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary()), *batch.columns[2:]], batch.schema.names)

    got = sorted(labelled.mapInArrow(picked, labelled.schema).collect(), key=lambda r: r["doc_id"])
    y, parts = np.array([r["bad"] for r in got], np.float64), np.array([r["part"] for r in got])
    stored = []

    def exchange(model, limits):
        if not stored:
            stored.append(materialize(features_of(docs, chosen), "quality-features"))
        return exchanged(stored[0], model, limits)

    words, dense, metas = unpacked(*([bytes(r[c]) for r in got] for c in ("words", "dense", "meta")))
    return co_train(chosen, words, dense, metas, y, parts, exchange, **how), stored[0] if stored else None


def score(features: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """SCHEMA for every row of features: probabilities of being unwanted, and keep, where the combined one is below the threshold."""
    shared = broadcast_by_value(features.sparkSession, model)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        model = shared()
        for batch in batches:
            if batch.num_rows:
                found = model.scores(*unpacked(*(c.to_pylist() for c in batch.columns[1:])))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.asarray(x, np.float64)) for x in found], pa.array(np.asarray(found[2]) < threshold)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return features.mapInArrow(run, SCHEMA)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """Trains on the labels and scores every row of docs: doc_id, text_score, meta_score, score (of being unwanted), keep.

    With fewer than 20 labels that belong to documents, or labels of one kind only among those to fit or calibrate on,
    all scores are the share of unwanted labels (0 without any), so rows are kept unless most labels are unwanted.
    Null text: as an empty one. Null metadata: a value of its own. Null doc_id: scored, never labelled. Of rows that
    share a doc_id one is trained on; each is scored. Ties in the sample go by hash, then id. An empty table gives an
    empty table. Very long texts are read whole. Other columns are ignored, whatever their names.
    """
    model, features = train(docs, labels, **how)
    if features is None:
        features = features_of(docs, [] if model.chosen is None else model.chosen)
    return score(features, model, threshold)


def keep_wanted(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **how) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns. Nulls and other odd rows: see classify().

    Rows are scored where they are: nothing is joined or shuffled.
    """
    model, _ = train(docs, labels, **how)
    shared = broadcast_by_value(docs.sparkSession, model)
    columns = {c: docs.columns.index(c) if c in docs.columns else None for c in ("text", "lang", "source", "n_chars")}

    def run(batches):
        import numpy as np
        import pyarrow as pa

        ids, model = WordIds(), shared()
        vocabulary = [] if model.chosen is None else model.chosen
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(columns[c]) if columns[c] is not None else pa.nulls(batch.num_rows)
            words, dense = zip(*((select(w, vocabulary), d) for w, d in (text_features(t.as_py() or "", ids) for t in get("text"))))
            metas = [np.asarray(meta_features(*m), np.int64) for m in zip(*(get(c).to_pylist() for c in ("lang", "source", "n_chars")))]
            both = model.scores(words, np.array(dense, np.float64), metas)[2]
            yield batch.filter(pa.array(np.asarray(both) < threshold))
        ids.clear()

    return docs.mapInArrow(run, docs.schema)


def report(model: Model) -> str:
    return json.dumps(model.log)
