"""Personal data: base patterns, and contextual extraction that is bootstrapped from what they find."""

from __future__ import annotations

import bisect
import hashlib
import re
import secrets

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

KINDS = ("email", "ip", "card", "phone")

#: What a rule of the base set matches must still hold: see base_spans.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: A digit before means that the same digits were tried from their first one.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Shapes that may be identifiers of a kind, but that the base rules don't take. Context decides.
LOOSE = (
    ("email", re.compile(r"(?<![\w.+-])[\w.+-]{2,64} ?(?:\[at\]|\(at\)|\{at\}) ?[\w-]{2,64}(?: ?(?:\.|\[dot\]|\(dot\)|\{dot\}) ?[\w-]{2,64})+", re.IGNORECASE)),
    ("phone", re.compile(r"(?<![\w.+(-])(?:\([0-9]{2,4}\) ?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]|\.[0-9])")),
)
#: What may stand in the slot of a pattern: a run of tokens with a digit, an @ or a bracketed at or dot, or with punctuation alone between such.
_TOKEN = r"(?:[^\s0-9@\[({]*+(?:[0-9@]|[\[({](?:at|dot)[\])}]|[\[({](?!(?:at|dot)[\])}]))[^\s]*+)"
SLOT = re.compile(rf"(?<!\S){_TOKEN}(?:[^\S\n]+(?:[-/().:]+[^\S\n]+)?{_TOKEN})*+", re.IGNORECASE)
#: Words around an at: dots are words too, or stand within the last word.
SPELT = re.compile(r"(?<!\S)\S{1,64}[^\S\n]+at[^\S\n]+(?:\S{1,64}(?:[^\S\n]+dot[^\S\n]+\S{1,64})+|[\w-]+(?:\.[\w-]+)+)", re.IGNORECASE)
AT = re.compile(r"@|[\[({]at[\])}]", re.IGNORECASE)
#: No e-mail address is longer.
LONGEST = 254
#: A secret is a long string that a text assigns to a name for such.
SECRET = re.compile(r"(?<![A-Za-z])(?:token|secret|passw(?:or)?d|(?:api|access|private)[_-]?key)[\"']?[^\S\n]{0,8}[:=][^\S\n]{0,8}[\"']?([A-Za-z0-9+/_.=-]{16,512})", re.IGNORECASE)
OPEN, CLOSE = "([{<\"'", ".,;:!?)]}>\"'"
DOC_SCHEMA = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_secret long, base array<struct<start:int,kind:int,end:int>>, base_sha256 string, mentions array<struct<kind:int,start:int,end:int,value:binary,seed:boolean,slot:boolean,contexts:array<binary>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping; found from each @, in linear time."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(start, kind, end) of what the base rules take, and of matches that fail their check."""
    good, failed = [(s, 0, e) for s, e in emails(text)], []
    for m in IP.finditer(text):
        ok = all(len(p) <= 3 and int(p) <= 255 for p in ((x.lstrip("0") or "0") for x in m[0].split(".")))
        (good if ok else failed).append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        digits = NOT_DIGIT.sub("", m[0])
        if 12 <= len(digits) <= 19:
            (good if luhn(digits) else failed).append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            (good if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15 else failed).append((m.start(), 3, m.end()))
    return sorted(good), failed


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    if "at" in text.lower() and any(x in text for x in "[({"):
        out += [(m.start(), 0, m.end()) for m in LOOSE[0][1].finditer(text)]
    out += [(m.start(), 3, m.end()) for m in LOOSE[1][1].finditer(text)]
    return out


def bare(text: str, start: int, end: int) -> tuple[int, int]:
    """The span without punctuation at its ends; brackets that are closed or opened within it stay."""
    if start < end and text[start] in OPEN:
        # which marks are in the span doesn't change while the others are taken off, so each is looked for once
        kept = {a for a, b in zip("([{<", ")]}>") if text.find(b, start, end) >= 0}
        while start < end and text[start] in OPEN and text[start] not in kept:
            start += 1
    if start < end and text[end - 1] in CLOSE:
        kept = {b for a, b in zip("([{<", ")]}>") if text.find(a, start, end) >= 0}
        while start < end and text[end - 1] in CLOSE and text[end - 1] not in kept:
            end -= 1
    return start, end


def slot_spans(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end), by each kind that it may be, of what patterns may hold, in the gaps between the sorted spans in taken.

    An e-mail address has an at; a phone or card number has five digits; an IP address has a digit and a dot or colon.
    """
    runs = [m.span() for m in SLOT.finditer(text)]
    if " at " in text.lower():
        runs += [m.span() for m in SPELT.finditer(text)]
    out, i = set(), 0
    for start, end in sorted(runs):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        cuts, j = [start], i
        while j < len(taken) and taken[j][0] < end:
            cuts += [taken[j][0], taken[j][1]]
            j += 1
        cuts.append(end)
        for a, b in zip(cuts[::2], cuts[1::2]):
            while a < b and text[a].isspace():
                a += 1
            while a < b and text[b - 1].isspace():
                b -= 1
            a, b = bare(text, a, b)
            if not 0 < b - a <= LONGEST:
                continue
            value = text[a:b]
            digits = len(NOT_DIGIT.sub("", value))
            if AT.search(value) or SPELT.fullmatch(value):
                out.add((a, 0, b))
            elif digits:
                out |= {(a, 1, b)} if "." in value or ":" in value else set()
                out |= {(a, 2, b), (a, 3, b)} if digits >= 5 else set()
    return sorted(out)


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns around a span: two words before; one before and one after; two after."""
    clean = lambda words: [w.strip(".,;:!?()[]{}<>\"'").lower() for w in words]
    before, after = clean(text[max(0, start - 64) : start].split()[-2:]), clean(text[end : end + 64].split()[:2])
    out = []
    if len(before) == 2 and all(before):
        out.append(f"{before[0]} {before[1]} _")
    if before and after and before[-1] and after[0]:
        out.append(f"{before[-1]} _ {after[0]}")
    if len(after) == 2 and all(after):
        out.append(f"_ {after[0]} {after[1]}")
    return out


def overlapping(spans: list[tuple], taken: list[tuple[int, int]]) -> list[bool]:
    """For each of the spans (start, ..., end), sorted, whether it overlaps one of the sorted, disjoint spans in taken."""
    out, i = [], 0
    for start, *_, end in spans:
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        out.append(i < len(taken) and taken[i][0] < end)
    return out


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, overlapping ones merged."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def mentions(text: str) -> tuple[list, str, list]:
    """Base spans, the hash of their list, and all mentions that contexts may speak for: seeds and candidates."""
    good, failed = base_spans(text)
    said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in good)
    found = [(k, s, e, text[s:e].lower(), True, False, contexts(text, s, e)) for s, k, e in good]
    free, taken = 0, apart([(s, e) for s, _, e in good])
    loose = sorted(failed + loose_spans(text))
    for (s, k, e), over in zip(loose, overlapping(loose, taken)):
        if s >= free and not over:
            found.append((k, s, e, text[s:e].lower(), False, False, contexts(text, s, e)))
            free = e
    known = {(k, s, e) for k, s, e, *_ in found}
    for s, k, e in slot_spans(text, taken):
        if (k, s, e) not in known and (around := contexts(text, s, e)):
            found.append((k, s, e, text[s:e].lower(), False, True, around))
    return good, hashlib.sha256(said.encode()).hexdigest(), found


def scan(docs: DataFrame) -> DataFrame:
    """A row (DOC_SCHEMA) per document.

    Identifiers and the words around them leave the worker only as hashes under a key of this run, which isn't kept,
    so what is stored on the way tells nobody's data.
    """
    key = secrets.token_bytes(32)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        said = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.binary()), ("seed", pa.bool_()), ("slot", pa.bool_()), ("contexts", pa.list_(pa.binary()))]))
        types = [pa.int64()] * 7 + [span, pa.string(), said]
        names = [field.split()[0] for field in DOC_SCHEMA.split(", ")]
        hidden = lambda x: hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16, key=key).digest()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                good, sha, found = mentions(text)
                n = [sum(k == i for _, k, _ in good) for i in range(4)] + [len(SECRET.findall(text))]
                told = [{"kind": k, "start": s, "end": e, "value": hidden(v), "seed": seed, "slot": slot, "contexts": [hidden(c) for c in around]} for k, s, e, v, seed, slot, around in found]
                rows.append((row, doc, *n, [dict(zip(("start", "kind", "end"), g)) for g in good], sha, told))
                row += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, DOC_SCHEMA)


def accepted(said: DataFrame, rounds: int = 3, confidence: float = 0.8, support: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """(kind, value, score) of the candidates that confident patterns speak for, and the (pattern, kind) that do.

    said: (kind, value, seed, pattern), a stored table. A pattern's confidence for a kind is the sum of the scores of
    its different values of that kind over the number of all its different values plus one; seeds score 1. A value's
    score is one minus the product of (1 - confidence) over its patterns of at least `support` and half confidence.
    After each round values of enough score count for their patterns.
    """
    values = said.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    wanted = values.where("not seed").select("pattern").distinct()
    graph = materialize(values.join(wanted, "pattern", "left_semi"), "pii-graph")
    links = graph.where("not seed")
    fixed = materialize(graph.groupBy("pattern").agg(*[F.sum(((F.col("kind") == k) & F.col("seed")).cast("double")).alias(f"s{k}") for k in range(len(KINDS))], F.count_distinct("value").alias("n")), "pii-patterns")
    scores = None
    for _ in range(rounds):
        known = fixed
        if scores is not None:
            more = links.join(scores, ["kind", "value"]).groupBy("pattern").agg(*[F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(f"m{k}") for k in range(len(KINDS))])
            known = fixed.join(more, "pattern", "left")
            known = known.select("pattern", "n", *[(F.col(f"s{k}") + F.coalesce(f"m{k}", F.lit(0.0))).alias(f"s{k}") for k in range(len(KINDS))])
        sums = F.array(*[f"s{k}" for k in range(len(KINDS))])
        good = known.select("pattern", F.posexplode(sums).alias("kind", "sum"), "n").select("pattern", "kind", "sum", (F.col("sum") / (F.col("n") + 1)).alias("conf"))
        good = good.where((F.col("sum") >= support) & (F.col("conf") >= 0.5))
        made = links.join(good, ["pattern", "kind"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log1p(-F.col("conf"))))).alias("score"))
        held = good
        scores = materialize(made.where(F.col("score") >= confidence), "pii-scores")
    return scores.select("kind", "value", "score"), materialize(held.select("pattern", "kind"), "pii-confident")


def best_apart(found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
    """Of spans (start, kind, end, score) those that stay, sorted: the longest first, of one length the best score, then the first.

    None overlaps one that stays. Those are kept in order, so a span is compared with its neighbours there only.
    """
    starts: list[int] = []
    kept: list[tuple[int, int, int]] = []
    for s, k, e, _ in sorted(found, key=lambda x: (x[0] - x[2], -x[3], x[0], x[1])):
        i = bisect.bisect_left(starts, s)
        if (i == 0 or kept[i - 1][2] <= s) and (i == len(kept) or e <= starts[i]):
            starts.insert(i, s)
            kept.insert(i, (s, k, e))
    return kept


def longest_apart(rows: DataFrame) -> DataFrame:
    """(row, _added) of rows (row, found): best_apart() for each."""

    def run(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
        fields = ("start", "kind", "end")
        for batch in batches:
            kept = [[dict(zip(fields, x)) for x in best_apart([tuple(x.values()) for x in found.as_py()])] for found in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, span)], ["row", "_added"])

    return rows.mapInArrow(run, "row long, _added array<struct<start:int,kind:int,end:int>>")


def find_personal_data(docs: DataFrame, rounds: int = 3, confidence: float = 0.8, support: float = 3.0) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256, spans, n_found (spans that contexts added), n_secret
    (strings assigned to names for tokens, keys and passwords) and n_private (all of these together) per row.

    Base spans are those of the four rules. They are seeds: the words around them make patterns, and candidates -
    matches that failed a rule's check, looser shapes, and whatever has the signs of slot_spans() - are added where
    patterns of enough confidence, scored against all documents, hold them; the last only where such a pattern is
    around them in that very place. Added spans never overlap base ones or each other: the longest stays, and of one
    span the kind of the best score.
    Null text: as an empty one, no spans. Null doc_id: kept. Equal rows have equal results each; an empty table gives
    an empty table. Columns other than doc_id and text are ignored.
    Whole texts are scanned once, in linear time, and a text's added spans are sorted, never compared in pairs; only mentions with their few words around are stored, as keyed
    hashes, and grouped.
    """
    seen = materialize(scan(docs), "pii-scan")
    said = seen.select(F.inline("mentions")).select("kind", "value", "seed", F.explode("contexts").alias("pattern"))
    good, held = accepted(said, rounds, confidence, support)
    spoken = seen.select("row", F.inline("mentions")).where("not seed").join(good, ["kind", "value"])
    place = ["row", "kind", "start", "end", "score"]
    here = spoken.where("slot").select(*place, F.explode("contexts").alias("pattern")).join(held, ["pattern", "kind"], "left_semi").select(*place).distinct()
    every = spoken.where("not slot").select(*place).union(here)
    added = longest_apart(every.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end", "score")).alias("found")))
    names = F.array(*[F.lit(k) for k in KINDS])
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    every = F.array_sort(F.concat("base", F.coalesce("_added", none)))
    spans = F.array_join(F.transform(every, lambda s: F.concat(F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    n_found = F.when(F.col("_added").isNull(), F.lit(0)).otherwise(F.size("_added")).cast("long")
    n_private = F.size(every).cast("long") + F.col("n_secret")
    return seen.join(added, "row", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", spans.alias("spans"), n_found.alias("n_found"), "n_secret", n_private.alias("n_private"))
