"""Removes passages that repeat: three-line windows, found globally by hash. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize, private

WINDOW = 3
#: A line ends where the text says so: at a line break, or, from LEAST words on, after a word that ends a sentence. Where
#: neither comes within WRAP words, it ends after the first word, from LEAST words on, that ends with one of CUTS.
LEAST, WRAP = 3, 16
#: The marks that end a sentence.
ENDS = ".!?"
#: Every fourth letter of the Latin, Greek and Cyrillic alphabets: about every fifth word ends with one.
CUTS = "dhlptxDHLPTXδθμπυωΔΘΜΠΥΩгзлпучыяГЗЛПУЧЫЯ"
SPACE = " \t\n\x0b\f\r"


def line_pattern(wrap: int = WRAP) -> str:
    """A line with the white space around it; all lines of a text make up the text."""
    space, gap = r"\x20\t\n\x0b\f\r", r"[\x20\t\x0b\f\r]"
    word, least = f"[^{space}]++", min(LEAST, wrap)
    # a word that isn't the last one before a line break; so no count has to be taken back
    first = f"(?:{word}{gap}++(?=[^{space}]))"
    within = lambda marks: f"(?:{word}(?<![{marks}]){gap}++(?=[^{space}])){{0,{wrap - least}}}+"
    ended = rf"{first}{{0,{least - 1}}}+{within(ENDS)}{word}(?:(?<=[{ENDS}])[{space}]*+|{gap}*+(?:\n[{space}]*+|\z))"
    cut = f"{first}{{{least - 1}}}+{within(CUTS)}{word}[{space}]*+"
    return f"[{space}]*+(?:{ended}|{cut})"


def lines(text: Column, wrap: int = WRAP) -> Column:
    return F.regexp_extract_all(text, F.lit(line_pattern(wrap)), F.lit(0))


def window_hashes(found: Column, min_bytes: int = 0) -> Column:
    """At each window's first line the hash of its lines without the white space around them, or null if it has fewer bytes than min_bytes."""
    bare = F.transform(found, lambda x: F.btrim(x, F.lit(SPACE)))
    marks = F.transform(bare, lambda x: F.struct(F.xxhash64(x).alias("h"), F.octet_length(x).alias("w")))

    def window(marks: Column) -> Column:
        at = lambda i, k: F.get(marks, i + k)
        size = lambda i: sum((at(i, k)["w"] for k in range(1, WINDOW)), at(i, 0)["w"])
        hashed = lambda i: F.xxhash64(*[at(i, k)["h"] for k in range(WINDOW)])
        starts = F.when(F.size(marks) >= WINDOW, F.sequence(F.lit(0), F.size(marks) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.when(size(i) >= min_bytes, hashed(i)) if min_bytes else hashed(i))

    return _let(marks, window)


def _let(value: Column, use) -> Column:
    """use(value), with value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def own_repeats(hashes: Column) -> Column:
    """Positions of windows that occur before in the same text, and don't overlap the first of their kind there."""

    def later(pairs: Column) -> Column:
        """Runs of equal hashes in the sorted list, each compared with its first position only."""
        other = lambda x, i: (i == 0) | (F.get(pairs, i - 1)["h"] != x["h"])
        begins = F.filter(F.transform(pairs, lambda x, i: F.when(other(x, i), i)), lambda i: i.isNotNull())

        def run(begins: Column) -> Column:
            end = lambda k: F.coalesce(F.get(begins, k + 1), F.size(pairs))
            rest = lambda b, k: F.transform(F.slice(pairs, b + 1, end(k) - b), lambda x: x["p"])
            return F.flatten(F.transform(begins, lambda b, k: F.filter(rest(b, k), lambda p: p >= F.get(pairs, b)["p"] + WINDOW)))

        return _let(begins, run)

    pairs = F.sort_array(F.filter(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))), lambda x: x["h"].isNotNull()))
    known = F.filter(hashes, lambda h: h.isNotNull())
    return F.when(F.size(F.array_distinct(known)) < F.size(known), _let(pairs, later)).otherwise(F.array().cast("array<int>"))


def merged(positions: Column) -> Column:
    """Sorted window positions as disjoint spans [first line, line after the last)."""

    def spans(p: Column) -> Column:
        begins = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) + WINDOW < x))
        ends = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + WINDOW))
        return F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("first"), (b + WINDOW).alias("end")))

    return _let(F.sort_array(F.array_distinct(positions)), spans)


def without(found: Column, spans: Column) -> Column:
    """The text of all lines outside of the spans."""

    def gap(spans: Column, i: Column) -> Column:
        begin = F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["end"])
        end = F.when(i == F.size(spans), F.size(found)).otherwise(F.get(spans, i)["first"])
        return F.array_join(F.slice(found, begin + 1, end - begin), "")

    return _let(spans, lambda s: F.array_join(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: gap(s, i)), ""))


def dedup_lines(docs: DataFrame, wrap: int = WRAP, min_bytes: int = 0) -> DataFrame:
    """docs with text rewritten, and n_removed (lines) and removed (spans of lines) added.

    Lines are those of the text, cut further after each word that ends a sentence, unless that makes a line of less
    than LEAST words. A stretch of more than `wrap` words without either is cut after words that end with one of CUTS,
    as far apart. So a passage in the middle of a paragraph is made of the same lines wherever it stands, but for a few
    at its beginning. Only where no such word comes is a line cut after `wrap` words, and hangs on what is before it. Every window of three consecutive lines is hashed. Of the windows with one
    hash, all but those of the first document that has it are later occurrences, and so are those further down in that
    document unless they overlap the first there. The lines that later occurrences cover are removed.

    Documents go by doc_id, those without one last; rows that share a doc_id, or have none, by a hash of their text,
    and are documents of their own. Rows equal in doc_id and text are one document: they get the same result.
    Null, empty and white-space texts, and those of fewer than three lines, stay as they are. With min_bytes, windows
    of fewer bytes are no passage. An empty table gives an empty table. Further columns stay, but for the two added
    names, which are replaced.

    Only hashes, ids and positions are grouped. The grouped minimum is combined before the shuffle, and the join that
    follows is one that Spark splits where a passage is very common; texts are shuffled once, for their rewriting.
    Work is linear in a text's length, but for sorting its hashes.
    """
    own = private([*docs.columns, "n_removed", "removed"])
    key, mark, later = own("key"), own("mark"), own("later")
    place = {key: F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), mark: F.xxhash64("text")}
    hashed = docs.select(*[c.alias(n) for n, c in place.items()], window_hashes(lines(F.col("text"), wrap), min_bytes).alias("h"))
    listed = F.transform("h", lambda h, i: F.struct(h.alias("h"), i.alias("p"), F.lit(False).alias("own")))
    repeats = F.transform(own_repeats(F.col("h")), lambda p: F.struct(F.lit(None).cast("long").alias("h"), p.alias("p"), F.lit(True).alias("own")))
    windows = materialize(hashed.select(key, mark, F.inline(F.concat(listed, repeats))).where("h is not null or own"), "line-windows")

    at = F.struct(key, mark)
    first = windows.where("not own").groupBy("h").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    covered = windows.where("not own").join(materialize(first, "line-repeats"), "h").where(at > F.col("first")).select(key, mark, "p")
    covered = covered.union(windows.where("own").select(key, mark, "p")).groupBy(key, mark).agg(F.collect_set("p").alias(later))

    kept = [c for c in docs.columns if c.lower() not in ("n_removed", "removed")]
    joined = docs.select(*kept, *[c.alias(n) for n, c in place.items()]).join(covered, [key, mark], "left")
    no_spans = F.array().cast("array<struct<first:int,end:int>>")
    marked = joined.withColumn("removed", F.when(F.col(later).isNull(), no_spans).otherwise(merged(F.col(later))))
    rewritten = _let(lines(F.col("text"), wrap), lambda found: without(found, F.col("removed")))
    return (
        marked.withColumn("n_removed", F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"]))
        .withColumn("text", F.when(F.col(later).isNotNull(), rewritten).otherwise(F.col("text")))
        .select(*kept, "n_removed", "removed")
    )
