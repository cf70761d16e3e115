import random
import re
import time

import xxhash

from lorequarry.llm import line_dedup

from .conftest import paragraphs, sentence

SPACE = " \t\n\x0b\f\r"


class LINE:
    @staticmethod
    def findall(text):
        """The lines of a text, word by word."""
        parts = re.findall(f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", text)
        out, at = [], 0
        while at < len(parts):
            words = [p.strip(SPACE) for p in parts[at : at + 16]]
            broken = [i + 1 for i in range(len(words)) if at + i + 1 == len(parts) or "\n" in parts[at + i][parts[at + i].index(words[i]) + len(words[i]) :]]
            n = broken[0] if broken else None
            ends = [i + 1 for i, w in enumerate(words[:n]) if i >= 2 and w[-1] in ".!?"]
            cuts = [i + 1 for i, w in enumerate(words) if i >= 2 and w[-1] in line_dedup.CUTS]
            n = ends[0] if ends else n or (cuts[0] if cuts else 16)
            out.append("".join(parts[at : at + n]))
            at += n
        return out


def place(doc, text):
    """Documents go by id, those without one last, and then by Spark's hash of the text."""
    h = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return (2**63 - 1 if doc is None else doc, h - (h >> 63 << 64))


def brute(rows, min_bytes=0):
    """rows (doc_id, text) -> (doc_id, text, removed lines), compared window by window in order of documents."""
    split = [(doc, text, LINE.findall(text or "")) for doc, text in rows]
    least = {}
    windows = []
    for doc, text, found in split:
        bare = [x.strip(" \t\n\x0b\f\r") for x in found]
        own = [(i, tuple(bare[i : i + 3])) for i in range(len(bare) - 2) if sum(len(b.encode()) for b in bare[i : i + 3]) >= min_bytes]
        windows.append(own)
        for _, w in own:
            least[w] = min(least.get(w, place(doc, text)), place(doc, text))
    out = []
    for (doc, text, found), own in zip(split, windows):
        gone, first = set(), {}
        for i, w in own:
            first.setdefault(w, i)
            if place(doc, text) > least[w] or i >= first[w] + 3:
                gone |= {i, i + 1, i + 2}
        out.append((doc, "".join(x for i, x in enumerate(found) if i not in gone) if gone else text, len(gone)))
    return sorted(out, key=str)


def result(df, **how):
    return sorted(((r.doc_id, r.text, r.n_removed) for r in line_dedup.dedup_lines(df, **how).collect()), key=str)


def prose(rng, sentences):
    """Sentences of 3 to 14 words in one paragraph."""
    return " ".join(sentence(rng, rng.randrange(3, 15)).capitalize() + rng.choice([".", ".", "!", "?"]) for _ in range(sentences))


def test_equals_brute_force(spark):
    rng = random.Random(4)
    passages = [paragraphs(rng, n, w) for n, w in ((3, 20), (1, 60), (5, 10), (2, 40), (4, 3))]
    rows = []
    for i in range(80):
        parts = [paragraphs(rng, rng.randrange(0, 5), rng.choice([4, 12, 40]))]
        for _ in range(rng.randrange(3)):
            parts += [rng.choice(passages), paragraphs(rng, rng.randrange(0, 4))]
        rows.append((i, "\n".join(p for p in parts if p)))
    line = sentence(rng, 6)
    rows += [(100, "\n".join([line] * 30)), (101, "\n".join([line, line[::-1]] * 20)), (102, rows[3][1]), (103, rows[3][1]), (104, sentence(rng, 300) * 2)]
    rows += [(200 + i, prose(rng, rng.randrange(1, 9)) + (" " + prose(random.Random(i % 4), 6) + " " if i % 2 else "\n") + prose(rng, 3)) for i in range(30)]
    rows += [(300, "a\nb\nc"), (301, "a\nb\nc"), (302, "x a\nb\nc\nd"), (None, "q. r. s. t."), (None, "u. q. r. s."), (303, "u v w\n" + rows[7][1]), (303, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df) == brute(rows)
    assert result(df, min_bytes=40) == brute(rows, 40)


def test_short_passages_and_rows_without_id_count_too(spark):
    rows = [(1, "a\nb\nc"), (2, "a\nb\nc"), (None, "one two\nthree four\nfive six\nseven"), (None, "zero\none two\nthree four\nfive six")]
    out = result(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sum(n for _, _, n in out) == 6 and (2, "", 3) in out


def test_a_passage_is_found_wherever_it_stands_in_a_paragraph(spark):
    rng = random.Random(21)
    rows, passages = [], []
    for i in range(100):
        passages.append(prose(rng, 8))
        rows += [(2 * i, prose(rng, rng.randrange(1, 6)) + " " + passages[-1] + " " + prose(rng, 2)), (2 * i + 1, prose(rng, rng.randrange(1, 6)) + " " + passages[-1] + " " + prose(rng, 2))]
    assert min(len(p.split()) for p in passages) > 40
    out = dict((d, t) for d, t, _ in result(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(out[2 * i] == rows[2 * i][1] for i in range(100))
    assert sum(passages[i] in out[2 * i + 1] for i in range(100)) == 0


def test_a_passage_without_marks_is_found_wherever_it_stands(spark):
    rng = random.Random(22)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(3000)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    for length in (80, 55):
        passages = [some(length) for _ in range(60)]
        rows = [(2 * i + k, f"{some(rng.randrange(5, 60))} {p} {some(rng.randrange(5, 60))}") for i, p in enumerate(passages) for k in (0, 1)]
        found = [d for d, _, n in result(spark.createDataFrame(rows, "doc_id long, text string")) if n]
        assert len(found) >= 58 and all(d % 2 for d in found)


def test_lines_make_up_the_text_and_white_space_is_that_of_ascii(spark):
    rng = random.Random(23)
    parts = ["wool", "den.", "is", "x", "ah!", "no?", "ø", "Ω", " ", "  ", "\n", "\t", "\x0b", "\f", "\r", "\xa0", "\x1c"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", line_dedup.lines(line_dedup.F.col("text")).alias("found")).collect()
    for r in got:
        assert list(r.found) == LINE.findall(texts[r.i]), texts[r.i]
        assert "".join(r.found) == texts[r.i] or not texts[r.i].strip(SPACE)


def test_very_long_texts_take_linear_time(spark):
    rows = [(1, "the same line again\n" * 250_000), (2, "".join(f"line {i % 1000}\n" for i in range(250_000)))]
    began = time.time()
    out = dict((d, n) for d, _, n in result(spark.createDataFrame(rows, "doc_id long, text string")))
    # of the first all but the first window and what overlaps it, of the second all but the first round
    assert out[1] == 250_000 - 3 and out[2] >= 249_000 - 2
    assert time.time() - began < 60


def test_clashing_columns_come_back(spark):
    names = ["__key", "__mark", "__later", "h", "p", "own", "first", "last"]
    rows = [(i, "a b c\nd e f\ng h i", *[f"{n}{i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed", "removed"]
    assert sorted(r[2 : 2 + len(names)] for r in out.collect()) == [tuple(f"{n}{i}" for n in names) for i in range(3)]
    assert sorted(r.n_removed for r in out.collect()) == [0, 3, 3]


def test_a_passage_on_one_physical_line_goes_and_the_rest_stays(spark):
    rng = random.Random(9)
    passage, before, after = sentence(rng, 55), paragraphs(rng, 2), paragraphs(rng, 2)
    rows = [(1, paragraphs(rng, 2) + "\n" + passage), (2, before + "\n" + passage + "\n" + after)]
    out = dict((d, t) for d, t, _ in result(spark.createDataFrame(rows, "doc_id long, text string")))
    assert out[1] == rows[0][1] and out[2] == before + "\n" + after


def test_odd_rows(spark, odd, odd_rows):
    assert result(odd) == brute([r[:2] for r in odd_rows])
    out = line_dedup.dedup_lines(odd)
    assert odd.columns == [c for c in out.columns if c not in ("n_removed", "removed")]


def test_empty_table(none):
    assert line_dedup.dedup_lines(none).count() == 0
