"""SQL for DuckDB of the queries that SQL can express."""

from __future__ import annotations

import string

#: Everything that links reach from a document, by CTEs n (id) and e (a, b).
REACH = "r AS (SELECT id AS a, id AS b FROM n UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b)"

_DOT = "list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))"
EMBEDDINGS = f"""WITH RECURSIVE
u AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings),
k AS (SELECT id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS size FROM u
  WHERE label IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
n AS (SELECT id FROM u),
e AS (SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.label = b.label AND a.id <> b.id AND len(a.v) = len(b.v)
  WHERE a.size > 0 AND b.size > 0 AND {_DOT} / (a.size * b.size) >= 0.98),
{REACH}
SELECT n.id AS vec_id, (SELECT count(*) FROM e WHERE e.a = n.id) AS n_links, min(r.b) AS component_id, n.id = min(r.b) AS kept FROM n JOIN r ON r.a = n.id GROUP BY n.id"""

#: What a line is, without looking around: the white space, the words before its last one, and the three ways to end.
_S, _GAP = r"\x20\t\n\x0b\f\r", r"[\x20\t\x0b\f\r]+"
_CUTS = "dhlptxDHLPTXδθμπυωΔΘΜΠΥΩгзлпучыяГЗЛПУЧЫЯ"
_SENTENCE = rf"(?:[^{_S}]+{_GAP}){{2}}(?:[^{_S}]*[^{_S}.!?]{_GAP}){{0,13}}[^{_S}]*[.!?](?:[{_S}]+|\z)"
_BROKEN = rf"(?:[^{_S}]+{_GAP}){{0,2}}(?:[^{_S}]*[^{_S}.!?]{_GAP}){{0,13}}[^{_S}]+(?:[\x20\t\x0b\f\r]*\n[{_S}]*|[{_S}]*\z)"
_CUT = rf"(?:[^{_S}]+{_GAP}){{2}}(?:[^{_S}]*[^{_S}{_CUTS}]{_GAP}){{0,13}}[^{_S}]+[{_S}]*"
LINES = rf"""WITH
l AS (SELECT doc_id, text, regexp_extract_all(text, '[{_S}]*(?:{_SENTENCE}|{_BROKEN}|{_CUT})') AS ls FROM documents),
x AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM l),
t AS (SELECT doc_id, i, line, regexp_replace(regexp_replace(line, '^[{_S}]+', ''), '[{_S}]+$', '') AS s FROM x),
c AS (SELECT doc_id, i, s, lead(s) OVER o AS s2, lead(s, 2) OVER o AS s3 FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
w AS (SELECT doc_id, i, [s, s2, s3] AS w FROM c WHERE s3 IS NOT NULL),
f AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w),
o AS (SELECT doc_id, w, min(i) AS first FROM w GROUP BY ALL),
g AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM w JOIN f USING (w) JOIN o USING (doc_id, w) WHERE doc_id > least OR i >= first + 3),
m AS (SELECT t.doc_id, coalesce(string_agg(line, '' ORDER BY t.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS n_removed FROM t LEFT JOIN g ON g.doc_id = t.doc_id AND g.i = t.i GROUP BY t.doc_id)
SELECT d.doc_id, CASE WHEN n_removed > 0 THEN m.text ELSE d.text END AS text, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN m USING (doc_id)"""

_DIGIT = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * g + 1, 5))::BIGINT >> {}) % 32 + 1, 1)"
_GROUP = " || ".join(_DIGIT.format(bits) for bits in (15, 10, 5, 0))
PAGES = f"""WITH
p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes, array_to_string(list_transform(range(8), lambda g: {_GROUP}), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (html)"""

SHINGLES = rf"""WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id AS id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT id, len(s) AS n FROM s),
x AS (SELECT id, unnest(s) AS g FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n i ON i.id = p.a JOIN n j ON j.id = p.b WHERE 100 * c >= 80 * (i.n + j.n - c)),
{REACH}
SELECT n.id AS doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.id GROUP BY ALL"""


#: One step of CRC-32 (the reflected polynomial) for a byte, and that of a whole string of digits.
_BYTE = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(c, b))"
_CRC = "xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT), lambda c, b: {}, 4294967295::BIGINT), 4294967295)"
#: Levels of the trees: enough for FAN ** HEIGHT leaves of a language, and as many languages.
HEIGHT = 7


def _tree(name: str, base: str) -> str:
    """CTEs name0 (g, pos, n, d), ..., one for each level; and name0_s, ... with the siblings a and z of each node."""
    out = [f"{name}0 AS ({base})"]
    for k in range(HEIGHT):
        run = "PARTITION BY g, pos // 8 ORDER BY pos ROWS BETWEEN"
        out.append(f"""{name}{k}_s AS (SELECT g, pos, n, CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') END AS a,
  CASE WHEN n > 1 THEN coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') END AS z FROM {name}{k})""")
        out.append(f"{name}{k + 1} AS (SELECT g, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE any_value(d) END AS d FROM {name}{k} GROUP BY g, pos // 8)")
    return ",\n".join(out)


def _manifest() -> str:
    held = lambda value: f"coalesce(strlen({value}) || ':' || {value}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(held(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    steps = [("lang", f"l{k}_s", f"y.pos // {8**k}", "y.g") for k in range(HEIGHT)] + [("top", f"t{k}_s", f"y.top // {8**k}", "'all'") for k in range(HEIGHT)]
    joins = " ".join(f"JOIN {table} s{i} ON s{i}.g = {g} AND s{i}.pos = {pos}" for i, (_, table, pos, g) in enumerate(steps))
    siblings = " || ".join(f"coalesce(s{i}.a || s{i}.z, '')" for i in range(len(steps)))
    sides = ", ".join(f"s{i}.a AS a{i}, s{i}.z AS z{i}" for i in range(len(steps)))
    folds = ",\n".join(f"f{i + 1} AS (SELECT * EXCLUDE (d), CASE WHEN a{i} IS NULL THEN d ELSE sha256(a{i} || d || z{i}) END AS d FROM f{i})" for i in range(len(steps)))
    return f"""WITH
d AS (SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, {leaf("text")} AS leaf,
  CASE WHEN {_CRC.format(_BYTE)} % 3 = 0 AND text IS NOT NULL THEN {leaf(lower)} ELSE {leaf("text")} END AS changed FROM documents),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM d),
{_tree("l", "SELECT g, pos, n, leaf AS d FROM x")},
u AS (SELECT g, d, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM l{HEIGHT}),
{_tree("t", "SELECT 'all' AS g, pos, n, d FROM u")},
y AS (SELECT x.*, u.pos AS top, u.d AS subroot, (SELECT d FROM t{HEIGHT}) AS root FROM x JOIN u USING (g)),
f0 AS (SELECT y.doc_id, y.leaf, y.subroot, y.root, sha256({siblings}) AS proof_sha256, {sides}, y.changed AS d FROM y {joins}),
{folds}
SELECT doc_id, leaf, subroot, root, proof_sha256, d AS folded_root, d = root AS verified FROM f{len(steps)}"""


_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"
AUDIT = rf"""WITH RECURSIVE
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS} AS words, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
m AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
  + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN doc_id > least THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, good, toxic, count(*) AS rows FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT '' AS filter_order, 0 AS used UNION ALL SELECT filter_order || f, used | bit FROM o JOIN f ON used & bit = 0),
p AS (SELECT filter_order FROM o WHERE used = 31),
s AS (SELECT filter_order, step, bit, coalesce(sum(bit) OVER (PARTITION BY filter_order ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM p) JOIN f ON f = substr(filter_order, step, 1)),
g AS (SELECT c.*, s.*, mask & bit <> 0 AS fails, mask & before <> 0 AS earlier FROM c CROSS JOIN s)
SELECT part, filter_order, step, coalesce(sum(rows) FILTER (WHERE NOT fails AND NOT earlier), 0)::BIGINT AS kept,
  coalesce(sum(rows) FILTER (WHERE fails AND NOT earlier), 0)::BIGINT AS removed, coalesce(sum(rows) FILTER (WHERE fails AND earlier), 0)::BIGINT AS redundant,
  coalesce(sum(rows) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(rows) FILTER (WHERE fails AND NOT earlier AND good), 0)::BIGINT AS good_lost,
  coalesce(sum(rows) FILTER (WHERE fails AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost,
  (sum(sum(rows) FILTER (WHERE fails AND NOT earlier)) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM g GROUP BY part, filter_order, step, bit"""


def oracle_sql() -> dict[str, str]:
    return {"op4_embedding_dedup": EMBEDDINGS, "op7_line_dedup": LINES, "op8_warc": PAGES, "op10_ngram_join": SHINGLES, "op12_manifest": _manifest(), "op13_filter_audit": AUDIT}
