"""Text functions as columns: extraction, MIME types, hashes, tokens, token windows and entities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import check_windows

#: MIME types by file extension.
MIME_TYPES = {
    "md": "text/markdown",
    "markdown": "text/markdown",
    "txt": "text/plain",
    "html": "text/html",
    "htm": "text/html",
    "json": "application/json",
    "yaml": "application/x-yaml",
    "yml": "application/x-yaml",
    "pdf": "application/pdf",
    "csv": "text/csv",
    "rs": "text/x-rust",
}
#: What a rule extracts, as (kind, pattern). The name is the first group.
LINK = ("reference", r"\[([^\]]+)\]\(([^)]+)\)")
TAG = ("tag", r"(?U)(?:^|\s)#([a-zA-Z][\w-]{1,})")
HEADING = ("section", r"(?Udm)^#{1,6}\s+(.+)")

#: What a text holds if it has a match of one of these rules.
MARKS = {LINK[0]: "](", TAG[0]: "#", HEADING[0]: "#"}

#: What the extended rules extract besides.
WIKI_LINK = ("reference", r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]")
FRONT = r"\A---\s*\n([\s\S]*?)\n---\s*(?:\n|\z)"
FRONT_KEYS = {"tags": "tag", "aliases": "alias"}


def html_to_text(html: Column) -> Column:
    """Without tags, white space collapsed. A stray > goes, an unclosed < takes the rest; entities stay as they are."""
    return F.regexp_replace(F.regexp_replace(html, r"<[^>]*>?|>", ""), r"(?U)\s+", " ")


def extract_text(content: Column, source: Column) -> Column:
    """Markdown as it is, HTML as text, anything else as it is: by the source's ending, or "markdown" within it."""
    lower = F.lower(source)
    markdown = lower.endswith(".md") | lower.endswith(".markdown") | F.contains(source, F.lit("markdown"))
    html = lower.endswith(".html") | lower.endswith(".htm")
    return F.when(~F.coalesce(markdown, F.lit(False)) & F.coalesce(html, F.lit(False)), html_to_text(content)).otherwise(content)


def mime_of(name: Column) -> Column:
    """The MIME type of a name's extension: after the last dot of the last path segment, unless that dot comes first."""
    segment = F.regexp_extract(name, r"([^/]*)/*$", 1)
    extension = F.lower(F.regexp_extract(segment, r"^.+\.([^.]*)$", 1))
    known = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    return F.try_element_at(known, extension)


def mime_type(source: Column, title: Column, file_title: Column) -> Column:
    return F.coalesce(mime_of(source), mime_of(title), mime_of(file_title))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def decode_base64(encoded: Column) -> Column:
    """Text of base64, white space ignored; null where it isn't base64 of valid UTF-8."""
    data = F.try_to_binary(F.regexp_replace(encoded, r"\s", ""), F.lit("base64"))
    return F.try_validate_utf8(data.cast("string"))


def analyzed(text: Column) -> Column:
    """Index terms: runs of letters and runs of digits, lower-cased."""
    # a-z and 0-9 are named as most characters are among them; nothing follows a run, so none is tried shorter
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z\p{L}]++|[0-9\p{N}]++"), F.lit(0))


def whitespace_tokens(text: Column) -> Column:
    """Tokens with the white space after them; together they are the text from its first token on."""
    return F.regexp_extract_all(text, F.lit(r"\S++\s*+"), F.lit(0))


def window_count(tokens: Column, max_tokens: int, overlap_tokens: int) -> Column:
    check_windows(max_tokens, overlap_tokens)
    step = max_tokens - overlap_tokens
    return F.when(tokens == 0, 0).when(tokens <= max_tokens, 1).otherwise(F.ceil((tokens - overlap_tokens) / step)).cast("long")


def windows(tokens: Column, max_tokens: int, overlap_tokens: int, starts: bool = False) -> Column:
    """Overlapping windows as (idx, content, token_count): content is the exact stretch of text, without white space at its end.

    With starts there is start too: where content begins, in code points from the first token's beginning.
    """
    check_windows(max_tokens, overlap_tokens)
    step = max_tokens - overlap_tokens
    total = lambda sizes: F.aggregate(sizes, F.lit(0).cast("long"), lambda n, x: n + x)

    def cut(tokens: Column) -> Column:
        count = window_count(F.size(tokens), max_tokens, overlap_tokens)
        numbers = F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
        # of the tokens between a window's first and the next one's
        sizes = F.transform(numbers, lambda i: total(F.transform(F.slice(tokens, i * step + 1, F.lit(step)), lambda t: F.length(t))))

        def window(i: Column, *more: Column) -> Column:
            part = F.slice(tokens, i * step + 1, F.lit(max_tokens))
            content = F.regexp_replace(F.array_join(part, ""), r"\s+$", "")
            return F.struct(i.cast("long").alias("idx"), content.alias("content"), F.size(part).cast("long").alias("token_count"), *more)

        if not starts:
            return F.transform(numbers, lambda i: window(i))
        return once(sizes, lambda sizes: F.transform(numbers, lambda i: window(i, total(F.slice(sizes, 1, i)).alias("start"))))

    return once(tokens, cut)


def once(value: Column, use) -> Column:
    """use(value), with value as a variable of a lambda: it is made once for a row, not once for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def with_mark(text: Column, mark: str, found: Column, kind: str) -> Column:
    """found, which is empty for a text without the mark; that is searched first, as most texts have none. Null stays null."""
    return F.when(~F.contains(text, F.lit(mark)), F.array().cast(kind)).otherwise(found)


def clean_name(name: Column) -> Column:
    """An entity's identity: its name without the characters that quote identifiers."""
    return F.regexp_replace(name, r"[⟨⟩\\']", "")


def entities(text: Column) -> Column:
    """(name, kind) of links, then tags, then headings, each in order of occurrence; names that clean to nothing are left out."""
    pick = lambda rule: with_mark(text, MARKS[rule[0]], F.regexp_extract_all(text, F.lit(rule[1]), F.lit(1)), "array<string>")
    named = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    headings = F.transform(F.filter(pick(HEADING), lambda h: F.octet_length(h) > 2), lambda h: F.regexp_replace(h, r"(?U)^\s+|\s+$", ""))
    every = F.concat(named(pick(LINK), LINK[0]), named(pick(TAG), TAG[0]), named(headings, HEADING[0]))
    return F.filter(every, lambda e: clean_name(e["name"]) != "")


def front_matter(text: Column, key: str) -> Column:
    """The values of a key of YAML front matter: [a, b], a list of lines - a, or one value; without quotes."""
    block = F.regexp_extract(text, FRONT, 1)
    inline = F.regexp_extract(block, rf"(?m)^{key}:[^\S\n]*\[([^\]]*)\]", 1)
    one = F.regexp_extract(block, rf"(?m)^{key}:[^\S\n]*([^\s\[][^\n]*)$", 1)
    listed = F.regexp_extract_all(F.regexp_extract(block, rf"(?m)^{key}:[^\S\n]*\n((?:[^\S\n]*-[^\n]*(?:\n|\z))+)", 1), F.lit(r"(?m)^[^\S\n]*-[^\S\n]*([^\n]*)$"), F.lit(1))
    every = F.concat(F.split(inline, ","), F.array(one), listed)
    bare = F.transform(every, lambda v: F.regexp_replace(v, r"^[\s\"']+|[\s\"']+$", ""))
    return F.filter(bare, lambda v: v != "")


def extended_entities(text: Column) -> Column:
    """entities(), then those of [[wiki links]], then the tags and aliases of front matter, each once."""
    named = lambda names, kind: F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("kind")))
    trimmed = F.transform(F.regexp_extract_all(text, F.lit(WIKI_LINK[1]), F.lit(1)), lambda n: F.btrim(n))
    more = F.concat(named(trimmed, WIKI_LINK[0]), *[named(front_matter(text, key), kind) for key, kind in FRONT_KEYS.items()])
    return F.array_distinct(F.concat(entities(text), F.filter(more, lambda e: clean_name(e["name"]) != "")))


def headings(text: Column) -> Column:
    """(level, name) of the Markdown headings that entities() takes, in order."""
    lines = F.regexp_extract_all(text, F.lit(r"(?Udm)^(#{1,6}\s+.+)"), F.lit(1))
    split = F.transform(lines, lambda h: F.struct(F.length(F.regexp_extract(h, r"^(#+)", 1)).alias("level"), F.regexp_replace(h, r"(?U)^#+\s+|\s+$", "").alias("name")))
    return F.filter(split, lambda h: (F.octet_length(h["name"]) > 2) & (clean_name(h["name"]) != ""))


#: A Markdown heading with its marks, as HEADING takes it.
HEADING_LINE = r"(?Udm)^#{1,6}\s+.+"


def heading_paths(text: Column) -> Column:
    """(at, path) of the Markdown headings that entities() takes, in order: at is where one begins, in code points, and
    path its name after those of the headings that it stands under, as "A > B > C"."""
    total = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda s, x: s + F.length(x))

    def placed(lines: Column) -> Column:
        def between(gaps: Column) -> Column:
            def head(line: Column, i: Column) -> Column:
                name = F.regexp_replace(line, r"(?U)^#+\s+|\s+$", "")
                return F.struct((total(gaps, i + 1) + total(lines, i)).alias("at"), F.length(F.regexp_extract(line, r"^(#+)", 1)).alias("level"), name.alias("name"))

            return F.filter(F.transform(lines, head), lambda h: (F.octet_length(h["name"]) > 2) & (clean_name(h["name"]) != ""))

        return once(F.split(text, HEADING_LINE), between)

    def add(state: Column, h: Column) -> Column:
        above = F.concat(F.filter(state["above"], lambda a: a["level"] < h["level"]), F.array(F.struct(h["level"].alias("level"), h["name"].alias("name"))))
        path = F.array_join(F.transform(above, lambda a: a["name"]), " > ")
        return F.struct(above.alias("above"), F.concat(state["found"], F.array(F.struct(h["at"].alias("at"), path.alias("path")))).alias("found"))

    start = F.struct(F.array().cast("array<struct<level:int,name:string>>").alias("above"), F.array().cast("array<struct<at:int,path:string>>").alias("found"))
    heads = once(F.regexp_extract_all(text, F.lit(f"({HEADING_LINE})"), F.lit(1)), placed)
    return with_mark(text, MARKS[HEADING[0]], F.aggregate(heads, start, add, lambda state: state["found"]), "array<struct<at:int,path:string>>")


def heading_of(paths: Column, start: Column) -> Column:
    """The path of the last heading that begins at start or before; null before the first one."""
    before = F.filter(paths, lambda h: h["at"] <= start)
    return F.get(before, F.size(before) - 1)["path"]


def highlights(text: Column, terms: Column, most: int = 3, around: int = 40) -> Column:
    """Up to `most` stretches of text around occurrences of index terms (letters or digits alone), with `around` characters on either side."""
    edge = r"[\p{L}\p{N}]"
    any_term = F.concat(F.lit(rf"(?isU).{{0,{around}}}(?<!{edge})(?:"), F.array_join(terms, "|"), F.lit(rf")(?!{edge}).{{0,{around}}}"))
    found = F.regexp_extract_all(text, any_term, F.lit(0))
    return F.when(F.size(terms) > 0, F.slice(found, 1, most)).otherwise(F.array().cast("array<string>"))
