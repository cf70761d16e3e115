"""Sources: files, folders, URLs, inline and base64 text as rows (title, source, source_type, raw, file_title, error).

A source that can't be taken has no raw text, but an error: its code and message. raised() makes that an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from pathlib import Path
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..errors import KnowledgeError
from ..functions import text

SCHEMA = "title string, source string, source_type string, raw string, file_title string, error string"
#: Readers of formats that aren't text, by the ending of the name: functions from bytes to text, run on the executors.
READERS: dict[str, Callable[[bytes], str]] = {}


#: How files that are no text begin, whatever they are called.
BINARY = {"pdf": "25504446", "zip": "504B0304", "png": "89504E47", "jpeg": "FFD8FF", "gif": "47494638", "gzip": "1F8B", "elf": "7F454C46"}


def docx_text(data: bytes) -> str:
    """The paragraphs of a Word document, one on a line; tabs and breaks within them are kept."""
    import io
    import zipfile
    from xml.etree import ElementTree

    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as parts:
        info = parts.getinfo("word/document.xml")
        if info.file_size > MAX_XML:
            raise ValueError("the document's text is too large")
        body = parts.read(info)
    if b"<!DOCTYPE" in body or b"<!ENTITY" in body:  # which such documents don't have; entities may grow without bound
        raise ValueError("a document type isn't allowed")
    shown = {f"{space}tab": "\t", f"{space}br": "\n", f"{space}cr": "\n"}
    lines = []
    for paragraph in ElementTree.fromstring(body).iter(f"{space}p"):
        lines.append("".join(x.text or "" if x.tag == f"{space}t" else shown.get(x.tag, "") for x in paragraph.iter()))
    return "\n".join(lines)


#: Bytes of XML that a Word document may unpack to.
MAX_XML = 1 << 28
READERS["docx"] = docx_text


def binary(content: Column) -> Column:
    """Whether bytes are those of a known format that isn't text, or hold a zero byte in their beginning."""
    begin = F.hex(F.substring(content, 1, 1024))
    marks = [begin.startswith(mark) for mark in BINARY.values()]
    zero = F.regexp_like(begin, F.lit("^(?:..)*?00"))
    return reduce(lambda a, b: a | b, marks, zero)


def check_allowed(path: str, config: Config) -> None:
    """A local path must be in one of upload.allowed_dirs, if there are any, once links are resolved."""
    if not config.upload.allowed_dirs:
        return
    try:
        real = Path(path).resolve(strict=not any(c in path for c in "*?[{"))
        allowed = [Path(d).resolve(strict=True) for d in config.upload.allowed_dirs]
    except OSError as e:
        raise KnowledgeError("E_IO", f"resolve path: {e}") from e
    if not any(real.is_relative_to(d) for d in allowed):
        raise KnowledgeError("E_VALIDATION", f"path not in allowed directories: {real}")


def taken(files: DataFrame, config: Config, title: str | None = None) -> DataFrame:
    """Rows of SCHEMA of files (path, length, content). Larger ones than upload.max_file_mb, PDFs and other binaries without
    a reader in READERS, and invalid UTF-8 have errors."""
    limit = config.upload.max_file_mb << 20
    path = F.regexp_replace("path", r"^file:(//)?(?=/)", "")
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    read = files.withColumn("_text", F.col("content").cast("string")).withColumn("_failed", F.lit(None).cast("string"))
    for ending, reader in READERS.items():
        read = _read_by(read, ending, reader)
    known = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1)).isin(*READERS) if READERS else F.lit(False)
    error = (
        F.when(F.col("length") > limit, F.concat(F.lit("E_VALIDATION: file exceeds max file size: "), path))
        .when(F.lower("path").endswith(".pdf") & ~known, F.concat(F.lit("E_UNSUPPORTED_FORMAT: "), path))
        .when(F.col("_failed").isNotNull(), F.concat(F.lit("E_UNSUPPORTED_FORMAT: "), path, F.lit(": "), F.col("_failed")))
        .when(~known & binary(F.col("content")), F.concat(F.lit("E_UNSUPPORTED_FORMAT: "), path))
        .when(~F.is_valid_utf8(F.col("_text")), F.concat(F.lit("E_IO: not UTF-8: "), path))
    )
    rows = read.select(F.coalesce(F.lit(title), name).alias("title"), path.alias("source"), F.lit("file").alias("source_type"), F.col("_text").alias("raw"), name.alias("file_title"), error.alias("error"))
    return rows.withColumn("raw", F.when(F.col("error").isNull(), F.col("raw")))


def _read_by(files: DataFrame, ending: str, reader: Callable[[bytes], str]) -> DataFrame:
    @F.pandas_udf("text string, failed string")
    def run(contents):
        import pandas as pd

        out = []
        for data in contents:
            try:
                out.append((None if data is None else reader(bytes(data)), None))
            except Exception as e:
                out.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "failed"])

    mine = F.lower("path").endswith(f".{ending}")
    made = files.withColumn("_made", run(F.when(mine, F.col("content"))))
    return made.withColumn("_text", F.when(mine, F.col("_made.text")).otherwise(F.col("_text"))).withColumn("_failed", F.when(mine, F.col("_made.failed")).otherwise(F.col("_failed"))).drop("_made")


def raised(rows: DataFrame) -> DataFrame:
    """rows, such that reading one with an error raises it."""
    return rows.withColumn("raw", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("raw"))).drop("error")


def from_files(spark: SparkSession, paths: str | Sequence[str], config: Config, recursive: bool = False, title: str | None = None) -> DataFrame:
    """Whole text files: paths, globs, or folders. A path that isn't there, or isn't allowed, is an exception."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        check_allowed(p.removeprefix("file://"), config)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return taken(reader.load(paths), config, title)


def from_text(spark: SparkSession, contents: Sequence[str], title: str | None = None) -> DataFrame:
    return spark.createDataFrame([(title or "inline", "inline", "text", c, "inline", None) for c in contents], SCHEMA)


def from_base64(spark: SparkSession, encoded: Sequence[str], title: str | None = None) -> DataFrame:
    rows = spark.createDataFrame([(title or "base64", "base64", "text", c, "base64", None) for c in encoded], SCHEMA)
    rows = rows.withColumn("raw", text.decode_base64(F.col("raw")))
    return rows.withColumn("error", F.when(F.col("raw").isNull(), F.lit("E_VALIDATION: base64 of UTF-8 text expected")))


def from_urls(spark: SparkSession, urls: Sequence[str], config: Config, timeout: float = 30.0) -> DataFrame:
    """Pages by HTTP or HTTPS, fetched on the executors; at most upload.max_file_mb each."""
    for u in urls:
        if urlsplit(u).scheme not in ("http", "https"):
            raise KnowledgeError("E_VALIDATION", f"not an http(s) URL: {u}")
    limit, readers, marks = config.upload.max_file_mb << 20, dict(READERS), [bytes.fromhex(m) for m in BINARY.values()]

    def one(url: str) -> tuple[str | None, str | None]:
        import urllib.request

        try:
            with urllib.request.urlopen(url, timeout=timeout) as answer:
                data = answer.read(limit + 1)
                if len(data) > limit:
                    return None, f"E_VALIDATION: response exceeds max file size: {url}"
                pdf = "application/pdf" in answer.headers.get("content-type", "")
                ending = "pdf" if pdf else urlsplit(url).path.rpartition(".")[2].lower()
                if ending in readers:
                    try:
                        return readers[ending](data), None
                    except Exception as e:
                        return None, f"E_UNSUPPORTED_FORMAT: {url}: {type(e).__name__}: {e}"
                if ending == "pdf" or any(data.startswith(m) for m in marks) or b"\0" in data[:1024]:
                    return None, f"E_UNSUPPORTED_FORMAT: {url}"
                return data.decode("utf-8"), None
        except (OSError, ValueError) as e:
            return None, f"E_IO: {url}: {e}"

    def fetch(batches):
        for batch in batches:
            got = [one(u) for u in batch["source"]]
            yield batch.assign(raw=[x for x, _ in got], error=[x for _, x in got])

    rows = spark.createDataFrame([(u, u, "url", "", u, None) for u in urls], SCHEMA)
    return rows.repartition(max(1, len(urls))).mapInPandas(fetch, SCHEMA)


def from_request(spark: SparkSession, config: Config, path=None, url=None, content=None, content_base64=None, title=None) -> DataFrame:
    """The first of path, url, content and content_base64 that is given; each one value or a list."""
    many = lambda x: [x] if isinstance(x, str) else list(x)
    if path is not None:
        return from_files(spark, many(path), config, title=title)
    if url is not None:
        rows = from_urls(spark, many(url), config)
        return rows if title is None else rows.withColumn("title", F.lit(title))
    if content is not None:
        return from_text(spark, many(content), title)
    if content_base64 is not None:
        return from_base64(spark, many(content_base64), title)
    raise KnowledgeError("E_VALIDATION", "one of path, url, content and content_base64 is needed")


def extracted(rows: DataFrame, tags: Sequence[str] = (), metadata: dict[str, str] | None = None) -> DataFrame:
    """Rows of the table document, without an order: text extracted, hashed and typed; and error, where rows have one."""
    content = text.extract_text(F.col("raw"), F.col("source"))
    meta = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>")
    typed = rows.withColumn("content", content).withColumn("sha256", text.content_hash(F.col("content")))
    return typed.select(
        F.col("sha256").alias("document_id"), "title", "source", "source_type",
        text.mime_type(F.col("source"), F.col("title"), F.col("file_title")).alias("mime"),
        "sha256", "content", F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags"), meta.alias("metadata"),
        F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"), *(["error"] if "error" in rows.columns else []),
    )
