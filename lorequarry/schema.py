"""Schemas of the tables, and the checks that writes make."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .errors import KnowledgeError

SCHEMA_VERSION = "3"

TABLES = {
    "document": "document_id string, title string, source string, source_type string, mime string, sha256 string, content string, tags array<string>, metadata map<string,string>, created_at timestamp, updated_at timestamp",
    "chunk": "chunk_id string, document_id string, idx long, content string, token_count long, heading string, embedding array<float>, terms long, start long, made string",
    "entity": "entity_id string, name string, kind string, description string",
    "mentions": "chunk_id string, entity_id string",
    "related_to": "src string, dst string, relation string, weight double",
    "meta": "key string, meta_value string",
    "posting": "term string, n int, max_tf long, min_length long, postings array<struct<chunk_id:string,document_id:string,tf:bigint,length:bigint>>",
    "vector": "chunk_id string, document_id string, embedding array<float>, cell int",
    "center": "cell int, center array<double>",
    "reach": "cell int, rows long, radius double",
    "failure": "source string, error string, failed_at timestamp",
}
#: Tables whose rows go when their document goes, and how a row tells its document.
OWNED = {"document": "document_id", "chunk": "document_id", "mentions": "regexp_replace(chunk_id, '#[0-9]+$', '')", "posting": "document_id", "vector": "document_id"}
#: Columns that a table's rows are sorted by in ranges, so that a scan that names values skips what can't hold them; and
#: the column whose values are folders of a table, with the rule that gives it.
SORTED = {"document": "document_id", "chunk": "chunk_id"}
FOLDERS = {"vector": ("cell", "cell"), "document": ("prefix", "substring(sha256, 1, 2)"), "related_to": ("bucket", "pmod(xxhash64(src), 64)")}
#: Fixed values.
SOURCE_TYPES = ["file", "url", "text", "stdin"]
FILTER_FIELDS = ["title", "source", "source_type", "mime", "sha256"]


def require(df: DataFrame, condition, message: str, code: str = "E_VALIDATION") -> None:
    """Raises unless every row holds the condition."""
    if not df.where(~F.coalesce(condition, F.lit(False))).isEmpty():
        raise KnowledgeError(code, message)


def check_documents(documents: DataFrame) -> None:
    require(documents, F.col("source_type").isin(SOURCE_TYPES), f"source_type must be one of {', '.join(SOURCE_TYPES)}")


def check_chunks(chunks: DataFrame, dimension: int) -> None:
    require(chunks, F.size("embedding") == dimension, f"every embedding must have {dimension} components", "E_EMBEDDING")


def shaped(df: DataFrame, table: str) -> DataFrame:
    """df with the table's columns in their order and types; those it lacks are null."""
    fields = [f.split(" ", 1) for f in TABLES[table].split(", ")]
    return df.select(*[(F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t)).alias(n) for n, t in fields])


def all_of(conditions):
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
