"""Managing documents: list, get, delete, statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import KnowledgeError

#: The orders of list.
ORDERS = {
    "created_desc": ("created_at", False),
    "created_asc": ("created_at", True),
    "title_asc": ("title", True),
    "title_desc": ("title", False),
    "updated_asc": ("updated_at", True),
    "updated_desc": ("updated_at", False),
}


def listed(documents: DataFrame, chunks: DataFrame, limit: int = 50, offset: int = 0, order: str = "created_desc") -> DataFrame:
    """document_id, title, source, sha256, chunk_count, created_at of one page; ties by id. Chunks are counted for the page only."""
    if order not in ORDERS:
        raise KnowledgeError("E_VALIDATION", f"unknown order: {order}")
    if limit < 0 or offset < 0:
        raise KnowledgeError("E_VALIDATION", "limit and offset must not be negative")
    column, ascending = ORDERS[order]
    keys = [F.col(column).asc() if ascending else F.col(column).desc(), F.col("document_id")]
    page = documents.select("document_id", "title", "source", "sha256", "created_at", "updated_at").orderBy(*keys).offset(offset).limit(limit)
    counts = chunks.join(F.broadcast(page.select("document_id")), "document_id", "left_semi").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    joined = page.join(counts, "document_id", "left").orderBy(*keys)
    return joined.select("document_id", "title", "source", "sha256", F.coalesce("chunk_count", F.lit(0)).cast("long").alias("chunk_count"), "created_at")


def got(documents: DataFrame, chunks: DataFrame, document_id: str, with_chunks: bool = False) -> DataFrame:
    """One row, and its chunks (idx, content, token_count) in order if asked for."""
    own = documents.where(F.col("document_id") == document_id)
    if own.isEmpty():
        raise KnowledgeError("E_DOCUMENT_NOT_FOUND", document_id)
    row = own.select("document_id", "title", "source", "source_type", "sha256", "content", "created_at")
    if not with_chunks:
        return row
    return row.join(collected_chunks(chunks.where(F.col("document_id") == document_id)), "document_id", "left")


def collected_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("idx", "content", "token_count"))).alias("chunks"))


def without(documents: DataFrame, chunks: DataFrame, mentions: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents of gone (document_id). Entities stay."""
    ids = gone.select("document_id").distinct()
    dead = chunks.join(ids, "document_id", "left_semi").select("chunk_id")
    return documents.join(ids, "document_id", "left_anti"), chunks.join(ids, "document_id", "left_anti"), mentions.join(dead, "chunk_id", "left_anti")


def stats(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: document_count, chunk_count, total_tokens."""
    d = documents.agg(F.count(F.lit(1)).alias("document_count"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunk_count"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("total_tokens"))
    return d.crossJoin(c)
