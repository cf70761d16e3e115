"""Ingest: deduplication, chunks, embeddings, entities; whole batches at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.embedders import Embedder, Tokenizer
from . import graph, index


def first_of_each(documents: DataFrame, *order: str | Column) -> DataFrame:
    """Of rows with one sha256 the first by order; the others are dropped."""
    w = Window.partitionBy("sha256").orderBy(*order)
    return documents.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def new_only(documents: DataFrame, existing: DataFrame) -> DataFrame:
    return documents.join(existing.select("sha256"), "sha256", "left_anti")


def replace(existing: DataFrame, new: DataFrame, key: str = "sha256") -> DataFrame:
    """existing without the rows that new has too, and new."""
    return existing.join(new.select(key).distinct(), key, "left_anti").select(*existing.columns).unionByName(new)


def chunk_rows(documents: DataFrame, tokenizer: Tokenizer, max_tokens: int, overlap_tokens: int) -> DataFrame:
    """(chunk_id, document_id, idx, content, token_count, heading, start), and made if documents have it: nothing is shuffled.

    heading is the path of the last Markdown heading at or before the chunk's start, looked up within the row.
    """
    more = [c for c in documents.columns if c == "made"]
    headed = documents.select("document_id", "content", *more, text.heading_paths(F.col("content")).alias("_heads"))
    made = headed.select("document_id", *more, "_heads", F.inline(tokenizer.chunks(F.col("content"), max_tokens, overlap_tokens)))
    chunk_id = F.concat("document_id", F.lit("#"), F.col("idx").cast("string"))
    return made.select(chunk_id.alias("chunk_id"), "document_id", "idx", "content", "token_count", text.heading_of(F.col("_heads"), F.col("start")).alias("heading"), "start", *more)


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    return chunks.withColumn("embedding", embedder.embed(F.col("content"), F.col("idx")))


def indexed(chunks: DataFrame) -> DataFrame:
    """chunks with their number of index terms."""
    return chunks.withColumn("terms", F.size(text.analyzed(F.col("content"))).cast("long"))


def posted(chunks: DataFrame) -> DataFrame:
    """Rows of the table posting: blocks."""
    return index.text_blocks(chunks)


def plain_postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, document_id, tf, length)."""
    made = index.postings(chunks, "chunk_id", "content")
    return made.select("term", F.col("id").alias("chunk_id"), F.regexp_replace("id", "#[0-9]+$", "").alias("document_id"), "tf", "length")


def entities_of(chunks: DataFrame, extended: bool = False) -> tuple[DataFrame, DataFrame]:
    """The rows of entity and of mentions that the chunks make."""
    found = graph.extract(chunks, "chunk_id", extended=extended)
    return graph.entity_rows(found), graph.mention_edges(found)


def upload_summary(documents: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """document_id, title, sha256, chunks, tokens, entities (different names, sorted) for each document."""
    counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens"))
    names = chunks.select("chunk_id", "document_id").join(mentions, "chunk_id").groupBy("document_id").agg(F.array_sort(F.collect_set("entity_id")).alias("entities"))
    joined = documents.select("document_id", "title", "sha256").join(counts, "document_id", "left").join(names, "document_id", "left")
    return joined.select("document_id", "title", "sha256", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"))
