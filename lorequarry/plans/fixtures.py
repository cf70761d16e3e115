"""The driver's tables in the shape of the engine's."""

from __future__ import annotations

import uuid
from string import ascii_lowercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Chunking, Config, Embedding, Storage
from ..engine import KnowledgeBase
from ..functions import text
from ..functions.embedders import Embedder, WhitespaceTokenizer
from ..operators import ingest
from ..store import shared_folder

MAX_TOKENS, OVERLAP = 128, 16


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("document_id"), F.concat(F.lit("Doc "), F.col("doc_id").cast("string")).alias("title"), "source", F.lit("file").alias("source_type"),
        F.col("lang").alias("mime"), text.content_hash(F.col("text")).alias("sha256"), F.col("text").alias("content"), F.timestamp_seconds("doc_id").alias("created_at"), F.timestamp_seconds("doc_id").alias("updated_at"), "doc_id",
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return ingest.chunk_rows(documents(spark, d), WhitespaceTokenizer(), MAX_TOKENS, OVERLAP)


def markdown(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, md): documents with a heading, a subheading, a link and two tags each."""
    doc, c = F.col("doc_id").cast("string"), F.col
    md = F.concat(F.lit("# Doc "), doc, F.lit("\n\n## Lang "), c("lang"), F.lit("\n\nSee ["), c("source"), F.lit("](#"), c("source"), F.lit("). #"), c("lang"), F.lit(" #"), c("source"), F.lit("\n"), c("text"))
    return table(spark, d, "documents").select("doc_id", "lang", "source", md.alias("md"))


def with_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, content, embedding, source, lang) of documents that have a vector."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = table(spark, d, "documents").select("doc_id", F.col("text").alias("content"), "source", "lang")
    return docs.join(v, "doc_id").withColumnRenamed("doc_id", "id")


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


class LetterEmbedder:
    """How often a text has each letter from a to z: an embedder that SQL can follow."""

    name, dimension = "letters", 26

    def embed(self, content: Column, position: Column) -> Column:
        first, n = ord(ascii_lowercase[0]), self.dimension

        @F.pandas_udf("array<float>")
        def counted(texts):
            import numpy as np
            import pandas as pd

            # a byte below 128 is a character of its own in UTF-8
            counts = lambda t: np.bincount(np.frombuffer(t.encode(), np.uint8), minlength=first + n)[first : first + n].astype(np.float32)
            return pd.Series([None if t is None else counts(t) for t in texts])

        return counted(F.lower(content))


def knowledge_base(spark: SparkSession, d: str, embedder: Embedder | None = None) -> KnowledgeBase:
    """A new knowledge base of all documents, in one upload; of equal texts that of the least doc_id is taken."""
    config = Config(storage=Storage(path=scratch(spark)), embedding=Embedding(onnx_path="mock", dimension=8), chunking=Chunking(MAX_TOKENS, OVERLAP))
    base = KnowledgeBase(spark, config, embedder)
    docs = documents(spark, d)
    base.upload_rows(docs.select(F.col("sha256").alias("document_id"), "title", "source", "source_type", "mime", "sha256", "content", F.array().cast("array<string>").alias("tags"), F.create_map().cast("map<string,string>").alias("metadata"), "created_at", "updated_at", F.col("doc_id").alias("order")))
    return base


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, relation): languages to sources, sources to their first document, and each document to the next."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    name = lambda c: F.concat(F.lit("Doc "), c.cast("string"))
    has = docs.select(F.col("lang").alias("src"), F.col("source").alias("dst"), F.lit("has").alias("relation")).distinct()
    first = docs.groupBy("source").agg(F.min("doc_id").alias("m")).select(F.col("source").alias("src"), name(F.col("m")).alias("dst"), F.lit("first").alias("relation"))
    then = docs.select(name(F.col("doc_id")).alias("src"), name(F.col("doc_id") + 1).alias("dst"), F.lit("next").alias("relation"))
    of = docs.select(name(F.col("doc_id")).alias("src"), F.col("lang").alias("dst"), F.lit("in").alias("relation"))
    return has.unionByName(first).unionByName(then).unionByName(of)


def weighted_edges(spark: SparkSession, d: str) -> DataFrame:
    """edges() with a weight by relation."""
    weight = F.when(F.col("relation") == "has", 1.0).when(F.col("relation") == "next", 0.9).when(F.col("relation") == "first", 0.8).otherwise(0.5)
    return edges(spark, d).withColumn("weight", weight)


def sections(spark: SparkSession, d: str) -> DataFrame:
    """(document_id, content): texts under headings of three levels, each text twice."""
    c = F.col
    doc, lang = c("doc_id").cast("string"), F.concat(F.lit("\n\n## Lang "), "lang", F.lit("\n\n"))
    md = F.concat(F.lit("Before all.\n\n# Doc "), doc, lang, c("text"), F.lit("\n\n### Part "), c("source"), F.lit("\n"), c("text"), F.lit("\n\n# The end\n"), c("text"))
    return table(spark, d, "documents").select(doc.alias("document_id"), md.alias("content"))
