"""From raw documents to packed training sequences: a pipeline of five of the operators in lorequarry.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorequarry.llm import line_dedup, mixing, ngram_join, packing, quality
from lorequarry.llm._shared import materialize, private


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the co-trained classifier keeps, with all their columns.

    Null, empty and very long texts, null metadata and null ids are scored as any others; rows that are equal stay or
    go together. With too few labels rows are kept unless most labels are of unwanted documents. An empty table gives
    an empty one.
    """
    return quality.keep_wanted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur before, n_chars to match. A row whose text is used up goes.

    Rows with null, empty or white-space texts stay as they are, as do those without a repeated passage. All columns
    come back, whatever their names. Ties go by doc_id, then by a hash of the text; of equal rows all are cut alike.
    """
    own = private(docs.columns)
    aside = {c: own(c) for c in docs.columns if c.lower() in ("n_removed", "removed")}
    cleaned = line_dedup.dedup_lines(docs.withColumnsRenamed(aside))
    left = cleaned.where((F.col("n_removed") == 0) | (F.length(F.btrim("text", F.lit(" \t\n\x0b\f\r"))) > 0))
    if "n_chars" in docs.columns:
        n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
        left = left.withColumn("n_chars", n_chars)
    return left.select(*[F.col(aside.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates; of rows that share a doc_id one, by a hash of their texts.

    Rows without doc_id stay, and so do rows without text or words, which are like nothing. All columns come back,
    whatever their names. An empty table gives an empty one.
    """
    row = private(docs.columns)("row")
    gone = ngram_join.near_groups(docs).where("component_id < doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(materialize(gone, "near-duplicates"), "doc_id", "left_anti")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"))
    named = named.withColumn(row, F.row_number().over(first)).where(F.col(row) == 1)
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows and columns, in the order in which sources meet their target weights.

    A null source is a source of its own. No row goes, and none is changed; rows equal in doc_id and text are
    interchangeable. An empty table gives an empty one.
    """
    return mixing.in_mixed_order(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens.

    A null text is an empty one, a null doc_id stays null, equal rows are packed each, and very long texts are cut.
    Other columns are ignored. An empty table gives no rows.
    """
    return packing.pack(docs, window=1024)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express the trained classifier, the schedule or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
