"""The corpus pipeline: quality rules, toxicity, near-duplicates, packing; each stage works on what the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import jaccard, packing, quality, toxicity
from panelspark.llm.common import stored
from panelspark.llm.queries import QUALITY_THRESHOLD, TOXIC_THRESHOLD, table, tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the classifier rejects, with their own columns.

    Null and empty texts are rejected (no words); a probability of exactly the threshold is kept; rows that repeat are judged alike. The
    classifier learns from the labelled rows of the whole table `documents`. Without labels the base rules decide alone.
    """
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality.keep(docs, model, QUALITY_THRESHOLD)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't count as toxic, with their own columns.

    Null and empty texts stay; a score of exactly the threshold is toxic; rows that repeat are judged alike. Without labels all stay.
    """
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, TOXIC_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id, and of its texts, if there are several, one.

    Rows that repeat both doc_id and text (or have no doc_id and the same text) count as one document: the one whose other columns come first
    as JSON stays. Null and empty texts are linked with nothing. Columns keep their names and values.
    """
    found = jaccard.near_duplicates(docs, k=5, percent=75, by_text=True)
    dropped = found.filter((F.col("component_id") != F.col("doc_id")) | (F.col("component_hash") != F.col("text_hash"))).select("doc_id", "text_hash").distinct()
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", jaccard.text_hash().alias("text_hash"), F.struct("*").alias("row"), F.to_json(F.struct(F.lit(0).alias("_"), *others)).alias("order"))
    kept = rows.join(dropped.hint("merge"), ["doc_id", "text_hash"], "left_anti")
    return kept.groupBy("doc_id", "text_hash").agg(F.min_by("row", "order").alias("row")).select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 2048 tokens. Null and empty texts are their end id alone; rows that repeat are packed each."""
    pieces, _ = packing.pack(docs, tokenizer_file("word_bpe_49k.json"), end=1, window=2048)
    return pieces.drop("part", "row")


STAGES = [("quality rules", quality_rules), ("toxicity", toxicity_filter), ("n-gram Jaccard join", near_duplicates), ("packing", packed)]

#: Not expressible in SQL (trained classifiers, tokenizer); tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
