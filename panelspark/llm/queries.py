"""The registered queries: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, extract, hard_negatives, jaccard, language_model, licenses, mixing, packing, quality, token_store, toxicity, vectors
from .common import shared_path
from .sql import ORACLE_SQL  # noqa: F401  (of those queries that SQL can express)


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; `PANELSPARK_TOKENIZERS` names another folder than the installed package's."""
    import os

    folder = os.environ.get("PANELSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file("byte_bpe_50k.json"), end=2)
    return token_store.checksums(spark, path)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("detections")


#: The least calibrated probability of good quality at which a document is kept.
QUALITY_THRESHOLD = 0.2


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, QUALITY_THRESHOLD)


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), k=5, percent=75)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), end=1, window=2048)
    return pieces.drop("part", "row")


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9, blocks=4)


#: The least score that counts as toxic.
TOXIC_THRESHOLD = 0.7


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= TOXIC_THRESHOLD).cast("int").alias("predicted"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract.extract(pages, extract.train(pages))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(table(spark, sf_dir, "documents"), folds=5)


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.copies(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    head = F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4)).cast("int")
    return conversations.trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20, head=head, longest=3)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.select("vec_id", label.alias("label"), "embedding"), every=50, positives=5, negatives=3, low=50, high=95)


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op3 returns but for the method's own labels and score."""
    return op3_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 returns but for the classifier's verdict."""
    return quality.score(table(spark, sf_dir, "documents"), None, QUALITY_THRESHOLD).drop("probability", "kept")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op10 returns but for the model's score."""
    return op10_lm_scoring(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 5).alias("base_score"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_license_scan": op3_license_scan,
    "op4_quality_rules": op4_quality_rules,
    "op5_ngram_jaccard": op5_ngram_jaccard,
    "op6_packing": op6_packing,
    "op7_vector_dedup": op7_vector_dedup,
    "op8_html_extraction": op8_html_extraction,
    "op9_toxicity": op9_toxicity,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_mixing": op11_mixing,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_hard_negatives": op13_hard_negatives,
    "license_base": license_base,
    "quality_base": quality_base,
    "lm_base": lm_base,
}