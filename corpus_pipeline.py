"""From raw documents to token ids: the stages of the corpus pipeline, each written and read again."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from annalist.llm import bpe, decontaminate, lines, simhash, toxicity
from annalist.llm.tables import discard, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a toxicity under 0.5, learned from the labels that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, toxicity.learnable(labels))
    return toxicity.score(docs, model, keep=docs.columns).filter("score < 0.5").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 25 and more words stay in the earliest document alone; a document that has nothing else goes.

    ``n_chars`` follows the text.
    """
    cut = lines.line_dedup(docs)
    changed = (F.col("n_removed") > 0) | (F.col("n_cut") > 0)
    return cut.filter(~changed | F.col("text").rlike(r"\S")).withColumn("n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The earliest document of each class of near duplicates; documents without an id stay."""
    others = simhash.near_duplicates(docs).filter("class <> doc_id").select(F.col("doc_id").alias("other")).distinct()
    return docs.join(others, F.col("doc_id") == F.col("other"), "left_anti")


def without_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of the benchmark."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, packed, with digests of the ids and of the text they decode to."""
    vocabulary = public_tokenizers.path("word_bpe_49k.json")
    return bpe.encode(docs, vocabulary, decoded=True).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic),
    ("line_dedup", without_repeats),
    ("simhash_near_dedup", one_of_each),
    ("decontamination", without_tests),
    ("bpe", encoded),
]

#: No SQL: fingerprints, alignment and tokenizing are beyond it; tests compare with a sequential version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet to the shared folder and read again.

    A stage's files are removed once the next one is written. An empty table gives no rows.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
        if before is not None:
            discard(before)
        before = docs
    return docs
