"""From raw documents to token files: five stages, each written as Parquet and read again for the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import mixing, rule_ensemble, simhash, token_files, winnowing
from tidelake.llm.common import scratch
from tidelake.llm.queries import table, vocabulary
from tidelake.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble scores 0.5 or more; it learns from labels that aren't held out."""
    ship(spark)
    labels = table(spark, sf_dir, "labels").filter(~rule_ensemble.held_out("doc_id"))
    model = rule_ensemble.train(table(spark, sf_dir, "documents"), labels)
    return rule_ensemble.scored(docs, model, out="__score").filter(F.col("__score") >= 0.5).drop("__score")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    ship(spark)
    return winnowing.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: repeated rows, or none."""
    ship(spark)
    mixed = mixing.mix(docs).filter(F.col("mix_copies") > 0)
    return mixed.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select(*docs.columns)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: (doc_id, start, n_tokens, ids_crc32), a row for each copy."""
    ship(spark)
    return token_files.encoded(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mix", mix),
    ("token_output", token_output),
]

#: The classifier's weights and the hashes of the words aren't expressible in SQL; tests compare with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what each keeps is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
