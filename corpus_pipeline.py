"""Corpus preparation in stages; each stage's result is a Parquet table the next one reads.

Quality rules and language identification remove the documents they reject, SimHash
near-duplicates keep one document of each group, secrets are replaced by a placeholder
(and ``n_chars`` follows the text), and what is left is packed into sequences: the last
stage's rows are pieces with their places.  Null and empty texts, repeated rows and
empty tables are defined by the operators; every stage but the last returns the columns
of its input.

A stage begins when the result of the one before it is written, so it first deletes the
intermediate tables that one staged.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.llm import langid, packing, quality, secrets, simhash
from codegauge.storage import clear_staged, new_path, staged_paths


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact(docs, secrets.fit(secrets.labelled_samples(docs)))
    return clean.withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Tables staged by the last stage that ran.
_LEFT: list[str] = []


def _clearing(stage: Stage) -> Stage:
    """The stage, after the tables of the one before it are deleted."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        clear_staged(spark, _LEFT)
        before = set(staged_paths())
        found = stage(spark, docs, sf_dir)
        _LEFT[:] = [path for path in staged_paths() if path not in before]
        return found

    return run_stage


STAGES = [
    ("quality rules", _clearing(quality_stage)),
    ("language id", _clearing(language_stage)),
    ("simhash near-dedup", _clearing(near_duplicate_stage)),
    ("secret scans", _clearing(secret_stage)),
    ("best-fit packing", _clearing(packing_stage)),
]

#: Near-duplicate search, models and packing have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; only the last one's table is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written: list[str] = []
    for name, stage in STAGES:
        path = new_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        clear_staged(spark, written)
        written = [path]
    clear_staged(spark, _LEFT)
    return docs
