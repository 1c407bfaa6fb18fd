"""Task tables and generations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codegauge import storage
from codegauge.operators import prepare
from codegauge.schemas import GENERATION


def read_table(spark: SparkSession, path: str, fmt: str = "parquet", schema=None) -> DataFrame:
    """A raw task table in Parquet, JSON lines, ORC or CSV."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_benchmark_a(spark: SparkSession, raw: str, prepared: str, fmt: str = "parquet") -> DataFrame:
    """Prepared benchmark A table, reused if it was written before."""
    return storage.materialise(prepare.prepare_benchmark_a(read_table(spark, raw, fmt)), prepared)


def load_benchmark_b(spark: SparkSession, raw: str, prepared: str, fmt: str = "parquet") -> DataFrame:
    return storage.materialise(prepare.prepare_benchmark_b(read_table(spark, raw, fmt)), prepared)


def load_training(
    spark: SparkSession,
    raw: str,
    prepared_root: str,
    seed: int,
    num_samples: int = -1,
    fmt: str = "parquet",
) -> DataFrame:
    """Sampled and prepared training table; its path names seed and size."""
    path = storage.sample_table_path(prepared_root, seed, num_samples)
    return storage.materialise(
        prepare.prepare_training(read_table(spark, raw, fmt), seed, num_samples), path
    )


def export_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def with_failed_calls(generations: DataFrame) -> DataFrame:
    """A failed generation call is an empty completion with zero tokens and time."""
    return generations.na.fill({"completion": ""}).na.fill(
        0, ["token_count", "generation_time", "throughput"]
    )


def read_generations(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Completions with tokens and seconds, ``GENERATION`` columns."""
    return with_failed_calls(spark.read.format(fmt).schema(GENERATION).load(path))

