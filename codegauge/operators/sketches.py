"""Execution telemetry from stored parts: one row per run and engine, merged at will.

A part holds counts, sums and a KLL sketch of the durations.  Parts are mergeable, so the
telemetry of any set of runs comes from their parts alone; executions are read once, when
their run is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.operators.metrics import checked_engine

#: Accuracy of a sketch: its size grows with k, its error falls with it.
K = 2048


def rank_error(k: int = K) -> float:
    """Bound of a quantile's rank error as a share of all values, with a confidence of 99 %;
    merging does not widen it."""
    return 2.296 / k**0.9723


def telemetry_parts(executions: DataFrame, run_columns: list[str], k: int = K) -> DataFrame:
    """(run columns, sandbox_type, counts, sums, sketch) of executions."""
    rows = executions.withColumn("sandbox_type", checked_engine(F.col("sandbox_type")))
    return rows.groupBy(*run_columns, "sandbox_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("duration_sec").alias("n_timed"),
        F.sum(F.col("duration_sec").cast("decimal(38,12)")).alias("total_sec"),
        F.count_if(F.col("success")).alias("n_success"),
        F.kll_sketch_agg_double("duration_sec", k).alias("sketch"),
    )


def merged_telemetry(parts: DataFrame, k: int = K) -> DataFrame:
    """Count, share, mean, median within ``rank_error(k)``, success rate and throughput per engine."""
    whole = parts.groupBy("sandbox_type").agg(
        *[F.sum(c).alias(c) for c in ("n", "n_timed", "total_sec", "n_success")],
        F.kll_merge_agg_double(F.when(F.col("n_timed") > 0, F.col("sketch")), k).alias("sketch"),
    )
    total = whole.agg(F.sum("n")).scalar()
    seconds = F.col("total_sec").cast("double")
    return whole.select(
        "sandbox_type", "n", (F.col("n") / total).alias("share"),
        F.try_divide(seconds, F.col("n_timed")).alias("mean_sec"),
        F.when(F.col("n_timed") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).alias("median_sec"),
        (F.col("n_success") / F.col("n")).alias("success_rate"),
        F.try_divide(F.col("n_timed"), seconds).alias("runs_per_sec"),
    )
