"""Prepared task tables: prompts, test scripts, repairs, exclusions, samples."""

from __future__ import annotations

import logging
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.functions import scripts as S

log = logging.getLogger(__name__)

Repairs = list[tuple[str, str, str]] | DataFrame
Exclusions = list[str] | DataFrame


def repair_tests(df: DataFrame, repairs: Repairs) -> DataFrame:
    """Replace known-bad text in the tests of single tasks.

    ``repairs`` is a short list of ``(task_id, find, replace)``, or a table with
    those columns and at most one row per task.
    """
    if isinstance(repairs, DataFrame):
        fixed = F.when(
            F.col("__find").isNotNull(), F.replace("test", F.col("__find"), F.col("__replace"))
        ).otherwise(F.col("test"))
        table = repairs.select(
            "task_id", F.col("find").alias("__find"), F.col("replace").alias("__replace")
        )
        return (
            df.join(table, "task_id", "left")
            .withColumn("test", fixed)
            .drop("__find", "__replace")
        )
    test = F.col("test")
    for task_id, find, replacement in repairs:
        test = F.when(
            F.col("task_id") == task_id, S.literal_replace(test, find, replacement)
        ).otherwise(test)
    return df.withColumn("test", test)


def exclude_tasks(df: DataFrame, exclusions: Exclusions) -> DataFrame:
    """Leave out known-bad tasks, given as a short list or a ``task_id`` table."""
    if isinstance(exclusions, DataFrame):
        return df.join(exclusions.select("task_id").distinct(), "task_id", "left_anti")
    return df.where(~F.col("task_id").isin(list(exclusions))) if exclusions else df


def _with_text_ids(df: DataFrame) -> DataFrame:
    return df.withColumn("task_id", F.col("task_id").cast("string"))


def prepare_benchmark_a(
    df: DataFrame,
    repairs: Repairs = V.BENCHMARK_A_REPAIRS,
    exclusions: Exclusions = V.BENCHMARK_A_EXCLUDED,
) -> DataFrame:
    """``task_id, prompt, canonical_solution, entry_point, test`` → prepared table."""
    df = repair_tests(exclude_tasks(_with_text_ids(df), exclusions), repairs)
    script = S.pass_fail_script(F.col("task_id"), F.col("test"), F.col("entry_point"))
    solution = F.concat("prompt", "canonical_solution")
    return df.select(
        "task_id",
        S.completion_prompt(F.col("prompt")).alias("prompt"),
        "entry_point",
        script.alias("test"),
        S.fill_solution(script, solution).alias("test_solution"),
        "canonical_solution",
    )


def prepare_benchmark_b(
    df: DataFrame,
    exclusions: Exclusions = V.BENCHMARK_B_EXCLUDED,
    entry_point_mode: str = "name",
) -> DataFrame:
    """``task_id, prompt, code, test, test_list, test_imports`` → prepared table."""
    df = exclude_tasks(_with_text_ids(df), exclusions)
    name = S.entry_point(F.col("test"), entry_point_mode)
    script = S.result_list_script(F.col("task_id"), S.collect_results(F.col("test")))
    short_list = S.list_literal(S.boolean_tests(F.col("test_list")))
    short = S.short_test_script(F.col("task_id"), F.col("test_imports"), F.col("short_test_list"))
    return (
        df.select(
            "task_id",
            "prompt",
            "code",
            name.alias("entry_point"),
            script.alias("test"),
            short_list.alias("short_test_list"),
            "test_imports",
        )
        .withColumn("short_tests", short)
        .select(
            "task_id",
            S.instruction_prompt(F.col("prompt"), F.col("entry_point")).alias("prompt"),
            "entry_point",
            "test",
            S.fill_solution(F.col("test"), F.col("code")).alias("test_solution"),
            "short_test_list",
            "short_tests",
            S.fill_solution(F.col("short_tests"), F.col("code")).alias("short_test_solution"),
            F.col("code").alias("canonical_solution"),
        )
    )


def prepare_training(
    df: DataFrame, seed: int | None = None, num_samples: int = -1, key: str = "seq_id"
) -> DataFrame:
    """Sample, then prompt, tests and self-check script; used columns are dropped."""
    return (
        sample_rows(df, key, num_samples, seed)
        .withColumn("prompt", S.instruction_prompt(F.col("instruction"), F.col("entry_point")))
        .withColumn("tests", S.training_test_script(F.col("testcase")))
        .withColumn("test_solution", S.append_tests(F.col("code"), F.col("tests")))
        .drop("instruction", "output", "code", "entry_point", "testcase")
    )


def sample_rank(key: Column, seed: int, spread: Column | None = None) -> Column:
    """Place of a row in the seeded shuffle; rows without a key by ``spread``."""
    other = F.lit("") if spread is None else F.concat(F.lit("null:"), spread)
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), other)))


def sample_rows(
    df: DataFrame, key: str, num_samples: int, seed: int | None = None, digits: int = 5,
    spread_by: list[str] | None = None,
) -> DataFrame:
    """Exactly ``num_samples`` rows, uniform and the same for any partitioning.

    Rows are taken in the order of a seeded hash of ``key``; rows with a null key
    in that of a hash of ``spread_by`` (default: all columns but maps), which also
    orders rows with equal keys.  -1 takes all rows.  The hash space is cut into ``16**digits``
    buckets and counted; only the buckets up to the one that holds the last
    wanted row are kept, and rows are ranked within their bucket.  Only the bucket counts (at most
    ``16**digits``) are summed in one task, rows are not: only about ``num_samples`` rows are shuffled, and a
    ranked group has about ``rows / 16**digits`` rows.
    """
    if num_samples < 0:
        return df
    if num_samples == 0:
        return df.limit(0)
    if seed is None:
        seed = random.SystemRandom().randrange(2**31)
        log.info("sampling with seed %d", seed)
    names = spread_by or [f.name for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    spread = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in names])
    place = sample_rank(F.col(key), seed, spread)
    buckets = df.groupBy(F.substring(place, 1, digits).alias("bucket")).agg(
        F.count(F.lit(1)).alias("n")
    )
    # at most 16**digits rows, whatever the data
    running = buckets.withColumn(
        "upto", F.sum("n").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    )
    edge = running.where(F.col("upto") >= num_samples).agg(
        F.min_by(
            F.struct("bucket", (F.lit(num_samples) - F.col("upto") + F.col("n")).alias("wanted")),
            "bucket",
        ).alias("edge")
    )
    marked = df.withColumns({
        "__place": place,
        "__bucket": F.substring(place, 1, digits),
        "__edge": edge.scalar(),
    })
    # no edge: fewer rows than asked for, all are taken
    all_rows = F.col("__edge").isNull()
    inside = F.col("__bucket") < F.col("__edge.bucket")
    order = Window.partitionBy("__bucket").orderBy("__place", key, spread)
    return (
        marked.where(all_rows | (F.col("__bucket") <= F.col("__edge.bucket")))
        .withColumn("__rank", F.row_number().over(order))
        .where(all_rows | inside | (F.col("__rank") <= F.col("__edge.wanted")))
        .drop("__place", "__bucket", "__edge", "__rank")
    )
