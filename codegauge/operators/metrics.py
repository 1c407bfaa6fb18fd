"""Aggregates over results and executions.

All of them aggregate on the map side first, so one model, data set or engine may
hold any share of the rows.  Windows run on aggregated rows only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.functions import execution as X
from codegauge.functions import outcome as O
from codegauge.operators.checkpoints import answered
from codegauge.operators.joins import skew_join

RESULT_KEY = ["model_id", "dataset_name", "task_id"]


def _share(flag: Column) -> Column:
    """Share of rows with a true flag; null counts as false."""
    return F.count_if(flag) / F.count(F.lit(1))


def latest_per_task(results: DataFrame, order_by: str, tie_breaker: str) -> DataFrame:
    """The newest row of each task (partial ``max_by``, no sort of a group)."""
    others = [c for c in results.columns if c not in RESULT_KEY]
    newest = F.max_by(F.struct(*others), F.struct(order_by, tie_breaker))
    return results.groupBy(*RESULT_KEY).agg(newest.alias("__row")).select(
        *RESULT_KEY, *[F.col(f"__row.{c}").alias(c) for c in others]
    )


def dataset_metrics(
    results: DataFrame,
    known: DataFrame | None = None,
    dedupe: str | None = None,
    order_by: str = "result_ts",
    tie_breaker: str = "result_id",
) -> DataFrame:
    """Pass, format and extraction rates, times and tokens per model and data set.

    Only answered rows count.  ``known`` (``model_id, dataset_name``) adds an
    all-zero row for data sets without any.  Several answered rows of one task
    all count unless ``dedupe='latest'``.
    """
    if dedupe not in (None, "latest"):
        raise ValueError(f"unknown dedupe: {dedupe!r} (use None or 'latest')")
    used = ["passed", "correct_format", "extraction_success", "sandbox_execution_time", "token_count"]
    rows = results.where(answered())
    if dedupe == "latest":
        rows = latest_per_task(
            rows.select(*RESULT_KEY, *used, order_by, tie_breaker), order_by, tie_breaker
        )
    keys = ["model_id", "dataset_name"]
    metrics = rows.groupBy(*keys).agg(
        _share(F.col("passed")).alias("pass_rate"),
        _share(F.col("correct_format")).alias("format_success_rate"),
        _share(F.col("extraction_success")).alias("extraction_success_rate"),
        F.avg(F.coalesce("sandbox_execution_time", F.lit(0.0))).alias("avg_sandbox_execution_time"),
        F.sum("token_count").alias("total_tokens"),
        F.avg("token_count").alias("avg_tokens"),
        F.count(F.lit(1)).alias("completed_tasks"),
    )
    if known is None:
        return metrics
    return known.select(*keys).distinct().join(metrics, keys, "left").na.fill(0)


# --- verification of data sets ------------------------------------------------------


def with_outcome(executions: DataFrame) -> DataFrame:
    return executions.withColumn("outcome", O.parse_outcome(F.col("stdout")))


def overall_pass_rate(executions: DataFrame, keys: list[str]) -> DataFrame:
    """Benchmark A: share of scripts whose printed object says passed."""
    passed = (F.col("outcome.kind") == "object") & F.col("outcome.passed")
    return with_outcome(executions).groupBy(*keys).agg(
        F.count_if(passed).alias("n_passed"),
        F.count(F.lit(1)).alias("n_tasks"),
        _share(passed).alias("pass_rate"),
    )


def verify_per_task(
    long_runs: DataFrame, short_runs: DataFrame, row_key: str, keep: list[str] = ()
) -> DataFrame:
    """Results of the long and the short tests, one row per task and kind.

    Anything but a non-empty list counts as one failed test.
    """
    failed = F.array(F.lit(False))
    parts = []
    for kind, runs in (("long", long_runs), ("short", short_runs)):
        results = F.col("outcome.results")
        usable = F.coalesce(F.size(results) > 0, F.lit(False))
        parts.append(
            with_outcome(runs).select(
                row_key,
                *keep,
                F.lit(kind).alias("kind"),
                F.when(usable, results).otherwise(failed).alias("results"),
            )
        )
    return parts[0].unionByName(parts[1])


def verify_summary(per_task: DataFrame, keys: list[str] = ("kind",)) -> DataFrame:
    """Task-level and test-level pass rates."""
    passed = O.all_passed(F.col("results"))
    n_true = F.sum(O.count_true(F.col("results")))
    n_tests = F.sum(F.size("results"))
    return per_task.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(passed).alias("n_tasks_passed"),
        _share(passed).alias("task_pass_rate"),
        n_tests.alias("n_tests"),
        n_true.alias("n_tests_passed"),
        (n_true / n_tests).alias("test_pass_rate"),
    )


def with_skip_reason(executions: DataFrame) -> DataFrame:
    """Why a self-check does not count: failed run, or output that is no list."""
    reason = (
        F.when(~F.col("success"), X.joined_messages(F.col("errors")))
        .when(F.col("outcome.kind") == "invalid", "Output parsing error: not valid JSON")
        .when(F.col("outcome.kind") != "list", "Output parsing error: not a list")
    )
    return with_outcome(executions).withColumn("skip_reason", reason)


def skipped_examples(executions: DataFrame, row_key: str, code: str) -> DataFrame:
    return (
        with_skip_reason(executions)
        .where(F.col("skip_reason").isNotNull())
        .select(row_key, F.col("skip_reason").alias("errors"), "sandbox_type", F.col(code).alias("code"))
    )


def kept_examples(executions: DataFrame, row_key: str) -> DataFrame:
    return (
        with_skip_reason(executions)
        .where(F.col("skip_reason").isNull())
        .select(row_key, F.col("outcome.results").alias("test_results"), "sandbox_type")
    )


def training_verification(executions: DataFrame) -> DataFrame:
    """One-row summary of a training self-check.

    Skipped examples stay out of the denominators and are counted beside them;
    all rates are 0 without any kept example.
    """
    kept = F.col("skip_reason").isNull()
    results = F.col("outcome.results")
    n_tests = F.sum(F.when(kept, F.size(results)))
    n_true = F.sum(F.when(kept, O.count_true(results)))
    n_kept = F.count_if(kept)
    zero = F.lit(0.0)
    return with_skip_reason(executions).agg(
        F.coalesce(F.try_divide(F.count_if(kept & O.all_passed(results)), n_kept), zero).alias(
            "overall_pass_rate"
        ),
        F.coalesce(F.try_divide(n_true, n_tests), zero).alias("test_level_pass_rate"),
        n_kept.alias("n_kept"),
        F.count_if(F.col("sandbox_type") == V.FAST_ENGINE).alias("fast_count"),
        F.count_if(F.col("sandbox_type") == V.CONTAINER_ENGINE).alias("container_count"),
        F.count_if(~kept).alias("skipped_count"),
    )


# --- telemetry -------------------------------------------------------------------------


def checked_engine(engine: Column) -> Column:
    """The engine name; null and any other value count as ``unknown``."""
    return F.when(engine.isin(V.ENGINES), engine).otherwise(F.lit("unknown"))


#: Bins a bracket around the median is counted in.
MEDIAN_BINS = 4096


def execution_telemetry(executions: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """Count, share, mean, exact median, success rate and throughput per engine.

    The median is exact without collecting a group: a mergeable sketch brackets
    it, the bracket is counted in ``MEDIAN_BINS`` bins, and only the distinct values
    of the bins that hold the middle are ranked.  There are
    as many brackets as engines (three, and ``unknown``), so they are broadcast.
    """
    rows = executions.select(
        checked_engine(F.col("sandbox_type")).alias("sandbox_type"), "duration_sec", "success"
    )
    margin = 2.0 / accuracy
    sketch = F.percentile_approx("duration_sec", [0.5 - margin, 0.5 + margin], accuracy)
    stats = rows.groupBy("sandbox_type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("duration_sec").alias("n_timed"),
        F.avg("duration_sec").alias("mean_sec"),
        _share(F.col("success")).alias("success_rate"),
        F.try_divide(F.count("duration_sec"), F.sum("duration_sec")).alias("runs_per_sec"),
        sketch.alias("bracket"),
    )
    bracket = stats.select(
        "sandbox_type", F.col("bracket")[0].alias("low"), F.col("bracket")[1].alias("high"),
        F.floor((F.col("n_timed") + 1) / 2).alias("lower"), (F.floor(F.col("n_timed") / 2) + 1).alias("upper"),
    )
    value = F.col("duration_sec")
    share = F.try_divide(value - F.col("low"), F.col("high") - F.col("low"))
    inside = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * MEDIAN_BINS), F.lit(MEDIAN_BINS - 1))
    binned = rows.where(value.isNotNull()).join(F.broadcast(bracket), "sandbox_type").where(value <= F.col("high")).withColumn(
        "bin", F.when(value < F.col("low"), -1).otherwise(inside).cast("int")
    )
    # at most MEDIAN_BINS + 1 rows for each engine
    by_bin = Window.partitionBy("sandbox_type").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    bins = binned.groupBy("sandbox_type", "lower", "upper", "bin").agg(F.count(F.lit(1)).alias("in_bin")).withColumn(
        "upto_bin", F.sum("in_bin").over(by_bin)
    )
    holds = lambda place: (F.col(place) > F.col("upto_bin") - F.col("in_bin")) & (F.col(place) <= F.col("upto_bin"))
    chosen = bins.where(holds("lower") | holds("upper")).select("sandbox_type", "bin", (F.col("upto_bin") - F.col("in_bin")).alias("before"))
    # the one or two bins that hold the middle: distinct values in a tiny share of the rows
    counted = binned.join(F.broadcast(chosen), ["sandbox_type", "bin"]).groupBy(
        "sandbox_type", "lower", "upper", "bin", "before", value.alias("value")
    ).agg(F.count(F.lit(1)).alias("rows"))
    by_value = Window.partitionBy("sandbox_type", "bin").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda place: F.min(F.when(F.col("upto") >= F.col(place), F.col("value")))
    medians = (
        counted.withColumn("upto", F.col("before") + F.sum("rows").over(by_value))
        .groupBy("sandbox_type")
        .agg(((at("lower") + at("upper")) / 2).alias("median_sec"))
    )
    everything = Window.partitionBy()  # four rows at most
    return stats.join(F.broadcast(medians), "sandbox_type", "left").select(
        "sandbox_type",
        "n",
        (F.col("n") / F.sum("n").over(everything)).alias("share"),
        "mean_sec",
        "median_sec",
        "success_rate",
        "runs_per_sec",
    )


def row_throughput(generations: DataFrame) -> DataFrame:
    """Tokens per second of each generation."""
    return generations.withColumn(
        "throughput", X.throughput(F.col("token_count"), F.col("generation_time"))
    )


def batch_throughput(generations: DataFrame, batch: str, row_key: str) -> DataFrame:
    """Tokens per second of the whole batch, on each of its rows.

    All rows of a batch carry the batch's generation time.  Batches are summed
    first; the sums are joined back with hot batches split.
    """
    sums = generations.groupBy(batch).agg(
        F.sum("token_count").alias("__tokens"), F.max("generation_time").alias("__seconds")
    )
    rate = X.throughput(F.col("__tokens"), F.col("__seconds"))
    per_batch = sums.select(batch, rate.alias("throughput"))
    return skew_join(generations.drop("throughput"), per_batch, [batch], "left", [row_key])


def request_summary(requests: DataFrame, keys: list[str]) -> DataFrame:
    """Total tokens, mean seconds per request and tokens per wall-clock second.

    ``requests`` has ``start_time``, ``end_time`` and ``token_count``.
    """
    wall = X.duration_seconds(F.min("start_time"), F.max("end_time"))
    tokens = F.sum("token_count")
    return requests.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_requests"),
        tokens.alias("total_tokens"),
        wall.alias("total_sec"),
        (wall / F.count(F.lit(1))).alias("avg_sec"),
        X.throughput(tokens, wall).alias("tokens_per_sec"),
    )


def model_change(metrics: DataFrame, base: str, tuned: str, value: str = "pass_rate") -> DataFrame:
    """Relative change of a metric from one model to another, per data set."""
    pick = lambda model: F.max(F.when(F.col("model_id") == model, F.col(value)))
    return metrics.groupBy("dataset_name").agg(
        pick(base).alias("base"),
        pick(tuned).alias("tuned"),
        F.try_divide(pick(tuned) - pick(base), pick(base)).alias("change"),
    )


def is_evaluation_step(step: Column, every: int) -> Column:
    return (step > 0) & (step % every == 0)


def periodic_metrics(results: DataFrame, every: int, dataset_names: list[str]) -> DataFrame:
    """Pass rate of each data set at every n-th step, one column per data set."""
    rows = results.where(is_evaluation_step(F.col("step"), every) & answered())
    pivoted = rows.groupBy("step").pivot("dataset_name", dataset_names).agg(_share(F.col("passed")))
    return pivoted.select(
        "step", *[F.col(f"`{d}`").alias(f"eval/{d}_pass_rate") for d in dataset_names]
    )


def periodic_metric_map(results: DataFrame, every: int) -> DataFrame:
    """The same as one map per step, for data sets not known beforehand."""
    per_dataset = (
        results.where(is_evaluation_step(F.col("step"), every) & answered())
        .groupBy("step", "dataset_name")
        .agg(_share(F.col("passed")).alias("pass_rate"))
    )
    name = F.concat(F.lit("eval/"), "dataset_name", F.lit("_pass_rate"))
    entries = F.array_sort(F.collect_list(F.struct(name.alias("key"), F.col("pass_rate").alias("value"))))
    return per_dataset.groupBy("step").agg(F.map_from_entries(entries).alias("metrics"))
