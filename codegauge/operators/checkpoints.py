"""What an evaluation still has to do, derived from its result rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.operators.joins import skew_join

TASK_KEY = ["dataset_name", "task_id"]


def answered() -> Column:
    """The model gave an answer; null token counts count as none."""
    return F.coalesce(F.col("token_count") > 0, F.lit(False))


def task_status(results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per task: is there any answered result?"""
    keys = keys or ["model_id", *TASK_KEY]
    return results.groupBy(*keys).agg(
        F.bool_or(answered()).alias("is_answered"), F.count(F.lit(1)).alias("n_results")
    )


def pending(tasks: DataFrame, results: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Tasks without an answered result (anti join on the task key).

    The result side shrinks to distinct keys before it is shuffled, so copies of
    one task's results cost nothing.
    """
    keys = keys or TASK_KEY
    done = results.where(answered()).select(*keys).distinct()
    return tasks.join(done, keys, "left_anti")


def run_status(tasks: DataFrame, results: DataFrame, models: DataFrame | None = None) -> DataFrame:
    """Per model and data set: finished, unanswered and pending tasks.

    Starts from the data sets of ``tasks`` for each model of ``models`` (default: those
    with any result), so a data set that was never started has all its tasks pending.
    Repeated task rows count once.  A data set is complete when no task is pending; a run
    that stopped early is therefore continued.
    """
    models = (results if models is None else models).select("model_id").distinct()
    task_keys = tasks.select(*TASK_KEY).distinct()
    n_tasks = task_keys.groupBy("dataset_name").agg(F.count(F.lit(1)).alias("n_tasks"))
    # one short row: data sets are few
    datasets = n_tasks.agg(F.collect_list(F.struct("dataset_name", "n_tasks"))).scalar()
    expected = models.select("model_id", F.inline(datasets))
    known = task_status(results).join(task_keys.withColumn("is_task", F.lit(True)), TASK_KEY, "left")
    done = known.groupBy("model_id", "dataset_name").agg(
        F.count_if(F.col("is_answered")).alias("n_completed"),
        F.count_if(~F.col("is_answered")).alias("n_incomplete"),
        F.count_if(F.col("is_answered") & F.col("is_task")).alias("n_done_tasks"),
    )
    status = expected.join(done, ["model_id", "dataset_name"], "left").na.fill(0, ["n_completed", "n_incomplete", "n_done_tasks"])
    n_pending = F.col("n_tasks") - F.col("n_done_tasks")
    return status.select(
        "model_id",
        "dataset_name",
        "n_completed",
        "n_incomplete",
        n_pending.alias("n_pending"),
        (n_pending == 0).alias("is_complete"),
    )


def datasets_to_evaluate(status: DataFrame) -> DataFrame:
    """Data sets to run per model: the incomplete ones, or all in a new run.

    When every data set of a model is complete, all are run again.
    """
    per_model = status.groupBy("model_id").agg(F.bool_and("is_complete").alias("starts_new_run"))
    return (
        status.join(per_model, "model_id")
        .where(F.col("starts_new_run") | ~F.col("is_complete"))
        .select("model_id", "dataset_name", "starts_new_run")
    )


def latest_run(results: DataFrame, spread_by: list[str], run_column: str = "run_ts") -> DataFrame:
    """Result rows of each model's newest run."""
    newest = results.groupBy("model_id").agg(F.max(run_column).alias(run_column))
    return skew_join(results, newest, ["model_id", run_column], "left_semi", spread_by)
