"""The three end-to-end jobs, each as one chain of operators."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codegauge.functions import execution as X
from codegauge.operators import checkpoints, metrics, scoring
from codegauge.sources import results
from codegauge.storage import stage

# rows with a ``script`` column, key -> one execution per scripted row
Execute = Callable[[DataFrame, str], DataFrame]


def with_success(executions: DataFrame) -> DataFrame:
    return executions.withColumn(
        "success",
        X.succeeded(
            F.col("exit_code"),
            F.col("is_valid_python"),
            F.col("errors"),
            F.col("timed_out"),
            F.col("memory_limit_hit"),
        ),
    )


def reward_completions(
    tasks: DataFrame,
    completions: DataFrame,
    execute: Execute,
    row_key: str = "sample_id",
    tests: str = "tests",
    binary: bool = False,
) -> DataFrame:
    """Completions to rewards: extract, append tests, run, score."""
    # read several times below: kept as a table instead of built again
    scripts = stage(
        scoring.build_scripts(completions, tasks, row_key, tests, mode="append"), "scripts"
    )
    executions = with_success(execute(scripts.where(F.col("script").isNotNull()), row_key))
    return scoring.score_rewards(scripts, executions, row_key, binary)


def evaluate_dataset(
    tasks: DataFrame,
    results_so_far: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    execute: Execute,
    dataset_name: str,
    model_name: str,
    model_id: str,
) -> DataFrame:
    """Task results for the tasks still pending.

    ``generate`` turns pending tasks into generations (``task_id, completion,
    token_count, generation_time, throughput``).
    """
    mine = results_so_far.where(
        (F.col("dataset_name") == dataset_name) & (F.col("model_id") == model_id)
    )
    todo = stage(checkpoints.pending(tasks, mine, ["task_id"]), "pending")
    # generations cost the most, so they are stored before anything reads them
    generations = stage(generate(todo), "generations")
    scripts = stage(
        scoring.build_scripts(
            generations, todo, "task_id", "test", mode="marker", carry=["prompt"]
        ),
        "scripts",
    )
    executions = with_success(execute(scripts.where(F.col("script").isNotNull()), "task_id"))
    return scoring.score_tasks(
        scripts, executions, "task_id", dataset_name, model_name, model_id
    )


def new_run_stamp() -> str:
    return datetime.datetime.now(datetime.timezone.utc).strftime("%Y-%m-%dT%H-%M-%SZ")


def evaluate(
    spark: SparkSession,
    tasks: dict[str, DataFrame],
    results_path: str,
    generate: Callable[[DataFrame], DataFrame],
    execute: Execute,
    model_name: str,
    model_id: str,
    resume: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Evaluate a model on several data sets and append the results.

    Goes on with the model's newest run; starts a new one if there is none, if
    ``resume`` is off, or if no task is pending in any data set.  Gives the
    metrics per data set and the rows of the run.
    """
    run_ts = results.newest_run(spark, results_path, model_id) if resume else None
    todo = dict(tasks)
    if run_ts is not None:
        so_far = results.read_run(spark, results_path, model_id, run_ts)
        todo = {
            name: df
            for name, df in tasks.items()
            if not checkpoints.pending(
                df, so_far.where(F.col("dataset_name") == name), ["task_id"]
            ).isEmpty()
        }
    if run_ts is None or not todo:
        run_ts, todo = new_run_stamp(), dict(tasks)
    for name, df in todo.items():
        so_far = results.read_run(spark, results_path, model_id, run_ts)
        rows = evaluate_dataset(df, so_far, generate, execute, name, model_name, model_id)
        results.append_results(rows.withColumn("run_ts", F.lit(run_ts)), results_path)
    run = results.read_run(spark, results_path, model_id, run_ts)
    known = spark.createDataFrame([(model_id, n) for n in tasks], "model_id string, dataset_name string")
    return metrics.dataset_metrics(run, known), run


def verify_benchmark(
    prepared: DataFrame, execute: Execute, row_key: str = "task_id"
) -> tuple[DataFrame, DataFrame]:
    """Do the canonical solutions pass?  Gives (summary, per task and test kind)."""
    runs = [
        stage(execute(prepared.select(row_key, F.col(column).alias("script")), row_key), "verified")
        for column in ("test_solution", "short_test_solution")
    ]
    per_task = metrics.verify_per_task(*runs, row_key)
    return metrics.verify_summary(per_task), per_task


def verify_training(
    prepared: DataFrame, execute: Execute, row_key: str = "seq_id"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Training self-check.  Gives (summary, kept examples, skipped examples)."""
    scripts = prepared.select(row_key, F.col("test_solution").alias("script"))
    # stored: the three results below must speak of the same runs
    executions = stage(with_success(execute(scripts, row_key)).join(scripts, row_key), "self-checks")
    return (
        metrics.training_verification(executions),
        metrics.kept_examples(executions, row_key),
        metrics.skipped_examples(executions, row_key, "script"),
    )
