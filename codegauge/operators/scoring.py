"""From completions to scripts, and from executions to rewards and task results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge.functions import execution as X
from codegauge.functions import outcome as O
from codegauge.functions import scripts as S
from codegauge.functions.extract import extract_code
from codegauge.operators.joins import skew_join
from codegauge.schemas import TASK_RESULT


def build_scripts(
    completions: DataFrame,
    tasks: DataFrame,
    row_key: str,
    test_column: str,
    mode: str,
    run_empty: bool | None = None,
    carry: Sequence[str] = (),
) -> DataFrame:
    """One row per completion with its code and the script to run.

    ``mode='marker'`` fills the solution marker of the task's test (evaluation),
    ``mode='append'`` puts the tests after the code (rewards).  ``script`` is
    null where nothing is to run: no code, or an empty block unless ``run_empty``
    (default: rewards run it, evaluation does not).  ``carry`` names task columns
    to keep.  A task may own any share of the completions.
    """
    if mode not in ("marker", "append"):
        raise ValueError(f"unknown mode: {mode!r} (use 'marker' or 'append')")
    run_empty = (mode == "append") if run_empty is None else run_empty
    extracted = completions.withColumn("__code", extract_code(F.col("completion")))
    wanted = tasks.select("task_id", *carry, F.col(test_column).alias("__test"))
    if row_key == "task_id":  # one completion per task: no hot keys
        joined = extracted.join(wanted, "task_id")
    else:
        joined = skew_join(extracted, wanted, ["task_id"], "inner", [row_key])
    code = F.col("__code.code")
    script = (
        S.fill_solution(F.col("__test"), code)
        if mode == "marker"
        else S.append_tests(code, F.col("__test"))
    )
    runs = code.isNotNull() if run_empty else F.length(code) > 0
    return joined.select(
        *[c for c in joined.columns if not c.startswith("__")],
        code.alias("extracted_code"),
        F.col("__code.correct_format").alias("correct_format"),
        F.when(runs, script).alias("script"),
    )


def _failed() -> Column:
    return ~X.succeeded(
        F.col("exit_code"),
        F.col("is_valid_python"),
        F.col("errors"),
        F.col("timed_out"),
        F.col("memory_limit_hit"),
    )


def classify_execution(df: DataFrame) -> DataFrame:
    """Add error class, limit flags and success, derived from the exit code."""
    code = F.col("exit_code")
    errors = F.col("errors") if "errors" in df.columns else None
    return df.withColumns({
        "error_class": X.error_class_of_exit(code),
        "timed_out": X.timed_out(code),
        "memory_limit_hit": X.memory_limit_hit(code),
        "success": X.succeeded(code, F.col("is_valid_python"), errors),
    })


def add_rewards(df: DataFrame, binary: bool = False, gate_on_failed: bool = True) -> DataFrame:
    """Reward per row from ``extracted_code, stdout, success``; null means not run."""
    scored = df.withColumn("__outcome", O.parse_outcome(F.col("stdout")))
    failed = ~F.col("success") if gate_on_failed else F.col("success").isNull()
    value = O.reward(F.col("extracted_code"), failed, F.col("__outcome"), binary)
    return scored.withColumn("reward", value).drop("__outcome")


def score_rewards(
    scripts: DataFrame,
    executions: DataFrame,
    row_key: str,
    binary: bool = False,
    gate_on_failed: bool = True,
) -> DataFrame:
    """Reward per completion; rows that were not executed get 0.

    ``executions`` has one row per executed ``row_key`` with ``stdout`` and
    ``success``.  Executions attached to the scripts need ``add_rewards`` only.
    """
    runs = executions.select(row_key, "stdout", "success")
    joined = scripts.join(runs, row_key, "left")
    return add_rewards(joined, binary, gate_on_failed).drop("stdout", "success")


def apply_rewards(
    df: DataFrame,
    rewards: dict[str, Callable[..., Column]],
    weights: dict[str, float] | None = None,
) -> DataFrame:
    """Add one column per reward function, and their weighted sum as ``reward``.

    A reward function gets every column of ``df`` as a keyword argument and gives
    a column expression.
    """
    columns = {name: F.col(f"`{name}`") for name in df.columns}
    values = {name: build(**columns) for name, build in rewards.items()}
    scored = df.withColumns(values)
    return scored.withColumn("reward", O.combine_rewards({n: F.col(n) for n in values}, weights))


def score_tasks(
    scripts: DataFrame,
    executions: DataFrame,
    row_key: str,
    dataset_name: str,
    model_name: str,
    model_id: str,
    timestamp: Column | None = None,
    gate_on_failed: bool = False,
    empty_is_pass: bool = True,
) -> DataFrame:
    """Task result rows (schema ``TASK_RESULT``) for evaluated completions.

    ``scripts`` carries ``task_id, prompt, completion, generation_time,
    token_count, throughput`` and the columns of ``build_scripts``; rows without
    an execution keep the defaults.
    """
    runs = executions.select(
        row_key, "stdout", "success", "duration_sec", X.joined_messages(F.col("errors")).alias("__messages")
    )
    joined = scripts.join(runs, row_key, "left").withColumn(
        "__outcome", O.parse_outcome(F.col("stdout"))
    )
    passed = O.task_passed(F.col("__outcome"), empty_is_pass)
    if gate_on_failed:
        passed = passed & F.coalesce(F.col("success"), F.lit(False))
    stamp = timestamp if timestamp is not None else F.current_timestamp()
    values = {
        "model_name": F.lit(model_name),
        "model_id": F.lit(model_id),
        "dataset_name": F.lit(dataset_name),
        "task_id": F.col("task_id"),
        "timestamp": F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"),
        "passed": passed,
        "pass_rate": O.task_pass_rate(F.col("__outcome")),
        "correct_format": F.col("correct_format"),
        "extraction_success": F.col("extracted_code").isNotNull(),
        "sandbox_execution_time": F.coalesce(F.col("duration_sec"), F.lit(0.0)),
        "generation_time": F.col("generation_time"),
        "token_count": F.col("token_count"),
        "throughput": F.col("throughput"),
        "error_message": F.when(
            ~F.col("success"), F.concat(F.lit("Sandbox failed: "), F.col("__messages"))
        ),
        "prompt": F.col("prompt"),
        "completion": F.col("completion"),
        "extracted_code": F.col("extracted_code"),
    }
    return joined.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in TASK_RESULT.fields]
    )
