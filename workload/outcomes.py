"""Outcomes, verdicts, execution status and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import execution as X
from codegauge.functions import outcome as O
from codegauge.operators import metrics, scoring
from workload.sqltext import EXTRACTED, PARSED
from workload.views import view, with_views


def _executions(spark, sf_dir):
    """fx_executions with success and an error list derived from the exit code."""
    df = view(spark, sf_dir, "fx_executions")
    message = X.error_message_of_exit(F.col("exit_code"), F.lit("boom"), F.lit(10.0))
    error = F.struct(
        X.error_class_of_exit(F.col("exit_code")).alias("error_class"),
        message.alias("message"),
        F.lit(None).cast("string").alias("traceback"),
    )
    errors = F.when(message.isNotNull(), F.array(error)).otherwise(F.array().cast(
        "array<struct<error_class:string,message:string,traceback:string>>"))
    return scoring.classify_execution(df.withColumn("errors", errors))


def outcome_parse(spark, sf_dir):
    df = view(spark, sf_dir, "fx_executions")
    parsed = df.select("exec_id", O.parse_outcome(F.col("stdout")).alias("o"))
    return parsed.select(
        "exec_id",
        "o.kind",
        F.when(F.col("o.results").isNotNull(), F.size("o.results")).cast("bigint").alias("n_results"),
        F.when(F.col("o.results").isNotNull(), O.count_true(F.col("o.results"))).cast("bigint").alias("n_true"),
        O.task_passed(F.col("o")).alias("passed"),
        O.task_pass_rate(F.col("o")).alias("pass_rate"),
    )


def json_truth(spark, sf_dir):
    """Truth of mixed JSON values, as Python sees it."""
    df = view(spark, sf_dir, "fx_executions")
    line = F.concat(
        F.lit("["), F.col("exit_code").cast("string"), F.lit(', "", "'), F.col("exit_code").cast("string"),
        F.lit('", null, [], [0], [null], {}, {"a": 0}, 0.0, 1.5, true, false]'),
    )
    results = O.parse_outcome(line)["results"]
    return df.select(
        "exec_id",
        F.array_join(F.transform(results, lambda r: r.cast("int").cast("string")), "").alias("truths"),
    )


def task_pass(spark, sf_dir):
    """Tasks passed per prompt, with and without credit for an empty result list."""
    df = metrics.with_outcome(view(spark, sf_dir, "fx_executions"))
    return df.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n_tasks"),
        F.count_if(O.task_passed(F.col("outcome"))).alias("n_passed"),
        F.count_if(O.task_passed(F.col("outcome"), empty_is_pass=False)).alias("n_passed_strict"),
    )


def test_pass_rate(spark, sf_dir):
    """Share of single tests passed per engine, over all list outcomes."""
    df = metrics.with_outcome(view(spark, sf_dir, "fx_executions"))
    results = F.col("outcome.results")
    return (
        df.where(results.isNotNull())
        .groupBy("sandbox_type")
        .agg(
            F.sum(F.size(results)).alias("n_tests"),
            F.sum(O.count_true(results)).alias("n_tests_passed"),
            (F.sum(O.count_true(results)) / F.sum(F.size(results))).alias("test_pass_rate"),
        )
    )


def execution_status(spark, sf_dir):
    df = _executions(spark, sf_dir)
    start = F.col("start_time").cast("timestamp")
    end = F.timestamp_micros(F.unix_micros(start) + F.floor(F.col("duration_sec") * 1e6))
    return df.select(
        "exec_id", "error_class", "timed_out", "memory_limit_hit", "success",
        X.joined_messages(F.col("errors")).alias("message"),
        X.exit_code_of(F.col("error_class")).alias("exit_code"),
        X.duration_seconds(start, end).alias("seconds"),
    )


def error_classes(spark, sf_dir):
    """Error class, exit code and validity from the engine's message."""
    df = view(spark, sf_dir, "fx_executions")
    kind = (
        F.when(F.col("exec_id") % 5 == 0, F.lit(None).cast("string"))
        .when(F.col("exec_id") % 5 == 1, "not_implemented")
        .when(F.col("exec_id") % 5 == 2, "syntax")
        .when(F.col("exec_id") % 5 == 3, "other")
        .otherwise("runtime")
    )
    message = (
        F.when(F.col("exit_code") == 124, "TimeoutError: limit")
        .when(F.col("exit_code") == 137, "MemoryError: limit")
        .otherwise("SyntaxError: bad")
    )
    found = X.error_class_of_message(kind, message)
    return df.select(
        "exec_id",
        found.alias("error_class"),
        X.exit_code_of(found).alias("exit_code"),
        X.valid_python_by_stderr(message).alias("is_valid_python"),
    )


def _scored(spark, sf_dir, mode):
    tasks = view(spark, sf_dir, "fx_tasks")
    completions = view(spark, sf_dir, "fx_completions")
    executions = _executions(spark, sf_dir).withColumnRenamed("exec_id", "sample_id")
    if mode == "marker":
        tasks = tasks.withColumn("test", F.concat(F.lit("{solution}\n"), "test", F.lit("\n{0}")))
    return scoring.build_scripts(completions, tasks, "sample_id", "test", mode), executions


def _reward(binary):
    def run(spark, sf_dir):
        scripts, executions = _scored(spark, sf_dir, "append")
        scored = scoring.score_rewards(scripts, executions, "sample_id", binary=binary)
        return scored.select("sample_id", "reward", F.md5("script").alias("script_md5"))

    return run


def reward_weighted(spark, sf_dir):
    """Accuracy plus a small reward for the asked format."""
    scripts, executions = _scored(spark, sf_dir, "append")
    scored = scoring.score_rewards(scripts, executions, "sample_id")
    total = scoring.apply_rewards(
        scored.withColumnRenamed("reward", "rate"),
        {
            "accuracy": lambda rate, **_: rate,
            "format_reward": lambda correct_format, **_: correct_format.cast("double"),
        },
        {"format_reward": 0.25},
    )
    return total.select("sample_id", "reward")


def task_scoring(spark, sf_dir):
    """Evaluation rows: marker filled, outcome parsed, failures described."""
    scripts, executions = _scored(spark, sf_dir, "marker")
    scripts = scripts.withColumns({
        "prompt": F.array().cast("array<struct<role:string,content:string>>"),
        "generation_time": F.lit(0.5),
        "token_count": F.length("completion"),
        "throughput": F.lit(2.0),
    })
    rows = scoring.score_tasks(
        scripts.withColumn("task_id", F.col("sample_id").cast("string")),
        executions, "sample_id", "mbpp", "base", "base-1",
    )
    return rows.select(
        "task_id", "model_id", "dataset_name", "passed", "pass_rate", "correct_format",
        "extraction_success", "sandbox_execution_time", "token_count", "error_message", "extracted_code",
    )


def marker_scripts(spark, sf_dir):
    """Scripts with the solution at the marker; other braces stay."""
    scripts, _ = _scored(spark, sf_dir, "marker")
    return scripts.select("sample_id", F.md5("script").alias("script_md5"))


QUERIES = {
    "outcome_parse": outcome_parse,
    "json_truth": json_truth,
    "task_pass": task_pass,
    "test_pass_rate": test_pass_rate,
    "execution_status": execution_status,
    "error_classes": error_classes,
    "reward_partial": _reward(False),
    "reward_binary": _reward(True),
    "reward_weighted": reward_weighted,
    "task_scoring": task_scoring,
    "marker_scripts": marker_scripts,
}

MESSAGE = """CASE exit_code WHEN 0 THEN '' WHEN 124 THEN 'Execution timed out after 10.0 seconds'
  WHEN 137 THEN 'Memory limit exceeded (OOM)'
  ELSE concat('Execution failed with exit code ', CAST(exit_code AS string), ': boom') END"""

SCORED = f"""
{EXTRACTED}, {PARSED.strip()}, scored AS (
  SELECT e.*, v.success, v.kind, v.passed, v.pass_rate AS rate, v.duration_sec, v.exit_code, t.test,
    CASE WHEN e.code IS NOT NULL AND coalesce(v.success, false) AND v.kind = 'list' THEN v.pass_rate ELSE 0.0 END AS reward
  FROM extracted e JOIN fx_tasks t ON t.task_id = e.task_id
  LEFT JOIN verdict v ON v.exec_id = e.sample_id
)"""
SCORED_VIEWS = ["fx_completions", "fx_executions", "fx_tasks"]
APPENDED = "CASE WHEN code IS NOT NULL THEN md5(concat(code, chr(10), chr(10), test)) END"

ORACLES = {
    "outcome_parse": with_views(
        ["fx_executions"],
        f"+{PARSED} SELECT exec_id, kind, n_results, n_true, passed, pass_rate FROM verdict",
    ),
    "json_truth": with_views(
        ["fx_executions"],
        """+ lines AS (
          SELECT exec_id, concat('[', CAST(exit_code AS string), ', "", "', CAST(exit_code AS string),
            '", null, [], [0], [null], {}, {"a": 0}, 0.0, 1.5, true, false]') AS line FROM fx_executions
        )
        SELECT exec_id, array_to_string(list_transform(json_extract(line, '$[*]'), lambda j:
          CASE json_type(j) WHEN 'NULL' THEN '0'
            WHEN 'BOOLEAN' THEN CASE WHEN CAST(j AS string) = 'true' THEN '1' ELSE '0' END
            WHEN 'VARCHAR' THEN CASE WHEN CAST(j AS string) = '""' THEN '0' ELSE '1' END
            WHEN 'ARRAY' THEN CASE WHEN json_array_length(j) > 0 THEN '1' ELSE '0' END
            WHEN 'OBJECT' THEN CASE WHEN len(json_keys(j)) > 0 THEN '1' ELSE '0' END
            ELSE CASE WHEN CAST(j AS double) <> 0 THEN '1' ELSE '0' END END), '') AS truths
        FROM lines""",
    ),
    "task_pass": with_views(
        ["fx_executions"],
        f"""+{PARSED}
        SELECT prompt_id, count(*) AS n_tasks, count(*) FILTER (WHERE passed) AS n_passed,
          count(*) FILTER (WHERE passed AND coalesce(n_results, 1) > 0) AS n_passed_strict
        FROM verdict GROUP BY prompt_id""",
    ),
    "test_pass_rate": with_views(
        ["fx_executions"],
        f"""+{PARSED}
        SELECT sandbox_type, CAST(sum(n_results) AS BIGINT) AS n_tests, CAST(sum(n_true) AS BIGINT) AS n_tests_passed,
          sum(n_true) / sum(n_results) AS test_pass_rate
        FROM verdict WHERE kind = 'list' GROUP BY sandbox_type""",
    ),
    "execution_status": with_views(
        ["fx_executions"],
        f"""
        SELECT exec_id,
          CASE exit_code WHEN 0 THEN NULL WHEN 124 THEN 'timeout' WHEN 137 THEN 'memory' ELSE 'runtime' END AS error_class,
          exit_code = 124 AS timed_out, exit_code = 137 AS memory_limit_hit,
          exit_code = 0 AND is_valid_python AS success, {MESSAGE} AS message, exit_code,
          floor(duration_sec * 1.0E6) / 1.0E6 AS seconds
        FROM fx_executions""",
    ),
    "error_classes": with_views(
        ["fx_executions"],
        """+ found AS (
          SELECT exec_id, exit_code AS code, CASE exec_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'not_supported' WHEN 2 THEN 'syntax'
            WHEN 3 THEN 'error' ELSE CASE exit_code WHEN 124 THEN 'timeout' WHEN 137 THEN 'memory' ELSE 'runtime' END END AS error_class
          FROM fx_executions)
        SELECT exec_id, error_class,
          CAST(CASE WHEN error_class IS NULL THEN 0 WHEN error_class = 'timeout' THEN 124 WHEN error_class = 'memory' THEN 137 ELSE 1 END AS INTEGER) AS exit_code,
          code IN (124, 137) AS is_valid_python
        FROM found""",
    ),
    "reward_partial": with_views(
        SCORED_VIEWS, f"+{SCORED} SELECT sample_id, reward, {APPENDED} AS script_md5 FROM scored"
    ),
    "reward_binary": with_views(
        SCORED_VIEWS,
        f"""+{SCORED} SELECT sample_id, CASE WHEN reward = 1.0 THEN 1.0E0 ELSE 0.0E0 END AS reward,
        {APPENDED} AS script_md5 FROM scored""",
    ),
    "reward_weighted": with_views(
        SCORED_VIEWS,
        f"""+{SCORED} SELECT sample_id,
        reward + CASE WHEN correct_format THEN 0.25E0 ELSE 0.0E0 END AS reward FROM scored""",
    ),
    "task_scoring": with_views(
        SCORED_VIEWS,
        f"""+{SCORED} SELECT CAST(sample_id AS string) AS task_id, 'base-1' AS model_id, 'mbpp' AS dataset_name,
          coalesce(passed, false) AS passed, rate AS pass_rate, correct_format, code IS NOT NULL AS extraction_success,
          coalesce(duration_sec, 0.0E0) AS sandbox_execution_time, CAST(length(completion) AS INTEGER) AS token_count,
          CASE WHEN NOT success THEN concat('Sandbox failed: ', {MESSAGE}) END AS error_message,
          code AS extracted_code
        FROM scored""",
    ),
    "marker_scripts": with_views(
        SCORED_VIEWS,
        f"""+{SCORED} SELECT sample_id,
          CASE WHEN length(code) > 0 THEN md5(concat(code, chr(10), test, chr(10), '{{0}}')) END AS script_md5
        FROM scored""",
    ),
}
