"""Checkpoints, metrics, verification and telemetry."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge.functions import execution as X
from codegauge.operators import checkpoints, execute, metrics
from workload.outcomes import MESSAGE, _executions
from workload.sqltext import PARSED
from workload.views import view, with_views


# Model 0 answered everything, model 1 one data set, model 2 a third of the tasks.
ANSWERED = """CASE WHEN model_id = 'model_0' OR (model_id = 'model_1' AND dataset_name = 'human_eval')
  OR CAST(task_id AS int) % 3 = 0 THEN token_count ELSE 0 END"""


def _results(spark, sf_dir):
    return view(spark, sf_dir, "fx_task_results")


def _known(results):
    """Data sets every model should have, one of them without results."""
    per_model = results.select("model_id").distinct()
    return per_model.withColumn(
        "dataset_name", F.explode(F.array(F.lit("human_eval"), F.lit("mbpp"), F.lit("unseen")))
    )


def _rounded(df, *columns):
    """Sums of doubles depend on their order in the last digits."""
    return df.withColumns({c: F.round(c, 9) for c in columns})


def dataset_metrics(spark, sf_dir):
    results = _results(spark, sf_dir)
    return _rounded(metrics.dataset_metrics(results, _known(results)), "avg_sandbox_execution_time")


def dataset_metrics_latest(spark, sf_dir):
    latest = metrics.dataset_metrics(_results(spark, sf_dir), dedupe="latest")
    return _rounded(latest, "avg_sandbox_execution_time")


def _task_table(spark, sf_dir):
    """Two data sets with the benchmark's tasks."""
    names = F.explode(F.array(F.lit("human_eval"), F.lit("mbpp")))
    return view(spark, sf_dir, "fx_tasks").select(names.alias("dataset_name"), "task_id")


def _partly_answered(spark, sf_dir):
    return _results(spark, sf_dir).withColumn("token_count", F.expr(ANSWERED))


def pending_tasks(spark, sf_dir):
    return checkpoints.pending(
        _task_table(spark, sf_dir), _partly_answered(spark, sf_dir).where("model_id = 'model_1'")
    )


def _status(spark, sf_dir):
    """One model never started one data set; some tasks are listed twice."""
    tasks = _task_table(spark, sf_dir)
    tasks = tasks.union(tasks.where("CAST(task_id AS int) % 3 = 0"))
    results = _partly_answered(spark, sf_dir).where("model_id <> 'model_2' OR dataset_name <> 'mbpp'")
    return checkpoints.run_status(tasks, results)


def run_status(spark, sf_dir):
    return _status(spark, sf_dir)


def datasets_to_run(spark, sf_dir):
    return checkpoints.datasets_to_evaluate(_status(spark, sf_dir))


def latest_run(spark, sf_dir):
    """Result rows of each model's newest daily run."""
    results = _results(spark, sf_dir).withColumn("run_ts", F.date_format("result_ts", "yyyy-MM-dd"))
    newest = checkpoints.latest_run(results, ["result_id"])
    return newest.select("result_id", "model_id", "run_ts", "task_id", "token_count")


def engine_telemetry(spark, sf_dir):
    telemetry = metrics.execution_telemetry(_executions(spark, sf_dir))
    return _rounded(telemetry, "mean_sec", "median_sec", "runs_per_sec")


def fallback_merge(spark, sf_dir):
    """Failed fast runs replaced by a container run with the same output."""
    first = _executions(spark, sf_dir).select(
        "exec_id", "sandbox_type", "exit_code", "is_valid_python", "errors",
        "timed_out", "memory_limit_hit", "duration_sec",
    )
    retry = first.where(execute.is_fallback_candidate()).withColumns({
        "sandbox_type": F.lit("docker"),
        "exit_code": (F.col("exec_id") % 2).cast("int"),
        "duration_sec": F.col("duration_sec") * 2000,
    })
    merged = execute.merge_fallback(first, retry, "exec_id")
    return merged.select("exec_id", "sandbox_type", "exit_code", "duration_sec")


def fallback_candidates(spark, sf_dir):
    rows = _executions(spark, sf_dir).where(execute.is_fallback_candidate())
    return rows.select("exec_id", "exit_code")


def verify_summary(spark, sf_dir):
    """Long and short tests of the same tasks, at task and test level."""
    runs = view(spark, sf_dir, "fx_executions").select("exec_id", "stdout")
    shifted = runs.select(F.col("exec_id"), F.when(F.col("exec_id") % 3 == 0, F.lit("[true]")).otherwise(F.col("stdout")).alias("stdout"))
    return metrics.verify_summary(metrics.verify_per_task(runs, shifted, "exec_id"))


def benchmark_pass_rate(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_executions")
    return metrics.overall_pass_rate(runs, ["sandbox_type"])


def training_verification(spark, sf_dir):
    return metrics.training_verification(_executions(spark, sf_dir))


def skipped_examples(spark, sf_dir):
    return metrics.skipped_examples(_executions(spark, sf_dir), "exec_id", "stdout")


def kept_examples(spark, sf_dir):
    kept = metrics.kept_examples(_executions(spark, sf_dir), "exec_id")
    return kept.select("exec_id", "sandbox_type", F.size("test_results").alias("n_tests"))


def throughput(spark, sf_dir):
    rows = metrics.row_throughput(view(spark, sf_dir, "fx_generations"))
    return rows.select("sample_id", "token_count", "throughput")


def batch_throughput(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_generations").withColumn("generation_time", F.col("batch_time"))
    return metrics.batch_throughput(rows, "batch_id", "sample_id").select(
        "sample_id", "batch_id", "throughput"
    )


def request_summary(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_task_results")
    start = F.col("result_ts").cast("timestamp")
    requests = rows.select(
        "model_id",
        start.alias("start_time"),
        F.timestamp_micros(F.unix_micros(start) + 1_500_000).alias("end_time"),
        F.coalesce("token_count", F.lit(0)).alias("token_count"),
    )
    return metrics.request_summary(requests, ["model_id"])


def model_change(spark, sf_dir):
    per_model = metrics.dataset_metrics(_results(spark, sf_dir))
    return metrics.model_change(per_model, "model_0", "model_2")


def _steps(spark, sf_dir):
    return _results(spark, sf_dir).withColumn("step", F.col("result_id") % 50)


def periodic_pivot(spark, sf_dir):
    return metrics.periodic_metrics(_steps(spark, sf_dir), 7, ["human_eval", "mbpp"])


def periodic_map(spark, sf_dir):
    rows = metrics.periodic_metric_map(_steps(spark, sf_dir), 7)
    return rows.select("step", F.explode("metrics").alias("name", "pass_rate"))


def all_tasks_union(spark, sf_dir):
    """Task lists and results of both data sets as one bag, counted per source."""
    tasks = _task_table(spark, sf_dir).select("dataset_name", "task_id", F.lit("task").alias("source"))
    results = _results(spark, sf_dir).select("dataset_name", "task_id", F.lit("result").alias("source"))
    return (
        tasks.unionByName(results)
        .groupBy("source", "dataset_name")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("task_id").alias("n_tasks"))
    )


def run_names(spark, sf_dir):
    rows = _results(spark, sf_dir)
    return rows.select("result_id", X.run_name(F.col("model_id"), F.col("result_ts")).alias("run_name"))


QUERIES = {
    f.__name__: f
    for f in (
        dataset_metrics, dataset_metrics_latest, pending_tasks, run_status, datasets_to_run,
        latest_run, engine_telemetry, fallback_merge, fallback_candidates, verify_summary,
        benchmark_pass_rate, training_verification, skipped_examples, kept_examples, throughput,
        batch_throughput, request_summary, model_change, periodic_pivot, periodic_map,
        all_tasks_union, run_names,
    )
}

METRICS = """
  sum(CASE WHEN passed THEN 1 ELSE 0 END) / count(*) AS pass_rate,
  sum(CASE WHEN correct_format THEN 1 ELSE 0 END) / count(*) AS format_success_rate,
  sum(CASE WHEN extraction_success THEN 1 ELSE 0 END) / count(*) AS extraction_success_rate,
  round(avg(sandbox_execution_time), 9) AS avg_sandbox_execution_time,
  CAST(sum(token_count) AS BIGINT) AS total_tokens,
  avg(token_count) AS avg_tokens,
  count(*) AS completed_tasks"""

TASK_TABLE = """
task_table AS (
  SELECT d.dataset_name, t.task_id FROM fx_tasks t,
    (SELECT 'human_eval' AS dataset_name UNION ALL SELECT 'mbpp') d
)"""

STATUS = f"""
{TASK_TABLE.strip()}, per_task AS (
  SELECT model_id, dataset_name, task_id, max(CASE WHEN {ANSWERED} > 0 THEN 1 ELSE 0 END) = 1 AS answered
  FROM fx_task_results WHERE NOT (model_id = 'model_2' AND dataset_name = 'mbpp')
  GROUP BY model_id, dataset_name, task_id
), status AS (
  SELECT m.model_id, d.dataset_name,
    (SELECT count(*) FROM per_task p WHERE p.model_id = m.model_id AND p.dataset_name = d.dataset_name AND answered) AS n_completed,
    (SELECT count(*) FROM per_task p WHERE p.model_id = m.model_id AND p.dataset_name = d.dataset_name AND NOT answered) AS n_incomplete,
    (SELECT count(*) FROM task_table t WHERE t.dataset_name = d.dataset_name AND NOT EXISTS (
      SELECT 1 FROM per_task p WHERE p.model_id = m.model_id AND p.dataset_name = t.dataset_name AND p.task_id = t.task_id AND p.answered)) AS n_pending
  FROM (SELECT DISTINCT model_id FROM per_task) m, (SELECT DISTINCT dataset_name FROM task_table) d
)"""

VERIFIED = f"""
{PARSED.strip()}, long_short AS (
  SELECT 'long' AS kind, n_results, n_true FROM verdict
  UNION ALL
  SELECT 'short', CASE WHEN exec_id % 3 = 0 THEN 1 ELSE n_results END,
    CASE WHEN exec_id % 3 = 0 THEN 1 ELSE n_true END FROM verdict
), counted AS (
  SELECT kind, CASE WHEN n_results > 0 THEN n_results ELSE 1 END AS tests,
    CASE WHEN n_results > 0 THEN n_true ELSE 0 END AS trues FROM long_short
)"""

SKIPS = f"""
{PARSED.strip()}, reasons AS (
  SELECT *, CASE WHEN exit_code <> 0 OR NOT is_valid_python THEN {MESSAGE}
    WHEN kind = 'invalid' THEN 'Output parsing error: not valid JSON'
    WHEN kind <> 'list' THEN 'Output parsing error: not a list' END AS skip_reason
  FROM verdict
)"""

CANDIDATE = "sandbox_type = 'monty' AND exit_code <> 0 AND is_valid_python"
STEPS = """steps AS (
  SELECT *, result_id % 50 AS step FROM fx_task_results
  WHERE token_count > 0 AND result_id % 50 > 0 AND (result_id % 50) % 7 = 0
)"""

ORACLES = {
    "dataset_metrics": with_views(
        ["fx_task_results"],
        f"""+ found AS (SELECT model_id, dataset_name, {METRICS} FROM fx_task_results WHERE token_count > 0
          GROUP BY model_id, dataset_name),
        known AS (SELECT * FROM (SELECT DISTINCT model_id FROM fx_task_results),
          (SELECT 'human_eval' AS dataset_name UNION ALL SELECT 'mbpp' UNION ALL SELECT 'unseen'))
        SELECT k.model_id, k.dataset_name, coalesce(pass_rate, 0) AS pass_rate,
          coalesce(format_success_rate, 0) AS format_success_rate,
          coalesce(extraction_success_rate, 0) AS extraction_success_rate,
          coalesce(avg_sandbox_execution_time, 0) AS avg_sandbox_execution_time,
          coalesce(total_tokens, 0) AS total_tokens, coalesce(avg_tokens, 0) AS avg_tokens,
          coalesce(completed_tasks, 0) AS completed_tasks
        FROM known k LEFT JOIN found f ON f.model_id = k.model_id AND f.dataset_name = k.dataset_name""",
    ),
    "dataset_metrics_latest": with_views(
        ["fx_task_results"],
        f"""+ ranked AS (
          SELECT *, row_number() OVER (PARTITION BY model_id, dataset_name, task_id
            ORDER BY result_ts DESC, result_id DESC) AS place
          FROM fx_task_results WHERE token_count > 0)
        SELECT model_id, dataset_name, {METRICS} FROM ranked WHERE place = 1 GROUP BY model_id, dataset_name""",
    ),
    "pending_tasks": with_views(
        ["fx_task_results", "fx_tasks"],
        f"""+ {TASK_TABLE}
        SELECT dataset_name, task_id FROM task_table t WHERE NOT EXISTS (
          SELECT 1 FROM (SELECT *, {ANSWERED} AS answer_tokens FROM fx_task_results) r
          WHERE r.dataset_name = t.dataset_name AND r.task_id = t.task_id
            AND r.answer_tokens > 0 AND r.model_id = 'model_1')""",
    ),
    "run_status": with_views(
        ["fx_task_results", "fx_tasks"],
        f"+ {STATUS} SELECT *, n_pending = 0 AS is_complete FROM status",
    ),
    "datasets_to_run": with_views(
        ["fx_task_results", "fx_tasks"],
        f"""+ {STATUS}, flags AS (
          SELECT model_id, dataset_name, n_pending, max(n_pending) OVER (PARTITION BY model_id) = 0 AS starts_new_run
          FROM status)
        SELECT model_id, dataset_name, starts_new_run FROM flags WHERE starts_new_run OR n_pending > 0""",
    ),
    "latest_run": with_views(
        ["fx_task_results"],
        """+ runs AS (SELECT *, strftime(result_ts, '%Y-%m-%d') AS run_ts FROM fx_task_results)
        SELECT result_id, model_id, run_ts, task_id, token_count FROM runs
        WHERE (model_id, run_ts) IN (SELECT model_id, max(run_ts) FROM runs GROUP BY model_id)""",
    ),
    "engine_telemetry": with_views(
        ["fx_executions"],
        """SELECT sandbox_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share,
          round(avg(duration_sec), 9) AS mean_sec, round(median(duration_sec), 9) AS median_sec,
          sum(CASE WHEN exit_code = 0 AND is_valid_python THEN 1 ELSE 0 END) / count(*) AS success_rate,
          round(count(*) / sum(duration_sec), 9) AS runs_per_sec
        FROM fx_executions GROUP BY sandbox_type""",
    ),
    "fallback_merge": with_views(
        ["fx_executions"],
        f"""SELECT exec_id, CASE WHEN {CANDIDATE} THEN 'docker' ELSE sandbox_type END AS sandbox_type,
          CASE WHEN {CANDIDATE} THEN CAST(exec_id % 2 AS INTEGER) ELSE exit_code END AS exit_code,
          CASE WHEN {CANDIDATE} THEN duration_sec * 2000 ELSE duration_sec END AS duration_sec
        FROM fx_executions""",
    ),
    "fallback_candidates": with_views(
        ["fx_executions"], f"SELECT exec_id, exit_code FROM fx_executions WHERE {CANDIDATE}"
    ),
    "verify_summary": with_views(
        ["fx_executions"],
        f"""+ {VERIFIED}
        SELECT kind, count(*) AS n_tasks, count(*) FILTER (WHERE trues = tests) AS n_tasks_passed,
          count(*) FILTER (WHERE trues = tests) / count(*) AS task_pass_rate,
          CAST(sum(tests) AS BIGINT) AS n_tests, CAST(sum(trues) AS BIGINT) AS n_tests_passed,
          sum(trues) / sum(tests) AS test_pass_rate
        FROM counted GROUP BY kind""",
    ),
    "benchmark_pass_rate": with_views(
        ["fx_executions"],
        f"""+ {PARSED}
        SELECT sandbox_type, count(*) FILTER (WHERE kind = 'object' AND obj_passed) AS n_passed, count(*) AS n_tasks,
          count(*) FILTER (WHERE kind = 'object' AND obj_passed) / count(*) AS pass_rate
        FROM parsed GROUP BY sandbox_type""",
    ),
    "training_verification": with_views(
        ["fx_executions"],
        f"""+ {SKIPS}
        SELECT count(*) FILTER (WHERE skip_reason IS NULL AND n_true = n_results)
            / count(*) FILTER (WHERE skip_reason IS NULL) AS overall_pass_rate,
          sum(n_true) FILTER (WHERE skip_reason IS NULL) / sum(n_results) FILTER (WHERE skip_reason IS NULL) AS test_level_pass_rate,
          count(*) FILTER (WHERE skip_reason IS NULL) AS n_kept,
          count(*) FILTER (WHERE sandbox_type = 'monty') AS fast_count,
          count(*) FILTER (WHERE sandbox_type = 'docker') AS container_count,
          count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped_count
        FROM reasons""",
    ),
    "skipped_examples": with_views(
        ["fx_executions"],
        f"""+ {SKIPS} SELECT exec_id, skip_reason AS errors, sandbox_type, stdout AS code
        FROM reasons WHERE skip_reason IS NOT NULL""",
    ),
    "kept_examples": with_views(
        ["fx_executions"],
        f"""+ {SKIPS} SELECT exec_id, sandbox_type, CAST(n_results AS INTEGER) AS n_tests
        FROM reasons WHERE skip_reason IS NULL""",
    ),
    "throughput": with_views(
        ["fx_generations"],
        """SELECT sample_id, token_count,
          CASE WHEN generation_time > 0 THEN token_count / generation_time ELSE 0.0E0 END AS throughput
        FROM fx_generations""",
    ),
    "batch_throughput": with_views(
        ["fx_generations"],
        """SELECT sample_id, batch_id, CASE WHEN max(batch_time) OVER (PARTITION BY batch_id) > 0
          THEN sum(token_count) OVER (PARTITION BY batch_id) / max(batch_time) OVER (PARTITION BY batch_id)
          ELSE 0.0E0 END AS throughput FROM fx_generations""",
    ),
    "request_summary": with_views(
        ["fx_task_results"],
        """+ spans AS (SELECT model_id, count(*) AS n_requests, CAST(sum(coalesce(token_count, 0)) AS BIGINT) AS total_tokens,
          (epoch_us(max(result_ts)) + 1500000 - epoch_us(min(result_ts))) / 1.0E6 AS total_sec
          FROM fx_task_results GROUP BY model_id)
        SELECT *, total_sec / n_requests AS avg_sec, total_tokens / total_sec AS tokens_per_sec FROM spans""",
    ),
    "model_change": with_views(
        ["fx_task_results"],
        """+ rates AS (SELECT dataset_name,
            count(*) FILTER (WHERE passed AND model_id = 'model_0') / count(*) FILTER (WHERE model_id = 'model_0') AS base,
            count(*) FILTER (WHERE passed AND model_id = 'model_2') / count(*) FILTER (WHERE model_id = 'model_2') AS tuned
          FROM fx_task_results WHERE token_count > 0 GROUP BY dataset_name)
        SELECT dataset_name, base, tuned, (tuned - base) / base AS change FROM rates""",
    ),
    "periodic_pivot": with_views(
        ["fx_task_results"],
        f"""+ {STEPS}
        SELECT step,
          count(*) FILTER (WHERE passed AND dataset_name = 'human_eval') / nullif(count(*) FILTER (WHERE dataset_name = 'human_eval'), 0) AS "eval/human_eval_pass_rate",
          count(*) FILTER (WHERE passed AND dataset_name = 'mbpp') / nullif(count(*) FILTER (WHERE dataset_name = 'mbpp'), 0) AS "eval/mbpp_pass_rate"
        FROM steps GROUP BY step""",
    ),
    "periodic_map": with_views(
        ["fx_task_results"],
        f"""+ {STEPS}
        SELECT step, concat('eval/', dataset_name, '_pass_rate') AS name,
          count(*) FILTER (WHERE passed) / count(*) AS pass_rate
        FROM steps GROUP BY step, dataset_name""",
    ),
    "all_tasks_union": with_views(
        ["fx_task_results", "fx_tasks"],
        f"""+ {TASK_TABLE}, bag AS (
          SELECT 'task' AS source, dataset_name, task_id FROM task_table
          UNION ALL SELECT 'result', dataset_name, task_id FROM fx_task_results)
        SELECT source, dataset_name, count(*) AS n_rows, count(DISTINCT task_id) AS n_tasks
        FROM bag GROUP BY source, dataset_name""",
    ),
    "run_names": with_views(
        ["fx_task_results"],
        """SELECT result_id, concat(model_id, '_', strftime(result_ts, '%Y-%m-%dT%H-%M-%SZ')) AS run_name
        FROM fx_task_results""",
    ),
}
