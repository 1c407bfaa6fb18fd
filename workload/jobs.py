"""The end-to-end jobs over the given tables: extract, script, run, score, report.

The runner really runs the scripts, which these views make up themselves.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F

from codegauge import storage
from codegauge.operators import execute, prepare, triage
from codegauge.plans import evaluation as plans
from codegauge.sources import results, support, tables
from workload.preparation import _benchmark_a, _benchmark_b
from workload.views import table, view, with_views


def python_runner(script: str, limits: dict) -> dict:
    """Runs a script in a name space of its own."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        exec(compile(script, "script", "exec"), {"__name__": "__main__"})
    return {"stdout": out.getvalue()}


def _run(rows, key):
    return execute.execute_scripts(rows, key, "script", python_runner, "docker")


def reward_job(spark, sf_dir):
    """Completions to rewards: the tests ask which names the code defines."""
    even = F.when(F.col("item_id") % 2 == 0, "True").otherwise("False")
    tests = F.concat(F.lit("import json\nprint(json.dumps([n in globals() for n in ['f', 'g', 'h', 'A']] + ["), even, F.lit("]))"))
    tasks = view(spark, sf_dir, "fx_tasks").select("task_id", tests.alias("tests"))
    completions = view(spark, sf_dir, "fx_completions")
    rewarded = plans.reward_completions(tasks, completions, _run)
    return rewarded.select("sample_id", "correct_format", F.round("reward", 9).alias("reward"))


def evaluate_resume_job(spark, sf_dir):
    """An interrupted run goes on: stored answers stay, the rest is generated and scored."""
    path = storage.new_path(spark, "results")
    third = F.when(F.col("item_id") % 3 == 0, "True").otherwise("False")
    test = F.concat(F.lit("import json\n{solution}\nprint(json.dumps(["), "entry_point", F.lit("(1) == 1, "), third, F.lit("]))"))
    all_tasks = view(spark, sf_dir, "fx_tasks").select(
        "task_id", "item_id", F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("prompt"), test.alias("test"), "code"
    )
    done = {
        "model_id": F.lit("m"), "model_name": F.lit("org/m"), "run_ts": F.lit("2024-01-01T00-00-00Z"), "completion": F.lit("old"),
        "dataset_name": F.lit("human_eval"), "task_id": F.col("task_id"), "token_count": F.lit(7), "passed": F.lit(True), "pass_rate": F.lit(1.0),
    }
    stored = all_tasks.where("item_id % 4 = 0").select(*[done.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in results.STORED_RESULT.fields])
    results.append_results(stored, path)

    def generate(todo):
        answer = F.concat(F.lit("```python\n"), "code", F.lit("\n```"))
        return todo.select("task_id", answer.alias("completion"), (F.col("item_id") + 1).cast("int").alias("token_count"), F.lit(0.5).alias("generation_time"), F.lit(2.0).alias("throughput"))

    sets = {"human_eval": all_tasks.where("item_id % 2 = 0"), "mbpp": all_tasks.where("item_id % 2 = 1")}
    _, run = plans.evaluate(spark, sets, path, generate, _run, "org/m", "m")
    return run.select("dataset_name", "task_id", "run_ts", "token_count", "passed", "pass_rate", (F.col("completion") == "old").alias("is_old"))


def verify_benchmark_job(spark, sf_dir):
    """Canonical solutions against long and short tests; every second long test fails."""
    raw = _benchmark_b(spark, sf_dir)
    loop = F.concat(
        F.lit('def assertion(out, exp, atol):\n    assert out == exp, f"out: {out}, exp: {exp}"\n\ninputs = [[1], [2]]\nresults = [1, '),
        (F.col("task_id").cast("int") % 2 + 1).cast("string"),
        F.lit("]\nfor i, (inp, exp) in enumerate(zip(inputs, results)):\n    assertion(fn_"), "task_id", F.lit("(*inp), exp, 0)"),
    )
    prepared = prepare.prepare_benchmark_b(raw.withColumns({"test": loop, "test_list": F.slice("test_list", 1, 2)}), [])
    return plans.verify_benchmark(prepared, _run)[0]


def verify_training_job(spark, sf_dir):
    """Self-check of one training row per document: pass, fail, or no result."""
    kind = F.col("doc_id") % 3
    raw = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq_id"), F.col("text").alias("instruction"), F.col("lang").alias("output"),
        F.concat(F.lit("def fn(x):\n    return x\n# "), F.col("doc_id").cast("string")).alias("code"),
        F.lit("fn").alias("entry_point"),
        F.array(F.lit("assert fn(1) == 1"), F.when(kind == 0, F.lit("assert fn(2) == 2")).when(kind == 1, F.lit("assert fn(2) == 3")).otherwise(F.lit("assert gn(2) == 2"))).alias("testcase"),
    )
    return plans.verify_training(prepare.prepare_training(raw), _run)[0]


def _loaded(spark, raw, load):
    path = storage.new_path(spark, "raw")
    tables.export_table(raw, path)
    prepared = load(spark, path, storage.new_path(spark, "prepared"))
    return prepared.select("task_id", "entry_point", "canonical_solution")


def benchmark_a_load(spark, sf_dir):
    return _loaded(spark, _benchmark_a(spark, sf_dir), tables.load_benchmark_a)


def benchmark_b_load(spark, sf_dir):
    return _loaded(spark, _benchmark_b(spark, sf_dir), tables.load_benchmark_b)


def module_map_read(spark, sf_dir):
    """Packages of all scripts by a module map of one JSON object per thousand modules."""
    entry = F.struct(F.concat(F.lit("mod_"), F.col("p_partkey").cast("string")), "p_name")
    pairs = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 1000)).agg(F.map_from_entries(F.collect_list(entry)).alias("mapping"))
    path = storage.new_path(spark, "module-map")
    objects = pairs.select(F.to_json(F.struct(F.struct(F.lit(1).alias("version")).alias("_metadata"), "mapping")).alias("value"))
    objects.write.option("maxRecordsPerFile", 1).text(path)
    found = triage.triage(view(spark, sf_dir, "fx_importing_scripts"), "script").select("script_id", "modules")
    resolved = triage.resolve_dependencies(found, "script_id", support.read_module_map(spark, path))
    return resolved.select("script_id", F.array_join("dependencies", ",").alias("dependencies"))


QUERIES = {
    f.__name__: f
    for f in (reward_job, evaluate_resume_job, verify_benchmark_job, verify_training_job, benchmark_a_load, benchmark_b_load, module_map_read)
}

ORACLES = {
    "reward_job": with_views(
        ["fx_tasks"],
        """SELECT conv_id * 100 + turn AS sample_id, (conv_id + turn) % 8 IN (0, 1, 5, 6) AS correct_format,
          round(CASE WHEN (conv_id + turn) % 8 IN (4, 7) THEN 0.0E0
            ELSE ((CASE WHEN (conv_id + turn) % 8 IN (0, 1, 3, 6) THEN 1 ELSE 0 END) + (CASE WHEN item_id % 2 = 0 THEN 1 ELSE 0 END)) / 5.0E0 END, 9) AS reward
        FROM conversations c JOIN fx_tasks t ON t.task_id = CAST(conv_id % 40 AS string)""",
    ),
    "evaluate_resume_job": with_views(
        ["fx_tasks"],
        """SELECT CASE WHEN item_id % 2 = 0 THEN 'human_eval' ELSE 'mbpp' END AS dataset_name, task_id, '2024-01-01T00-00-00Z' AS run_ts,
          CAST(CASE WHEN item_id % 4 = 0 THEN 7 ELSE item_id + 1 END AS INTEGER) AS token_count,
          item_id % 4 = 0 OR item_id % 3 = 0 AS passed, CASE WHEN item_id % 4 = 0 OR item_id % 3 = 0 THEN 1.0E0 ELSE 0.5E0 END AS pass_rate,
          item_id % 4 = 0 AS is_old FROM fx_tasks""",
    ),
    "verify_benchmark_job": with_views(
        ["fx_tasks"],
        """+ runs AS (
          SELECT 'long' AS kind, 2 AS tests, 1 + item_id % 2 AS good FROM fx_tasks UNION ALL SELECT 'short', 2, 2 FROM fx_tasks)
        SELECT kind, count(*) AS n_tasks, count(*) FILTER (WHERE good = tests) AS n_tasks_passed,
          count(*) FILTER (WHERE good = tests) / count(*) AS task_pass_rate, CAST(sum(tests) AS BIGINT) AS n_tests,
          CAST(sum(good) AS BIGINT) AS n_tests_passed, sum(good) / sum(tests) AS test_pass_rate FROM runs GROUP BY kind""",
    ),
    "verify_training_job": """
        SELECT count(*) FILTER (WHERE doc_id % 3 = 0) / count(*) FILTER (WHERE doc_id % 3 < 2) AS overall_pass_rate,
          (2.0E0 * count(*) FILTER (WHERE doc_id % 3 = 0) + count(*) FILTER (WHERE doc_id % 3 = 1)) / (2 * count(*) FILTER (WHERE doc_id % 3 < 2)) AS test_level_pass_rate,
          count(*) FILTER (WHERE doc_id % 3 < 2) AS n_kept, 0 AS fast_count, count(*) AS container_count,
          count(*) FILTER (WHERE doc_id % 3 = 2) AS skipped_count FROM documents""",
    "benchmark_a_load": with_views(
        ["fx_tasks"],
        "SELECT concat('HumanEval/', task_id) AS task_id, entry_point, concat('    return ', task_id) AS canonical_solution FROM fx_tasks WHERE item_id <> 32",
    ),
    "benchmark_b_load": with_views(
        ["fx_tasks"], "SELECT task_id, entry_point, code AS canonical_solution FROM fx_tasks WHERE task_id NOT IN ('255', '596')",
    ),
    "module_map_read": with_views(
        ["fx_importing_scripts"],
        """+ needed AS (
          SELECT script_id, unnest([regexp_extract(script, 'import (mod_[0-9]+)', 1), regexp_extract(script, 'mod_[0-9]+, (.*)\\.sub', 1)]) AS module
          FROM fx_importing_scripts),
        map AS (SELECT concat('mod_', CAST(p_partkey AS string)) AS module, p_name AS package FROM part)
        SELECT script_id, string_agg(DISTINCT coalesce(package, n.module), ',' ORDER BY coalesce(package, n.module)) AS dependencies
        FROM needed n LEFT JOIN map m ON m.module = n.module GROUP BY script_id""",
    ),
}
