"""Views over the given tables that stand in for evaluation data.

The given tables hold no code, so completions, executions, results, tasks and
scripts are derived from them.  Each statement runs unchanged on Spark and in the
checking database; ``with_views`` inlines them there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FENCE = "repeat(chr(96), 3)"

COMPLETIONS = f"""
SELECT conv_id * 100 + turn AS sample_id, CAST(conv_id % 40 AS string) AS task_id,
  conv_id AS prompt_id, turn AS sample_idx,
  CASE (conv_id + turn) % 8
    WHEN 0 THEN concat('Sure.', chr(10), {FENCE}, 'python', chr(10), 'def f(x):', chr(10), '    return x + ', CAST(turn AS string), chr(10), {FENCE}, chr(10), text)
    WHEN 1 THEN concat({FENCE}, 'python', chr(10), 'def g(x):', chr(10), '    return x', chr(10), {FENCE}, chr(10), 'Use:', chr(10), {FENCE}, 'python', chr(10), 'g(', CAST(turn AS string), ')', chr(10), {FENCE})
    WHEN 2 THEN concat(text, chr(10), {FENCE}, chr(10), 'print(', CAST(turn AS string), ')', chr(10), {FENCE})
    WHEN 3 THEN concat('Reasoning ', {FENCE}, 'python', chr(10), 'def h(x):', chr(10), '    return ', CAST(conv_id AS string))
    WHEN 4 THEN text
    WHEN 5 THEN concat({FENCE}, 'python', chr(10), {FENCE})
    WHEN 6 THEN concat({FENCE}, 'python', chr(10), 'x = 1', chr(10), {FENCE}, chr(10), {FENCE}, 'python', chr(10), 'class A: pass', chr(10), {FENCE})
    ELSE concat({FENCE}, 'Python', chr(10), 'y = ', CAST(turn AS string), chr(10), {FENCE})
  END AS completion
FROM conversations"""

EXECUTIONS = """
SELECT event_id AS exec_id, user_id AS prompt_id,
  CASE WHEN event_id % 4 = 0 THEN 'docker' ELSE 'monty' END AS sandbox_type,
  ts AS start_time, value / 1000.0E0 AS duration_sec,
  CASE WHEN event_type = 'error' THEN 1
       WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 124
       WHEN event_type = 'signup' THEN 137 ELSE 0 END AS exit_code,
  event_id % 11 <> 0 AS is_valid_python,
  CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS int) % 10
    WHEN 0 THEN ''
    WHEN 1 THEN 'oops'
    WHEN 2 THEN '[]'
    WHEN 3 THEN '[true, true]'
    WHEN 4 THEN '[true, false, true]'
    WHEN 5 THEN concat('log line', chr(10), '[true]')
    WHEN 6 THEN '{"passed": true}'
    WHEN 7 THEN '{"passed": false}'
    WHEN 8 THEN '42'
    ELSE concat('[false]', chr(10)) END AS stdout
FROM events"""

TASK_RESULTS = """
SELECT event_id AS result_id, ts AS result_ts,
  concat('model_', CAST(user_id % 3 AS string)) AS model_id,
  CASE WHEN event_id % 2 = 0 THEN 'human_eval' ELSE 'mbpp' END AS dataset_name,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS int) AS string) AS task_id,
  CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 97 = 0 THEN NULL ELSE CAST(floor(value) AS int) + 1 END AS token_count,
  event_id % 3 = 0 AS passed,
  event_id % 5 <> 0 AS correct_format,
  event_id % 7 <> 0 AS extraction_success,
  value / 1000.0E0 AS sandbox_execution_time
FROM events"""

TASKS = """
SELECT CAST(item_id AS string) AS task_id, item_id, text AS prompt,
  concat('fn_', CAST(item_id AS string)) AS entry_point,
  concat('def assertion(out, exp, atol):', chr(10), '    assert out == exp, f"out: {out}, exp: {exp}"', chr(10), chr(10),
    'for i, (inp, exp) in enumerate(zip(inputs, results)):', chr(10), '    assertion(fn_', CAST(item_id AS string), '(*inp), exp, 0)') AS test,
  concat('def fn_', CAST(item_id AS string), '(x):', chr(10), '    return x') AS code
FROM benchmark"""

# A text of any length follows each script as one comment line.
AS_COMMENT = "concat('# ', replace(replace(text, chr(10), ' '), chr(13), ' '))"

# name: (script lines, modules in sorted order, features, reason)
SCRIPT_FORMS = [
    (["import json, math", "print(1)"], "json,math", "", None),
    (["import numpy as np", "print(np.zeros(3))"], "numpy", "", "Unsupported module(s): numpy"),
    (["import os.path", "from pathlib import Path"], "os,pathlib", "", None),
    (["from . import sibling", "x = 1"], "", "", None),
    (["class A:", "    pass"], "", "Class", "Unsupported feature: Class declaration"),
    (["match 1:", "    case 1:", "        pass"], "", "Match", "Unsupported feature: Match declaration"),
    (["x = 1", "del x"], "", "Delete", "Unsupported feature: Delete declaration"),
    (["def f(:", "    pass"], "", "error", None),
    (["import yaml, requests", "class B: pass"], "requests,yaml", "Class", "Unsupported module(s): requests, yaml"),
    (["class C:", "    import sklearn"], "sklearn", "Class", "Unsupported feature: Class declaration"),
    (["async def g():", "    await h()"], "", "", None),
    (["from sklearn.linear_model import X", "import PIL.Image"], "PIL,sklearn", "", "Unsupported module(s): sklearn"),
]


def _script_case() -> str:
    branches = []
    for i, (lines, *_rest) in enumerate(SCRIPT_FORMS):
        text = ", chr(10), ".join(f"'{line}'" for line in lines)
        branches.append(f"WHEN {i} THEN concat({text})")
    return f"CASE doc_id % {len(SCRIPT_FORMS)} " + " ".join(branches) + " END"


SCRIPTS = f"""
SELECT doc_id AS script_id, concat({_script_case()}, chr(10), {AS_COMMENT}) AS script
FROM documents"""

# Each script imports one numbered package and one named after its source.
IMPORTING_SCRIPTS = f"""
SELECT doc_id AS script_id,
  concat('import json', chr(10), 'import mod_', CAST(doc_id % 60 AS string), ', ', source, '.sub', chr(10), {AS_COMMENT}) AS script
FROM documents"""

MODULE_MAP = """
SELECT CASE WHEN copy < 2 OR p_partkey % 7 > 0 THEN concat('mod_', CAST(p_partkey AS string)) END AS module,
  CASE WHEN copy < 2 OR p_partkey % 5 > 0 THEN concat(replace(p_name, ' ', '-'), repeat('x', 1 - copy)) END AS package
FROM (SELECT *, 0 AS copy FROM part UNION ALL SELECT *, 1 FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT *, 2 FROM part) p"""

# Scripts that print a JSON list; a third of them are copies of one script.
PRINTING_SCRIPTS = """
SELECT event_id AS row_id,
  CASE WHEN event_id % 3 = 0 THEN 'print([True, True])'
       WHEN event_type = 'error' THEN concat('raise ', props)
       WHEN event_type = 'signup' THEN concat('class A: pass', chr(10), 'print([False])')
       ELSE concat('print([True, ', CAST(user_id % 100 AS string), ', 0])') END AS script
FROM events"""

GENERATIONS = """
SELECT event_id AS sample_id, user_id % 40 AS batch_id,
  CASE WHEN event_id % 10 = 0 THEN 0 ELSE CAST(floor(value) AS int) + 1 END AS token_count,
  CASE WHEN event_id % 13 = 0 THEN 0.0E0 ELSE value / 50.0E0 END AS generation_time,
  CAST(user_id % 40 AS double) / 4.0E0 AS batch_time
FROM events"""

VIEWS = {
    "fx_completions": COMPLETIONS,
    "fx_executions": EXECUTIONS,
    "fx_task_results": TASK_RESULTS,
    "fx_tasks": TASKS,
    "fx_scripts": SCRIPTS,
    "fx_importing_scripts": IMPORTING_SCRIPTS,
    "fx_module_map": MODULE_MAP,
    "fx_printing_scripts": PRINTING_SCRIPTS,
    "fx_generations": GENERATIONS,
}
BASE_TABLE = {
    "fx_completions": "conversations",
    "fx_executions": "events",
    "fx_task_results": "events",
    "fx_tasks": "benchmark",
    "fx_scripts": "documents",
    "fx_importing_scripts": "documents",
    "fx_module_map": "part",
    "fx_printing_scripts": "events",
    "fx_generations": "events",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base = BASE_TABLE[name]
    table(spark, sf_dir, base).createOrReplaceTempView(base)
    return spark.sql(VIEWS[name])


def with_views(names: list[str], query: str) -> str:
    """The query with its views inlined.

    A query that starts with ``+`` goes on with further named subqueries.
    """
    ctes = ",\n".join(f"{name} AS ({VIEWS[name].strip()})" for name in names)
    query = query.strip()
    return f"WITH {ctes},\n{query[1:]}" if query.startswith("+") else f"WITH {ctes}\n{query}"
