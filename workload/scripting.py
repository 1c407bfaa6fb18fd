"""Script triage, dependencies and execution."""

from __future__ import annotations

import ast
import json
import signal
import time

from pyspark.sql import functions as F

from codegauge.functions import scripts as S
from codegauge.functions import tables as sql_tables
from codegauge.functions.outcome import task_pass_rate
from codegauge.operators import execute, triage
from codegauge.operators.metrics import with_outcome
from workload.sqltext import PARSED
from workload.views import SCRIPT_FORMS, view, with_views


def import_triage(spark, sf_dir):
    """Engine verdict of every script; the whole text stays in the script."""
    found = triage.triage(view(spark, sf_dir, "fx_scripts"), "script")
    return found.select(
        "script_id", "parse_ok", F.array_join("modules", ",").alias("modules"),
        F.coalesce("has_class", F.lit(False)).alias("has_class"),
        F.coalesce("has_match", F.lit(False)).alias("has_match"),
        F.coalesce("has_del", F.lit(False)).alias("has_del"),
        "is_compatible", "reason",
    )


def dependency_resolve(spark, sf_dir):
    """Packages each script needs, by a module map of any size."""
    found = triage.triage(view(spark, sf_dir, "fx_importing_scripts"), "script")
    resolved = triage.resolve_dependencies(
        found.select("script_id", "modules"), "script_id", view(spark, sf_dir, "fx_module_map")
    )
    return resolved.select("script_id", F.array_join("dependencies", ",").alias("dependencies"))


def script_headers(spark, sf_dir):
    """Dependency header, helper functions and named inputs before a script."""
    df = view(spark, sf_dir, "fx_printing_scripts")
    dependencies = F.when(F.col("row_id") % 2 == 0, F.array(F.lit("numpy"), F.lit("Pillow"))).otherwise(
        F.array().cast("array<string>")
    )
    inputs = F.to_json(F.struct(F.col("row_id").alias("x"), F.array(F.lit('a"b'), F.lit("c")).alias("names")))
    script = S.with_inputs(F.col("script"), inputs, ["x", "names"])
    script = S.container_script(script, dependencies, ["def triple(x):\n    return x * 3\n"])
    return df.select("row_id", F.md5(script).alias("script_md5"))


def async_scan(spark, sf_dir):
    """Scripts that need an event loop; the long comment lines hold no code."""
    df = view(spark, sf_dir, "fx_scripts")
    awaiting = F.when(F.col("script_id") % 5 == 0, F.concat(F.col("script"), F.lit("\n# await x\nx = 'await'"))).when(
        F.col("script_id") % 5 == 1, F.concat(F.col("script"), F.lit("\ny = await f()"))
    ).otherwise(F.col("script"))
    return df.select("script_id", S.requires_async(awaiting).alias("needs_async"))


def print_runner(script: str, limits: dict) -> dict:
    """Stand-in for a real engine: shows a printed literal, runs no code."""
    last = ast.parse(script).body[-1]
    if isinstance(last, ast.Raise):
        raise RuntimeError("raised")
    return {"stdout": json.dumps(ast.literal_eval(last.value.args[0]))}


def fast_print_runner(script: str, limits: dict) -> dict:
    """The same, without classes and without lists of more than two values."""
    tree = ast.parse(script)
    if any(isinstance(n, ast.ClassDef) for n in tree.body):
        raise NotImplementedError("class")
    if "True, True" not in script:
        raise RuntimeError("too long")
    return print_runner(script, limits)


def _summary(executions):
    error = F.when(F.size("errors") > 0, F.col("errors")[0]["error_class"])
    return with_outcome(executions).select(
        "row_id", "sandbox_type", "stdout", "exit_code", error.alias("error_class"),
        task_pass_rate(F.col("outcome")).alias("pass_rate"),
    )


def execute_scripts(spark, sf_dir):
    """All scripts through one runner; a third of the rows share one script."""
    rows = view(spark, sf_dir, "fx_printing_scripts")
    return _summary(execute.execute_scripts(rows, "row_id", "script", print_runner, "docker"))


def input_runner(script: str, limits: dict) -> dict:
    """Shows the script's value and what came with it."""
    given = limits["inputs"]
    shown = [print_runner(script, limits)["stdout"], given["env"]["MODE"], given["names"], given["x"]]
    return {"stdout": json.dumps(shown)}


def execute_with_inputs(spark, sf_dir):
    """Equal scripts with other inputs are other runs."""
    rows = view(spark, sf_dir, "fx_printing_scripts").select(
        "row_id", "script", F.create_map(F.lit("MODE"), (F.col("row_id") % 2).cast("string")).alias("env"),
        F.array(F.lit("a.txt")).alias("names"), (F.col("row_id") % 3).alias("x"),
    )
    runs = execute.execute_scripts(rows, "row_id", "script", input_runner, "docker", input_columns=["env", "names", "x"])
    return runs.select("row_id", "stdout")


def execute_with_fallback(spark, sf_dir):
    """Routed by verdict, failures of the fast engine run again."""
    rows = view(spark, sf_dir, "fx_printing_scripts")
    return _summary(
        execute.execute_with_fallback(rows, "row_id", "script", fast_print_runner, print_runner)
    )


def hungry_runner(script: str, limits: dict) -> dict:
    """Scripts that raise take a gigabyte, those with a class stop listening and wait."""
    if script.startswith("raise"):
        return {"stdout": str(len(bytearray(1 << 30)))}
    if script.startswith("class"):
        signal.pthread_sigmask(signal.SIG_BLOCK, {signal.SIGALRM, signal.SIGTERM, signal.SIGINT})
        time.sleep(3600)
    return print_runner(script, limits)


def execute_isolated(spark, sf_dir):
    """Limits that hold by force; the other scripts of a batch are as before."""
    rows = view(spark, sf_dir, "fx_printing_scripts")
    limits = {"max_duration_sec": 0.5, "max_memory_mb": 256}
    runs = execute.execute_scripts(rows, "row_id", "script", hungry_runner, "docker", limits, isolate=True)
    return _summary(runs).join(runs.select("row_id", "timed_out", "memory_limit_hit"), "row_id").drop("error_class", "pass_rate")


def sql_triage(spark, sf_dir):
    """Verdicts from SQL text, beside the table's own columns."""
    sql_tables.register(spark)
    view(spark, sf_dir, "fx_scripts").createOrReplaceTempView("fx_scripts")
    return spark.sql("""
        SELECT CAST(t.id AS BIGINT) AS script_id, t.parse_ok, array_join(t.modules, ',') AS modules, t.is_compatible, t.reason
        FROM triage_scripts(TABLE (SELECT script_id AS id, script FROM fx_scripts)) t""")


def sql_rewards(spark, sf_dir):
    """Rewards and advantages of each prompt's runs from SQL text."""
    sql_tables.register(spark)
    view(spark, sf_dir, "fx_executions").createOrReplaceTempView("fx_executions")
    return spark.sql("""
        SELECT CAST(prompt_id AS BIGINT) AS prompt_id, CAST(sample_id AS BIGINT) AS sample_id, round(reward, 9) AS reward,
          round(prompt_mean, 9) AS prompt_mean, round(advantage, 9) AS advantage
        FROM prompt_rewards(TABLE (
          SELECT prompt_id, exec_id AS sample_id, stdout, exit_code = 0 AND is_valid_python AS success FROM fx_executions
        ) PARTITION BY prompt_id)""")


QUERIES = {
    f.__name__: f
    for f in (
        import_triage, dependency_resolve, script_headers, async_scan, execute_scripts,
        execute_with_fallback, execute_with_inputs, execute_isolated, sql_triage, sql_rewards,
    )
}


def _forms(column: int) -> str:
    values = []
    for i, form in enumerate(SCRIPT_FORMS):
        value = form[column]
        values.append(f"WHEN {i} THEN " + ("NULL" if value is None else f"'{value}'"))
    return f"CASE script_id % {len(SCRIPT_FORMS)} {' '.join(values)} END"


RUN = """runs AS (
  SELECT row_id, script, starts_with(script, 'raise') AS failed,
    CASE WHEN starts_with(script, 'raise') THEN ''
      ELSE replace(replace(regexp_extract(script, 'print\\((.*)\\)', 1), 'True', 'true'), 'False', 'false') END AS stdout
  FROM fx_printing_scripts
), rated AS (
  SELECT *, CAST(len(regexp_extract_all(stdout, 'true|[1-9][0-9]*')) AS double) AS good,
    length(stdout) - length(replace(stdout, ',', '')) + 1 AS total FROM runs
)"""
RATE = "CASE WHEN NOT failed THEN good / total END AS pass_rate"

ORACLES = {
    "import_triage": with_views(
        ["fx_scripts"],
        f"""+ described AS (
          SELECT *, {_forms(1)} AS form_modules, {_forms(2)} AS features, {_forms(3)} AS form_reason,
            len(list_filter(string_split(script, chr(10)), lambda l: length(l) > 65535)) > 0 AS long_line
          FROM fx_scripts)
        SELECT script_id, features <> 'error' AS parse_ok, form_modules AS modules,
          features = 'Class' AS has_class, features = 'Match' AS has_match, features = 'Delete' AS has_del,
          NOT long_line AND form_reason IS NULL AS is_compatible,
          CASE WHEN long_line THEN 'Code contains lines longer than 65,536 characters' ELSE form_reason END AS reason
        FROM described""",
    ),
    "dependency_resolve": with_views(
        ["fx_importing_scripts", "fx_module_map"],
        """+ needed AS (
          SELECT script_id, unnest([regexp_extract(script, 'import (mod_[0-9]+)', 1), regexp_extract(script, 'mod_[0-9]+, (.*)\\.sub', 1)]) AS module
          FROM fx_importing_scripts)
        SELECT script_id, string_agg(DISTINCT coalesce(package, n.module), ',' ORDER BY coalesce(package, n.module)) AS dependencies
        FROM needed n LEFT JOIN (SELECT module, min(package) AS package FROM fx_module_map GROUP BY module) m ON m.module = n.module
        GROUP BY script_id""",
    ),
    "script_headers": with_views(
        ["fx_printing_scripts"],
        """+ full_scripts AS (
          SELECT row_id, concat('def triple(x):', chr(10), '    return x * 3', chr(10), chr(10), chr(10)) AS helpers, concat('import json', chr(10),
            'x = json.loads("', CAST(row_id AS string), '")', chr(10),
            'names = json.loads("[', chr(92), '"a', chr(92), chr(92), chr(92), '"b', chr(92), '",', chr(92), '"c', chr(92), '"]")', chr(10), script) AS body
          FROM fx_printing_scripts)
        SELECT row_id, md5(CASE WHEN row_id % 2 = 0 THEN concat(helpers, '# /// script', chr(10), '# dependencies = [', chr(10),
          '#   "numpy",', chr(10), '#   "Pillow",', chr(10), '# ]', chr(10), '# ///', chr(10), chr(10), body) ELSE concat(helpers, body) END) AS script_md5
        FROM full_scripts""",
    ),
    "async_scan": with_views(
        ["fx_scripts"],
        f"SELECT script_id, script_id % {len(SCRIPT_FORMS)} = 10 OR script_id % 5 = 1 AS needs_async FROM fx_scripts",
    ),
    "execute_scripts": with_views(
        ["fx_printing_scripts"],
        f"""+ {RUN}
        SELECT row_id, 'docker' AS sandbox_type, stdout, CAST(CASE WHEN failed THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
          CASE WHEN failed THEN 'runtime' END AS error_class, {RATE} FROM rated""",
    ),
    "execute_with_inputs": with_views(
        ["fx_printing_scripts"],
        f"""+ {RUN}
        SELECT row_id, CASE WHEN failed THEN ''
          ELSE concat('["', stdout, '", "', CAST(row_id % 2 AS string), '", ["a.txt"], ', CAST(row_id % 3 AS string), ']') END AS stdout
        FROM rated""",
    ),
    "execute_with_fallback": with_views(
        ["fx_printing_scripts"],
        f"""+ {RUN}
        SELECT row_id, CASE WHEN script = 'print([True, True])' THEN 'monty' ELSE 'docker' END AS sandbox_type, stdout,
          CAST(CASE WHEN failed THEN 1 ELSE 0 END AS INTEGER) AS exit_code,
          CASE WHEN failed THEN 'runtime' END AS error_class, {RATE} FROM rated""",
    ),
    "execute_isolated": with_views(
        ["fx_printing_scripts"],
        f"""+ {RUN}
        SELECT row_id, 'docker' AS sandbox_type, CASE WHEN starts_with(script, 'print') THEN stdout ELSE '' END AS stdout,
          CAST(CASE WHEN failed THEN 137 WHEN starts_with(script, 'class') THEN 124 ELSE 0 END AS INTEGER) AS exit_code,
          starts_with(script, 'class') AS timed_out, failed AS memory_limit_hit FROM rated""",
    ),
    "sql_rewards": with_views(
        ["fx_executions"],
        f"""+ {PARSED}, rewarded AS (
          SELECT prompt_id, exec_id AS sample_id, CASE WHEN success AND kind = 'list' THEN pass_rate ELSE 0.0E0 END AS reward FROM verdict)
        SELECT prompt_id, sample_id, round(reward, 9) AS reward, round(avg(reward) OVER (PARTITION BY prompt_id), 9) AS prompt_mean,
          round(reward - avg(reward) OVER (PARTITION BY prompt_id), 9) AS advantage FROM rewarded""",
    ),
}

ORACLES["sql_triage"] = ORACLES["import_triage"].replace(
    """
          features = 'Class' AS has_class, features = 'Match' AS has_match, features = 'Delete' AS has_del,""", ""
)
