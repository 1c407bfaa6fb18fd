"""Prepared task tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.functions import scripts as S
from codegauge.operators import prepare
from workload import expected_texts as E
from workload.views import table, view, with_views


def _tests(number):
    return F.array(
        F.concat(F.lit("assert fn_"), number, F.lit("(1) == 1")),
        F.concat(F.lit(" assert fn_"), number, F.lit("(2) == 2 ")),
        F.lit("x = 1"),
    )


def _benchmark_b(spark, sf_dir):
    """Raw benchmark B rows; some tests check by truth value only."""
    tasks = view(spark, sf_dir, "fx_tasks")
    truth_test = F.concat(
        F.lit("import re"), F.lit(V.CHECK_BY_TRUTH_BEFORE),
        F.lit("    assert exact_match\nfor i, inp in enumerate(inputs):\n    assertion(fn_"),
        F.col("task_id"), F.lit("(*inp), ref(*inp), 0)"),
    )
    return tasks.select(
        "task_id", "prompt", "code",
        F.when(F.col("item_id") % 4 == 3, truth_test).otherwise(F.col("test")).alias("test"),
        _tests(F.col("task_id")).alias("test_list"),
        F.when(F.col("item_id") % 2 == 0, F.array(F.lit("import math"), F.lit("import re")))
        .otherwise(F.array().cast("array<string>")).alias("test_imports"),
    )


def _benchmark_a(spark, sf_dir):
    return view(spark, sf_dir, "fx_tasks").select(
        F.concat(F.lit("HumanEval/"), "task_id").alias("task_id"), "prompt",
        F.concat(F.lit("    return "), "task_id").alias("canonical_solution"), "entry_point",
        F.concat(F.lit("def check(candidate):\n    assert _poly(*candidate(*inp), inp) <= {0}\n# "), "task_id").alias("test"),
    )


def prompt_build(spark, sf_dir):
    """Prompts of all three kinds, as message content."""
    tasks = view(spark, sf_dir, "fx_tasks")
    unnamed = F.when(F.col("item_id") % 5 != 0, F.col("entry_point"))
    return tasks.select(
        "task_id",
        S.completion_prompt(F.col("prompt"))[0]["content"].alias("complete_text"),
        S.instruction_prompt(F.col("prompt"), unnamed)[0]["content"].alias("instruct_text"),
        S.instruction_prompt(F.col("prompt"), unnamed)[0]["role"].alias("role"),
    )


def entry_point(spark, sf_dir):
    """Called function, by name and in the greedy form."""
    tasks = view(spark, sf_dir, "fx_tasks")
    test = (
        F.when(F.col("item_id") % 3 == 0, F.lit("no call here"))
        .when(F.col("item_id") % 3 == 1, F.concat(F.lit("assertion(set(fn_"), "task_id", F.lit("(*inp)), exp, 0)")))
        .otherwise(F.col("test"))
    )
    return tasks.select(
        "task_id",
        S.entry_point(test).alias("entry_point"),
        S.entry_point(test, "greedy").alias("entry_point_greedy"),
    )


def test_rewrite(spark, sf_dir):
    """Asserting tests turned into result-collecting ones."""
    return _benchmark_b(spark, sf_dir).select(
        "task_id", S.collect_results(F.col("test")).alias("test")
    )


def prepared_a(spark, sf_dir):
    """Benchmark A with a repaired task kept and another left out."""
    prepared = prepare.prepare_benchmark_a(
        _benchmark_a(spark, sf_dir), V.BENCHMARK_A_REPAIRS, ["HumanEval/7"]
    )
    return prepared.select(
        "task_id", F.col("prompt")[0]["content"].alias("prompt"), "entry_point", "test",
        "test_solution", "canonical_solution",
    )


def prepared_a_repair_table(spark, sf_dir):
    """The same with repairs and exclusions from tables."""
    raw = _benchmark_a(spark, sf_dir)
    number = F.split("task_id", "/")[1].cast("int")
    repairs = raw.where(number % 8 == 0).select(
        "task_id", F.lit("_poly(*candidate(*inp), inp)").alias("find"),
        F.lit("_poly(*inp, candidate(*inp))").alias("replace"),
    )
    excluded = raw.where(number % 9 == 1).select("task_id")
    return prepare.prepare_benchmark_a(raw, repairs, excluded).select("task_id", "test")


def prepared_b(spark, sf_dir):
    prepared = prepare.prepare_benchmark_b(_benchmark_b(spark, sf_dir), ["5", "11"])
    return prepared.select(
        "task_id", "entry_point", "test", "test_solution", "short_test_list", "short_tests",
        "short_test_solution", "canonical_solution", F.col("prompt")[0]["content"].alias("prompt"),
    )


def _training(spark, sf_dir):
    """Training rows: one per document, the whole text is the instruction."""
    docs = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    return docs.select(
        F.col("doc_id").alias("seq_id"), F.col("text").alias("instruction"), F.col("lang").alias("output"),
        F.concat(F.lit("def fn_"), number, F.lit("(x):\n    return x")).alias("code"),
        F.concat(F.lit("fn_"), number).alias("entry_point"), _tests(number).alias("testcase"),
    )


def prepared_training(spark, sf_dir):
    prepared = prepare.prepare_training(_training(spark, sf_dir))
    content = F.col("prompt")[0]["content"]
    return prepared.select("seq_id", F.md5(content).alias("prompt_md5"), "tests", "test_solution")


def sample_seeded(spark, sf_dir):
    """Every fifth row has no key and is placed by its number instead."""
    events = table(spark, sf_dir, "events").withColumn("key", F.when(F.col("event_id") % 5 > 0, F.col("event_id")))
    return prepare.sample_rows(events, "key", 2500, seed=7, spread_by=["event_id"]).select("event_id", "user_id", "value")


def task_ids_recovered(spark, sf_dir):
    """Task ids read back from the first line of prepared scripts."""
    prepared = prepare.prepare_benchmark_b(_benchmark_b(spark, sf_dir), [])
    script = F.when(F.col("task_id").cast("int") % 6 == 0, F.lit("\n\nprint(1)")).otherwise(
        F.concat(F.lit("\n  "), "test_solution")
    )
    return prepared.select("task_id", S.task_id_of_script(script).alias("found_id"))


QUERIES = {
    f.__name__: f
    for f in (
        prompt_build, entry_point, test_rewrite, prepared_a, prepared_a_repair_table, prepared_b,
        prepared_training, sample_seeded, task_ids_recovered,
    )
}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    """SQL that fills the markers of a template, longest text untouched."""
    sql = quoted(template)
    for name, value in values.items():
        sql = f"replace({sql}, '{{{name}}}', {value})"
    return sql


INSTRUCTIONS = filled(E.CODING_INSTRUCTIONS, function_name="coalesce(name, 'None')")
TRUTH_TEST = f"""concat('import re', {quoted(E.CHECK_BY_TRUTH_BEFORE)},
  {quoted(chr(10).join(["    assert exact_match", "for i, inp in enumerate(inputs):", "    assertion(fn_"]))},
  task_id, '(*inp), ref(*inp), 0)')"""


def _rewritten(test: str) -> str:
    for find, replacement in E.TEST_REWRITES:
        test = f"replace({test}, {quoted(find)}, {quoted(replacement)})"
    return f"regexp_replace({test}, 'assertion\\((.*)\\)', '__test_results.append(__check(\\1))', 'g')"


RAW_B = f"""
raw_b AS (
  SELECT task_id, prompt, code, entry_point AS true_name, item_id,
    CASE WHEN item_id % 4 = 3 THEN {TRUTH_TEST} ELSE test END AS test,
    CASE WHEN item_id % 2 = 0 THEN concat('import math', chr(10), 'import re') ELSE '' END AS imports,
    concat('[bool(fn_', task_id, '(1) == 1), bool(fn_', task_id, '(2) == 2), bool(x = 1)]') AS short_test_list
  FROM fx_tasks
)"""
PREPARED_B = f"""
{RAW_B}, named AS (
  SELECT *, nullif(regexp_extract(test, 'assertion\\((\\w+)\\(', 1), '') AS name, {_rewritten('test')} AS rewritten FROM raw_b
), prepared AS (
  SELECT *,
    {filled(E.RESULT_LIST_SCRIPT, task_id="task_id", test_cases="rewritten")} AS script,
    {filled(E.SHORT_TEST_SCRIPT, task_id="task_id", other_imports="imports", test_cases="short_test_list")} AS short_script
  FROM named
)"""
RAW_A = """
raw_a AS (
  SELECT concat('HumanEval/', task_id) AS task_id, item_id, prompt, entry_point,
    concat('    return ', task_id) AS canonical_solution,
    concat('def check(candidate):', chr(10), '    assert _poly(*candidate(*inp), inp) <= {0}', chr(10), '# ', task_id) AS test
  FROM fx_tasks
)"""
REPAIRED = "replace(test, '_poly(*candidate(*inp), inp)', '_poly(*inp, candidate(*inp))')"
SCRIPT_A = filled(E.PASS_FAIL_SCRIPT, task_id="task_id", entry_point="entry_point", test_cases="fixed")

ORACLES = {
    "prompt_build": with_views(
        ["fx_tasks"],
        f"""+ named AS (SELECT *, CASE WHEN item_id % 5 <> 0 THEN entry_point END AS name FROM fx_tasks)
        SELECT task_id, concat({quoted(E.COMPLETE_FUNCTION_PREFIX)}, chr(10), prompt) AS complete_text,
          concat(prompt, chr(10), chr(10), {INSTRUCTIONS}) AS instruct_text, 'user' AS role FROM named""",
    ),
    "entry_point": with_views(
        ["fx_tasks"],
        """SELECT task_id,
          CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'set' ELSE entry_point END AS entry_point,
          CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN concat('set(', entry_point) ELSE entry_point END AS entry_point_greedy
        FROM fx_tasks""",
    ),
    "test_rewrite": with_views(
        ["fx_tasks"], f"+ {RAW_B} SELECT task_id, {_rewritten('test')} AS test FROM raw_b"
    ),
    "prepared_a": with_views(
        ["fx_tasks"],
        f"""+ {RAW_A}, repaired AS (
          SELECT *, CASE WHEN task_id = 'HumanEval/32' THEN {REPAIRED} ELSE test END AS fixed FROM raw_a
          WHERE task_id <> 'HumanEval/7'
        ), scripts AS (SELECT *, {SCRIPT_A} AS script FROM repaired)
        SELECT task_id, concat({quoted(E.COMPLETE_FUNCTION_PREFIX)}, chr(10), prompt) AS prompt, entry_point, script AS test,
          replace(script, '{{solution}}', concat(prompt, canonical_solution)) AS test_solution, canonical_solution
        FROM scripts""",
    ),
    "prepared_a_repair_table": with_views(
        ["fx_tasks"],
        f"""+ {RAW_A}, repaired AS (
          SELECT *, CASE WHEN item_id % 8 = 0 THEN {REPAIRED} ELSE test END AS fixed FROM raw_a
          WHERE item_id % 9 <> 1)
        SELECT task_id, {SCRIPT_A} AS test FROM repaired""",
    ),
    "prepared_b": with_views(
        ["fx_tasks"],
        f"""+ {PREPARED_B}
        SELECT task_id, name AS entry_point, script AS test, replace(script, '{{solution}}', code) AS test_solution,
          short_test_list, short_script AS short_tests, replace(short_script, '{{solution}}', code) AS short_test_solution,
          code AS canonical_solution, concat(prompt, chr(10), chr(10), {INSTRUCTIONS}) AS prompt
        FROM prepared WHERE task_id NOT IN ('5', '11')""",
    ),
    "prepared_training": f"""
        WITH sampled AS (
          SELECT * FROM documents
        ), rows AS (
          SELECT doc_id AS seq_id, text, concat('fn_', CAST(doc_id AS string)) AS name,
            concat('[bool(fn_', CAST(doc_id AS string), '(1) == 1), bool(fn_', CAST(doc_id AS string), '(2) == 2)]') AS cases
          FROM sampled
        ), tests AS (
          SELECT *, {filled(E.TRAINING_TEST_SCRIPT, test_cases="cases")} AS tests FROM rows)
        SELECT seq_id, md5(concat(text, chr(10), chr(10), {INSTRUCTIONS})) AS prompt_md5, tests,
          concat('def ', name, '(x):', chr(10), '    return x', chr(10), chr(10), tests) AS test_solution
        FROM tests""",
    "sample_seeded": """
        SELECT event_id, user_id, value FROM events
        ORDER BY md5(concat('7:', CASE WHEN event_id % 5 > 0 THEN '' ELSE 'null:' END, CAST(event_id AS string))), event_id LIMIT 2500""",
    "task_ids_recovered": with_views(
        ["fx_tasks"],
        "SELECT task_id, CASE WHEN item_id % 6 = 0 THEN '' ELSE task_id END AS found_id FROM fx_tasks",
    ),
}
