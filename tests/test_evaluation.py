import pytest
from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.functions import execution as X
from codegauge.operators import checkpoints, metrics, prepare, scoring
from codegauge.plans import evaluation
from codegauge.schemas import TASK_RESULT
from codegauge.sources import results as R

RESULT = "model_id string, dataset_name string, task_id string, token_count int, passed boolean, " \
         "correct_format boolean, extraction_success boolean, sandbox_execution_time double, result_ts int, result_id int"


def results(spark, rows):
    return spark.createDataFrame(rows, RESULT)


def test_metrics_leave_out_unanswered_rows(spark):
    rows = [
        ("m", "test", "1", 100, True, True, True, 1.0, 1, 1),
        ("m", "test", "2", 200, False, True, True, 2.0, 2, 2),
        ("m", "test", "3", 0, False, False, False, 0.0, 3, 3),
    ]
    row = metrics.dataset_metrics(results(spark, rows)).first()
    assert (row.pass_rate, row.format_success_rate, row.extraction_success_rate) == (0.5, 1.0, 1.0)
    assert (row.avg_sandbox_execution_time, row.completed_tasks) == (1.5, 2)
    assert (row.total_tokens, row.avg_tokens) == (300, 150.0)


def test_metrics_of_an_unseen_data_set_are_zero(spark):
    known = spark.createDataFrame([("m", "none")], "model_id string, dataset_name string")
    row = metrics.dataset_metrics(results(spark, []), known).first()
    assert (row.pass_rate, row.total_tokens, row.completed_tasks) == (0.0, 0, 0)


def test_metrics_count_repeated_tasks_unless_told(spark):
    rows = [("m", "d", "1", 10, False, True, True, 1.0, 1, 1), ("m", "d", "1", 20, True, True, True, 1.0, 2, 2)]
    assert metrics.dataset_metrics(results(spark, rows)).first().completed_tasks == 2
    latest = metrics.dataset_metrics(results(spark, rows), dedupe="latest").first()
    assert (latest.completed_tasks, latest.pass_rate) == (1, 1.0)


def test_pending_and_status(spark):
    tasks = spark.createDataFrame([("d", str(i)) for i in range(3)], "dataset_name string, task_id string")
    rows = [
        ("m", "d", "0", 0, False, False, False, 0.0, 1, 1), ("m", "d", "0", 5, True, True, True, 0.0, 2, 2),
        ("m", "d", "1", None, False, False, False, 0.0, 3, 3), ("m", "d", "9", 5, True, True, True, 0.0, 4, 4),
    ]
    pending = checkpoints.pending(tasks, results(spark, rows))
    assert {r.task_id for r in pending.collect()} == {"1", "2"}
    status = checkpoints.run_status(tasks, results(spark, rows)).first()
    assert (status.n_completed, status.n_incomplete, status.n_pending, status.is_complete) == (2, 1, 2, False)
    # an early empty row does not keep a finished task open
    done = [("m", "d", str(i), 5, True, True, True, 0.0, i, i) for i in range(3)]
    status = checkpoints.run_status(tasks, results(spark, rows[:1] + done))
    assert status.first().is_complete
    again = checkpoints.datasets_to_evaluate(status).first()
    assert again.starts_new_run


def test_status_of_datasets_never_started(spark):
    tasks = spark.createDataFrame([("d", "0"), ("d", "0"), ("e", "0"), ("e", "1")], "dataset_name string, task_id string")
    rows = results(spark, [("m", "d", "0", 5, True, True, True, 0.0, 1, 1)])
    status = checkpoints.run_status(tasks, rows)
    got = {r.dataset_name: (r.n_completed, r.n_incomplete, r.n_pending, r.is_complete) for r in status.collect()}
    assert got == {"d": (1, 0, 0, True), "e": (0, 0, 2, False)}
    assert [tuple(r) for r in checkpoints.datasets_to_evaluate(status).collect()] == [("m", "e", False)]
    fresh = spark.createDataFrame([("new",)], "model_id string")
    assert {r.n_pending for r in checkpoints.run_status(tasks, rows, fresh).collect()} == {1, 2}


def test_latest_run_ignores_models_with_a_longer_name(spark):
    rows = [("m", "2024-01-01", 1), ("m", "2024-02-01", 2), ("m", "2024-02-01", 3), ("m_2", "2025-01-01", 4)]
    df = spark.createDataFrame(rows, "model_id string, run_ts string, i int")
    assert {r.i for r in checkpoints.latest_run(df, ["i"]).collect()} == {2, 3, 4}


def test_telemetry_median_is_exact(spark):
    rows = [("monty", float(v), v % 2 == 0) for v in [5, 1, 1, 1, 9, 7, 2, 2]] + [("docker", 4.0, True)]
    df = spark.createDataFrame(rows, "sandbox_type string, duration_sec double, success boolean")
    got = {r.sandbox_type: r for r in metrics.execution_telemetry(df).collect()}
    assert got["monty"].median_sec == 2.0 and got["docker"].median_sec == 4.0
    assert got["monty"].share == pytest.approx(8 / 9)
    assert got["monty"].success_rate == 2 / 8
    assert got["docker"].runs_per_sec == 0.25


@pytest.mark.parametrize("n", [2, 999, 10_000])
def test_telemetry_median_with_a_coarse_sketch(spark, n):
    """The bracket stays right when the sketch is far from exact."""
    df = spark.range(n).select(
        F.lit("monty").alias("sandbox_type"), F.lit(True).alias("success"),
        F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") * 7919 % n) / 7.0).alias("duration_sec"),
    )
    want = df.select(F.percentile("duration_sec", 0.5).alias("m")).first().m
    for accuracy in (100, 100_000):
        assert metrics.execution_telemetry(df, accuracy).first().median_sec == pytest.approx(want)


def test_unknown_engines_are_counted(spark):
    rows = [("other", 1.0, True), (None, 3.0, False), ("monty", 1.0, True)]
    df = spark.createDataFrame(rows, "sandbox_type string, duration_sec double, success boolean")
    got = {r.sandbox_type: (r.n, r.median_sec) for r in metrics.execution_telemetry(df).collect()}
    assert got == {"unknown": (2, 2.0), "monty": (1, 1.0)}


EXECUTION = "i int, stdout string, exit_code int, is_valid_python boolean, timed_out boolean, memory_limit_hit boolean, " \
            "duration_sec double, sandbox_type string, errors array<struct<error_class:string,message:string,traceback:string>>"


def executions(spark, rows):
    return evaluation.with_success(spark.createDataFrame(rows, EXECUTION))


def test_skips_and_summary(spark):
    error = [("runtime", "a", None), ("runtime", "b", None)]
    df = executions(spark, [
        (1, "[true, false]", 0, True, False, False, 1.0, "monty", []),
        (2, "[]", 0, True, False, False, 1.0, "monty", []),
        (3, "[true]", 1, True, False, False, 1.0, "docker", error),
        (4, "oops", 0, True, False, False, 1.0, "docker", []),
        (5, '{"passed": true}', 0, True, False, False, 1.0, "docker", []),
    ]).withColumn("code", F.lit("c"))
    skipped = {r.i: r.errors for r in metrics.skipped_examples(df, "i", "code").collect()}
    assert skipped == {3: "a. b", 4: "Output parsing error: not valid JSON", 5: "Output parsing error: not a list"}
    row = metrics.training_verification(df).first()
    assert (row.overall_pass_rate, row.test_level_pass_rate) == (0.5, 0.5)
    assert (row.n_kept, row.fast_count, row.container_count, row.skipped_count) == (2, 2, 3, 3)
    empty = metrics.training_verification(df.where("i = 3")).first()
    assert (empty.overall_pass_rate, empty.test_level_pass_rate, empty.skipped_count) == (0.0, 0.0, 1)


def test_verify_summary_counts_missing_results_as_one_failed_test(spark):
    runs = spark.createDataFrame([(1, "[true, true]"), (2, "[]"), (3, None)], "i int, stdout string")
    rows = {r.kind: r for r in metrics.verify_summary(metrics.verify_per_task(runs, runs.limit(1), "i")).collect()}
    assert (rows["long"].n_tasks_passed, rows["long"].n_tests, rows["long"].n_tests_passed) == (1, 4, 2)


@pytest.mark.parametrize("exit_code,valid,errors,want", [
    (0, True, [], True), (0, True, None, True), (1, True, [], False), (0, False, [], False),
    (0, True, [("error", "x", None)], False), (124, True, [], False),
])
def test_success(spark, exit_code, valid, errors, want):
    df = executions(spark, [(1, "", exit_code, valid, exit_code == 124, exit_code == 137, 0.0, "monty", errors)])
    assert df.first().success is want


def test_training_preparation(spark):
    raw = spark.createDataFrame(
        [(1, "Add.", "out", "def f(x): return x", "f", ["assert f(1) == 1", "  assert f(2) == 2 ", "x = 1", " "], "kept")],
        "seq_id int, instruction string, output string, code string, entry_point string, testcase array<string>, extra string",
    )
    row = prepare.prepare_training(raw, num_samples=-1).first()
    assert row.tests == "\nimport json\nresults = [bool(f(1) == 1), bool(f(2) == 2)]\nprint(json.dumps(results))"
    assert row.test_solution == "def f(x): return x\n\n" + row.tests
    assert row.prompt[0].role == "user"
    assert row.prompt[0].content == "Add.\n\n" + V.CODING_INSTRUCTIONS.replace("{function_name}", "f")
    assert set(row.asDict()) == {"seq_id", "extra", "prompt", "tests", "test_solution"}


def test_prepared_scripts_are_python_and_print_results(spark):
    """The prepared tests really run: with a right and with a wrong solution."""
    import contextlib
    import io

    test = ('def assertion(out, exp, atol):\n'
            '    assert out == exp, f"out: {out}, exp: {exp}"\n\ninputs = [[1], [2]]\nresults = [1, 2]\n'
            "for i, (inp, exp) in enumerate(zip(inputs, results)):\n    assertion(same(*inp), exp, 0)")
    raw_b = spark.createDataFrame(
        [(7, "P", "def same(x): return x", test, ["assert same(1) == 1"], ["import math"])],
        "task_id int, prompt string, code string, test string, test_list array<string>, test_imports array<string>",
    )
    b = prepare.prepare_benchmark_b(raw_b).first()
    check = "def check(candidate):\n    assert candidate(1) == {0: 1}[0]"
    raw_a = spark.createDataFrame(
        [("HumanEval/1", "def same(x):\n", "    return x", "same", check)],
        "task_id string, prompt string, canonical_solution string, entry_point string, test string",
    )
    a = prepare.prepare_benchmark_a(raw_a).first()

    def printed(script):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            exec(script, {})
        return out.getvalue().strip().split("\n")[-1]

    assert b.entry_point == "same" and b.task_id == "7"
    assert printed(b.test_solution) == "[true, true]"
    assert printed(b.short_test_solution) == "[true]"
    assert printed(b.test.replace("{solution}", "def same(x): return 1")) == "[true, false]"
    assert printed(a.test_solution) == '{"passed": true}'
    assert printed(a.test.replace("{solution}", "def same(x): return 0")) == '{"passed": false}'


def test_excluded_tasks(spark):
    raw = spark.createDataFrame([(255,), (1,)], "task_id int").select(
        "task_id", F.lit("p").alias("prompt"), F.lit("c").alias("code"), F.lit("t").alias("test"),
        F.array(F.lit("assert 1")).alias("test_list"), F.array().cast("array<string>").alias("test_imports"))
    assert [r.task_id for r in prepare.prepare_benchmark_b(raw).collect()] == ["1"]
    table = spark.createDataFrame([("1",)], "task_id string")
    assert [r.task_id for r in prepare.prepare_benchmark_b(raw, table).collect()] == ["255"]


def run_python(df, key):
    """Executions with a stand-in outcome: code that says good passes."""
    stdout = F.when(F.col("script").contains("good"), '[true, true]').otherwise('[true, false]')
    return df.select(key, stdout.alias("stdout"), F.lit(0).alias("exit_code"), F.lit(True).alias("is_valid_python"),
                     F.lit(False).alias("timed_out"), F.lit(False).alias("memory_limit_hit"), F.lit(0.5).alias("duration_sec"),
                     F.lit("monty").alias("sandbox_type"),
                     F.array().cast("array<struct<error_class:string,message:string,traceback:string>>").alias("errors"))


def test_reward_job(spark):
    tasks = spark.createDataFrame([("t", "assert True")], "task_id string, tests string")
    completions = spark.createDataFrame(
        [(1, "t", "```python\ndef good(): pass\n```"), (2, "t", "```python\ndef bad(): pass\n```"), (3, "t", "no code"),
         (4, "t", "```python\n```")], "sample_id int, task_id string, completion string")
    rewards = evaluation.reward_completions(tasks, completions, run_python)
    assert {r.sample_id: r.reward for r in rewards.collect()} == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.5}
    binary = evaluation.reward_completions(tasks, completions, run_python, binary=True)
    assert {r.sample_id: r.reward for r in binary.collect()} == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}


def test_evaluation_job_with_resume(spark, tmp_path):
    tasks = spark.createDataFrame([(str(i), f"prompt {i}") for i in range(4)], "task_id string, text string").select(
        "task_id", F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("content"))).alias("prompt"),
        F.lit("{solution}\ncheck({0})").alias("test"))

    def generate(todo):
        text = F.when(F.col("task_id") == "2", "nothing").when(F.col("task_id") == "3", "```python\n```").otherwise(
            F.concat(F.lit("```python\ndef good(): return "), "task_id", F.lit("\n```")))
        return todo.select("task_id", text.alias("completion"), F.lit(10).alias("token_count"),
                           F.lit(0.1).alias("generation_time"), F.lit(100.0).alias("throughput"))

    path = str(tmp_path / "results")
    none = R.read_results(spark, path)
    assert none.count() == 0

    def evaluate(so_far):
        return evaluation.evaluate_dataset(tasks, so_far, generate, run_python, "mbpp", "org/m", "m")

    first = evaluate(none).where("task_id <> '1'")
    assert [(f.name, f.dataType.simpleString()) for f in first.schema] == [(f.name, f.dataType.simpleString()) for f in TASK_RESULT]
    R.append_results(first.withColumn("run_ts", F.lit("2024-01-01T00-00-00Z")), path)
    stored = R.read_latest_run(spark, path, "m")
    rows = {r.task_id: r for r in stored.collect()}
    assert set(rows) == {"0", "2", "3"}
    assert rows["0"].passed and rows["0"].pass_rate == 1.0 and rows["0"].sandbox_execution_time == 0.5
    assert rows["0"].prompt[0].content == "prompt 0" and rows["0"].completion.startswith("```python")
    assert not rows["2"].extraction_success and rows["2"].extracted_code is None
    # an empty block counts as extracted but is not run
    assert rows["3"].extraction_success and not rows["3"].passed and rows["3"].pass_rate is None
    assert [r.task_id for r in evaluate(stored).collect()] == ["1"]


def test_results_do_not_depend_on_partitions(spark):
    """Rewards and statuses are the same for one and for many partitions."""
    fence = "`" * 3
    completions = spark.range(400).select(
        F.col("id").alias("sample_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 7).cast("string")).alias("task_id"),
        F.concat(F.lit(f"{fence}python\ndef "), F.when(F.col("id") % 2 == 0, "good").otherwise("bad"),
                 F.lit(f"(): pass\n{fence}")).alias("completion"))
    tasks = completions.select("task_id", F.lit("assert 1").alias("tests")).distinct()

    def rewards(parts):
        scored = evaluation.reward_completions(tasks.repartition(parts), completions.repartition(parts), run_python)
        return {r.sample_id: (r.task_id, r.reward, r.script) for r in scored.collect()}

    one = rewards(1)
    assert len(one) == 400 and one == rewards(16)


def test_evaluate_resumes_and_then_starts_a_new_run(spark, tmp_path, monkeypatch):
    message = F.array(F.struct(F.lit("user").alias("role"), F.lit("p").alias("content"))).alias("prompt")
    tasks = spark.createDataFrame([(str(i),) for i in range(3)], "task_id string").select(
        "task_id", message, F.lit("{solution}").alias("test"))
    failing = {"yes": True}
    stamps = iter(["2024-01-01T00-00-00Z", "2024-01-02T00-00-00Z"])
    monkeypatch.setattr(evaluation, "new_run_stamp", lambda: next(stamps))

    def generate(todo):
        # the first call has no answer for task 2
        dead = (F.col("task_id") == "2") & F.lit(failing["yes"])
        return todo.select(
            "task_id", F.when(dead, "").otherwise("```python\ndef good(): pass\n```").alias("completion"),
            F.when(dead, 0).otherwise(10).alias("token_count"), F.lit(0.1).alias("generation_time"),
            F.lit(1.0).alias("throughput"))

    def evaluate():
        both = {"human_eval": tasks, "mbpp": tasks.where("task_id < '2'")}
        table, run = evaluation.evaluate(
            spark, both, str(tmp_path / "results"), generate, run_python, "org/m", "org/m")
        return {r.dataset_name: r for r in table.collect()}, run.select("run_ts").distinct().collect(), run.count()

    metrics_1, runs_1, n_1 = evaluate()
    assert (metrics_1["human_eval"].completed_tasks, metrics_1["mbpp"].completed_tasks, n_1) == (2, 2, 5)
    failing["yes"] = False
    metrics_2, runs_2, n_2 = evaluate()
    assert runs_2 == runs_1 and n_2 == 6  # only the unanswered task was added
    assert metrics_2["human_eval"].completed_tasks == 3 and metrics_2["human_eval"].pass_rate == 1.0
    _, runs_3, n_3 = evaluate()
    assert runs_3[0].run_ts == "2024-01-02T00-00-00Z" and n_3 == 5


def test_reward_functions_get_all_columns(spark):
    df = spark.createDataFrame([(1, 0.5, True)], "i int, rate double, correct_format boolean")
    row = scoring.apply_rewards(
        df, {"accuracy": lambda rate, **_: rate, "form": lambda correct_format, **_: correct_format.cast("double")},
        {"form": 0.5}).first()
    assert (row.accuracy, row.form, row.reward) == (0.5, 1.0, 1.0)
    with pytest.raises(ValueError):
        scoring.apply_rewards(df, {"a": lambda rate, **_: rate}, {"b": 1.0})


def test_verify_jobs(spark):
    prepared = spark.createDataFrame([("1", "good", "bad"), ("2", "good", "good")],
                                     "task_id string, test_solution string, short_test_solution string")
    summary, per_task = evaluation.verify_benchmark(prepared, run_python)
    assert {r.kind: r.task_pass_rate for r in summary.collect()} == {"long": 1.0, "short": 0.5}
    assert per_task.count() == 4
    training = spark.createDataFrame([(1, "good"), (2, "bad")], "seq_id int, test_solution string")
    summary, kept, skipped = evaluation.verify_training(training, run_python)
    assert summary.first().overall_pass_rate == 0.5
    assert (kept.count(), skipped.count()) == (2, 0)


def test_model_change(spark):
    df = spark.createDataFrame([("base", "a", 0.5), ("tuned", "a", 0.75), ("base", "b", 0.0), ("tuned", "b", 1.0)],
                               "model_id string, dataset_name string, pass_rate double")
    got = {r.dataset_name: r.change for r in metrics.model_change(df, "base", "tuned").collect()}
    assert got == {"a": 0.5, "b": None}


def test_run_names(spark):
    df = spark.createDataFrame([("m", "2024-01-31 05:06:07")], "m string, t string")
    assert df.select(X.run_name(F.col("m"), F.col("t").cast("timestamp"))).first()[0] == "m_2024-01-31T05-06-07Z"
