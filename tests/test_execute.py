import ast
import json
import sys
import time

import pytest
from pyspark.sql import functions as F

from codegauge.operators import execute as E


def runner(script, limits):
    """Shows printed literals; other words stand for failures."""
    if script == "sleep":
        time.sleep(5)
    if script == "memory":
        raise MemoryError("too much")
    if script == "later":
        raise NotImplementedError("no classes")
    if script == "exit":
        return {"exit_code": 3, "stderr": "bad\n", "error_class": "runtime", "message": "exit 3"}
    value = ast.literal_eval(ast.parse(script).body[-1].value.args[0])
    return {"stdout": json.dumps(value) + "\n", "result": repr(value)}


def run(spark, scripts, **options):
    df = spark.createDataFrame(list(enumerate(scripts)), "i int, script string")
    return {r.i: r for r in E.execute_scripts(df, "i", "script", runner, **options).collect()}


def test_outcomes_and_limits(spark):
    scripts = ["print([True])", "sleep", "memory", "later", "def f(:", "exit", "undefined", None]
    rows = run(spark, scripts, engine="monty", limits={"max_duration_sec": 0.5})
    assert set(rows) == set(range(7))  # no row for a missing script
    seen = {i: (r.exit_code, r.errors[0].error_class if r.errors else None) for i, r in rows.items()}
    assert seen == {
        0: (0, None), 1: (124, "timeout"), 2: (137, "memory"), 3: (1, "not_supported"), 4: (1, "syntax"),
        5: (3, "runtime"), 6: (1, "runtime"),
    }
    assert rows[0].stdout == "[true]" and rows[0].result == "[True]" and rows[0].sandbox_type == "monty"
    assert rows[1].timed_out and rows[2].memory_limit_hit and not rows[4].is_valid_python
    assert rows[5].stderr == "bad"
    assert rows[1].duration_sec == pytest.approx(0.5, abs=0.4)
    assert rows[1].end_time > rows[1].start_time


def stubborn(script, limits):
    """Ends the interpreter, raises odd exceptions, or swallows its time-out."""
    if script.startswith("exit"):
        sys.exit({"exit 0": 0, "exit 7": 7, "exit text": "gone", "exit": None}[script])
    if script == "interrupt":
        raise KeyboardInterrupt
    end = time.monotonic() + 8
    while script == "swallow" and time.monotonic() < end:
        try:
            time.sleep(5)
        except TimeoutError:
            if limits.get("rings", 0) > 1:
                raise
            limits["rings"] = limits.get("rings", 0) + 1
    return {"stdout": str(limits.get("max_memory_mb"))}


def test_nothing_ends_the_batch(spark):
    scripts = ["exit 0", "exit 7", "exit text", "exit", "interrupt", "swallow", "fine"]
    df = spark.createDataFrame(list(enumerate(scripts)), "i int, script string")
    rows = {r.script: r for r in E.execute_scripts(df, "i", "script", stubborn, limits={"max_duration_sec": 0.3}, attach=True).collect()}
    assert {s: r.exit_code for s, r in rows.items()} == {
        "exit 0": 0, "exit 7": 7, "exit text": 1, "exit": 0, "interrupt": 1, "swallow": 124, "fine": 0,
    }
    assert rows["exit text"].stderr == "gone" and rows["exit 7"].errors[0].error_class == "runtime"
    assert rows["swallow"].duration_sec < 5
    assert rows["fine"].stdout == "64"  # the default limit stays beside the call's own


def test_inputs_are_part_of_a_script(spark):
    rows = [(i, "s", {"A": str(i % 2)}, [("f", bytearray(b"x"))]) for i in range(6)]
    df = spark.createDataFrame(rows, "i int, script string, env map<string,string>, files array<struct<name:string,content:binary>>")
    show = lambda script, limits: {"stdout": json.dumps(limits["inputs"], sort_keys=True)}
    got = {r.i: r for r in E.execute_scripts(df, "i", "script", show, input_columns=["env", "files"]).collect()}
    assert {i: json.loads(r.stdout) for i, r in got.items()} == {
        i: {"env": {"A": str(i % 2)}, "files": [{"name": "f", "content": "eA=="}]} for i in range(6)
    }
    assert len({r.start_time for r in got.values()}) == 2


def test_equal_scripts_run_once_and_reach_every_row(spark):
    rows = run(spark, ["print([True])"] * 300 + [f"print([{i}])" for i in range(50)])
    assert len(rows) == 350
    assert len({rows[i].start_time for i in range(300)}) == 1
    assert rows[310].stdout == "[10]"


def fast(script, limits):
    if "long" in script:
        raise RuntimeError("too long")
    return runner(script, limits)


@pytest.mark.parametrize("skip_check", [False, True])
def test_fallback(spark, skip_check):
    scripts = ["print([True])", "class A: pass\nprint([False])", "print(['long'])", "def f(:", "import numpy\nprint([1])"]
    df = spark.createDataFrame(list(enumerate(scripts)), "i int, script string")
    rows = {
        r.i: r for r in E.execute_with_fallback(
            df, "i", "script", fast, runner, skip_compatibility_check=skip_check).collect()
    }
    engines = [rows[i].sandbox_type for i in range(5)]
    if skip_check:
        assert engines == ["monty", "monty", "docker", "monty", "monty"]
    else:
        assert engines == ["monty", "docker", "docker", "monty", "docker"]
    assert rows[2].stdout == '["long"]'
    assert rows[3].exit_code == 1 and not rows[3].is_valid_python


def test_merge_takes_the_retry(spark):
    first = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k int, v string, w int")
    retry = spark.createDataFrame([(2, "c", None)], "k int, v string, w int")
    rows = sorted(E.merge_fallback(first, retry, "k").collect())
    assert [tuple(r) for r in rows] == [(1, "a", None), (2, "c", None)]


def triple(x):
    return x * 3


def test_container_script_keeps_helpers_and_header(spark):
    from codegauge.functions import scripts as S

    sources = S.helper_sources([triple, len])  # a built-in has no source
    script = S.container_script(F.lit("print(triple(2))"), F.array(F.lit("numpy")), sources)
    text = spark.range(1).select(script).first()[0]
    assert text.startswith("def triple(x):\n    return x * 3\n\n\n# /// script\n")
    assert text.endswith("# ///\n\nprint(triple(2))")
    assert S.with_helpers("unchanged", []) == "unchanged"


@pytest.mark.parametrize("fallback", [False, True])
def test_attached_executions_score_without_a_further_join(spark, fallback):
    from codegauge.operators import scoring

    good, bad = "print([True, True])", "print([True, False])"
    rows = [(i, good if i % 3 else bad, "x") for i in range(60)] + [(60, None, None), (61, "def f(:", "x")]
    df = spark.createDataFrame(rows, "i int, script string, extracted_code string")
    if fallback:
        runs = E.execute_with_fallback(df, "i", "script", fast, runner, attach=True)
    else:
        runs = E.execute_scripts(df, "i", "script", runner, attach=True)
    rewards = {r.i: r.reward for r in scoring.add_rewards(scoring.classify_execution(runs)).collect()}
    assert rewards == {**{i: 1.0 if i % 3 else 0.5 for i in range(60)}, 60: 0.0, 61: 0.0}
    separate = scoring.score_rewards(df, scoring.classify_execution(E.execute_scripts(df, "i", "script", runner)), "i")
    assert {r.i: r.reward for r in separate.collect()} == rewards


def test_named_inputs_become_variables(spark):
    from codegauge.functions import scripts as S

    value = {"x": [1, 'a\n"b\\'], "y": {"k": None}, "z": "é😀"}
    df = spark.createDataFrame([("out = [x, y, z]", json.dumps(value))], "s string, j string")
    scope = {}
    exec(df.select(S.with_inputs(F.col("s"), F.col("j"), ["x", "y", "z"])).first()[0], scope)
    assert scope["out"] == [value["x"], value["y"], value["z"]]
    assert df.select(S.with_inputs(F.col("s"), F.col("j"), [])).first()[0] == "out = [x, y, z]"
    with pytest.raises(ValueError):
        S.with_inputs(F.col("s"), F.col("j"), ["x; y"])
