"""Limits that hold by force, and table functions in SQL text."""

import os
import signal
import subprocess
import time

import pytest
from pyspark.sql import functions as F

from codegauge.functions import tables
from codegauge.operators import execute as E
from codegauge.operators import triage
from workload.views import SCRIPT_FORMS


def wild(script, limits):
    """Does what its script says, among it things a runner must not be able to do."""
    if script == "allocate":
        return {"stdout": str(len(bytearray(1 << 30)))}
    if script == "grow":  # in small steps, and swallowing what is said of it
        held = []
        try:
            while True:
                held.append(bytearray(1 << 20))
        except MemoryError:
            return {"stdout": "never mind", "error_class": "memory", "message": "grew"}
    if script == "deaf":
        for number in (signal.SIGALRM, signal.SIGTERM, signal.SIGINT):
            signal.signal(number, signal.SIG_IGN)
        while True:
            time.sleep(1)
    if script == "leave":
        os._exit(7)
    if script == "crash":
        os.kill(os.getpid(), signal.SIGSEGV)
    if script == "killed":
        os.kill(os.getpid(), signal.SIGKILL)
    if script == "child":  # leaves a process behind and hangs
        subprocess.Popen(["sleep", "300"])
        time.sleep(300)
    if script == "raise":
        raise ValueError("no")
    return {"stdout": f"{script} {os.getpid()}"}


def isolated(spark, scripts, **limits):
    df = spark.createDataFrame(list(enumerate(scripts)), "i int, script string").coalesce(1)
    runs = E.execute_scripts(df, "i", "script", wild, limits={"max_duration_sec": 0.5, "max_memory_mb": 256, **limits}, partitions=1, isolate=True)
    return {r.script: r for r in df.join(runs, "i").collect()}


def test_each_script_ends_alone(spark):
    scripts = ["fine", "allocate", "deaf", "leave", "crash", "killed", "raise", "grow", "also fine", "fine again"]
    rows = isolated(spark, scripts)
    assert {s: r.exit_code for s, r in rows.items()} == {
        "fine": 0, "allocate": 137, "deaf": 124, "leave": 7, "crash": 139, "killed": 137, "raise": 1, "grow": 137, "also fine": 0, "fine again": 0,
    }
    assert rows["allocate"].memory_limit_hit and not rows["allocate"].timed_out and rows["allocate"].stdout == ""
    assert rows["deaf"].timed_out and rows["deaf"].duration_sec < 5
    assert rows["raise"].errors[0].message == "no" and rows["leave"].errors[0].error_class == "runtime"
    me = str(os.getpid())
    assert all(rows[s].stdout.split()[-1] != me for s in ("fine", "also fine", "fine again"))


def test_what_a_script_starts_ends_with_it(spark):
    before = subprocess.run(["ps", "-eo", "args"], capture_output=True, text=True).stdout.count("sleep 300")
    assert isolated(spark, ["child"])["child"].exit_code == 124
    after = subprocess.run(["ps", "-eo", "args"], capture_output=True, text=True).stdout.count("sleep 300")
    assert after == before


def test_without_a_memory_limit_memory_is_free(spark):
    assert isolated(spark, ["allocate"], max_memory_mb=None, max_duration_sec=30.0)["allocate"].stdout == str(1 << 30)


def test_one_child_takes_many_scripts(spark):
    rows = isolated(spark, [f"s{k}" for k in range(200)])
    assert len({r.stdout.split()[-1] for r in rows.values()}) == 1


def test_isolated_fallback(spark):
    df = spark.createDataFrame(list(enumerate(["x = 1", "allocate", "import numpy"])), "i int, script string")
    rows = {r.i: r for r in E.execute_with_fallback(df, "i", "script", wild, wild, limits={"max_memory_mb": 256}, isolate=True).collect()}
    assert {i: (r.sandbox_type, r.exit_code) for i, r in rows.items()} == {0: ("monty", 0), 1: ("docker", 137), 2: ("docker", 0)}


# --- SQL ------------------------------------------------------------------------------------


def test_verdicts_are_those_of_the_operator(spark):
    scripts = ["\n".join(form[0]) for form in SCRIPT_FORMS] + [None, "", "x" * 70_000, "import os, numpy, yaml\nclass A: pass", "del x\nimport numpy"]
    df = spark.createDataFrame(list(enumerate(scripts)), "id int, script string")
    df.createOrReplaceTempView("given_scripts")
    tables.register(spark)
    got = spark.sql("SELECT * FROM triage_scripts(TABLE (SELECT id, script FROM given_scripts))").collect()
    want = triage.triage(df, "script").select(F.col("id").cast("string"), "parse_ok", "modules", "is_compatible", "reason").collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)


@pytest.mark.parametrize("stdout, success, reward", [
    ("[true, false]", True, 0.5), ("log\n[1, 0, \"\", \"x\"]", True, 0.5), ("[true]", False, 0.0), ("[true]", None, 0.0), ("[]", True, 0.0),
    ("{}", True, 0.0), ("[NaN]", True, 0.0), ("oops", True, 0.0), ("", True, 0.0), (None, True, 0.0), ("[true]\n", True, 1.0), ("[" * 5000, True, 0.0),
])
def test_reward_of(stdout, success, reward):
    assert tables.reward_of(stdout, success) == reward


def test_rewards_by_prompt(spark):
    rows = [(p, s, out, True) for p, s, out in [("a", 1, "[true]"), ("a", 2, "[false]"), ("b", 3, "[true, false]"), (None, 4, "[true]"), ("a", 5, "x")]]
    spark.createDataFrame(rows, "prompt_id string, sample_id int, stdout string, success boolean").createOrReplaceTempView("given_runs")
    tables.register(spark)
    got = spark.sql("SELECT * FROM prompt_rewards(TABLE (SELECT * FROM given_runs) PARTITION BY prompt_id)").collect()
    third = 1 / 3
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == [
        ("a", "1", 1.0, third, 1 - third), ("a", "2", 0.0, third, -third), ("b", "3", 0.5, 0.5, 0.0), (None, "4", 1.0, 1.0, 0.0), ("a", "5", 0.0, third, -third),
    ]
    assert spark.sql("SELECT * FROM prompt_rewards(TABLE (SELECT * FROM given_runs WHERE false) PARTITION BY prompt_id)").count() == 0
