import json
import random

import pytest
from pyspark.sql import functions as F

from codegauge.functions import outcome as O


def outcomes(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, s string")
    parsed = O.parse_outcome(F.col("s"))
    rows = df.select("i", parsed.alias("o"), O.task_passed(parsed).alias("passed"),
                     O.task_passed(parsed, empty_is_pass=False).alias("strict"),
                     O.task_pass_rate(parsed).alias("rate")).collect()
    return sorted(rows, key=lambda r: r.i)


def by_python(text):
    try:
        value = json.loads((text or "").strip().split("\n")[-1])
    except ValueError:
        return "invalid", None, None
    if isinstance(value, list):
        return "list", [bool(v) for v in value], None
    if isinstance(value, dict):
        return "object", None, bool(value.get("passed", False))
    return "other", None, None


def test_random_lines_follow_python(spark):
    rng = random.Random(3)
    values = ["true", "false", "0", "1", "null", '""', '"0"', "[]", "{}", "[0]", "[null]", '{"a":1}', "0.0", "1.5",
              "1e400", "-0", "[", "]", "}", ",", " ", "\n", "x", "01", "'a'", '{"passed": true}', '{"passed": 1}',
              '{"passed": []}', '{"passed": false}', "tru", '"]"', '"}"', "1]", "1}"]
    lines = [None, "", "  \n "]
    for _ in range(6000):
        body = ", ".join(rng.choice(values) for _ in range(rng.randint(0, 4)))
        lines.append(rng.choice([f"[{body}]", f"log\n{body}", f"[{body}] ", f"{body}\r\n", f"[ {body}]]", body]))
    for line, row in zip(lines, outcomes(spark, lines)):
        assert (row.o.kind, row.o.results, row.o.passed) == by_python(line), line


def test_verdicts_and_rates(spark):
    rows = outcomes(spark, ["[]", "[true, false, true]", "[true]", '{"passed": true}', '{"other": 1}', "42", "oops"])
    assert [r.passed for r in rows] == [True, False, True, True, False, False, False]
    assert [r.strict for r in rows] == [False, False, True, True, False, False, False]
    assert [r.rate for r in rows] == [0.0, pytest.approx(2 / 3), 1.0, None, None, None, None]


@pytest.mark.parametrize("binary,want", [(False, [0.0, 2 / 3, 1.0, 0.0, 0.0, 0.0]), (True, [0.0, 0.0, 1.0, 0.0, 0.0, 0.0])])
def test_rewards(spark, binary, want):
    rows = [
        (0, None, False, "[true]"), (1, "x", False, "[true, true, false]"), (2, "x", False, "[true, true]"),
        (3, "x", True, "[true]"), (4, "x", False, '{"passed": true}'), (5, "x", None, None),
    ]
    df = spark.createDataFrame(rows, "i int, code string, failed boolean, s string")
    value = O.reward(F.col("code"), F.col("failed"), O.parse_outcome(F.col("s")), binary)
    got = [r.v for r in df.select("i", value.alias("v")).orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_combined_rewards(spark):
    total = O.combine_rewards({"a": F.lit(0.5), "b": F.lit(1.0)}, {"b": 0.25})
    assert spark.range(1).select(total.alias("t")).first().t == 0.75
