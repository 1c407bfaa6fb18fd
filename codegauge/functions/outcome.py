"""Outcomes printed by test scripts, pass rates and rewards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge.functions.text import last_line, let


# What prepared tests print: a list of JSON booleans, or one of two objects.
BOOLEAN_LIST = (
    r"^\[[ \t\r]*+(?:true|false)[ \t\r]*+(?:,[ \t\r]*+(?:true|false)[ \t\r]*+)*+\]$"
)
PASSED_OBJECT = '{"passed": true}'
FAILED_OBJECT = '{"passed": false}'
# One pair of brackets and no quotes: nothing can follow the list.
FLAT_LIST = r"^[ \t\r]*+\[[^\[\]\"]*+\][ \t\r]*+$"
JSON_START = r"^[ \t\r]*+[\[{\"\-0-9tfn]"


def _as_list(value: Column) -> Column:
    return value.try_cast("array<variant>")


def _only_value(line: Column) -> Column:
    """A line as a variant; null if it is not exactly one JSON value.

    ``try_parse_json`` ignores text after the first value, so the line is parsed
    as the only element of a list.  Left-over text that closes that list early
    must start with ``]``; such a line cannot also close an object.
    """
    wrapped = _as_list(F.try_parse_json(F.concat(F.lit("["), line, F.lit("]"))))
    as_field = F.try_parse_json(F.concat(F.lit('{"v":'), line, F.lit("}")))
    whole = ~line.contains("]") | line.rlike(FLAT_LIST) | as_field.isNotNull()
    only = let(wrapped, lambda w: F.when(F.size(w) == 1, F.try_element_at(w, F.lit(1))))
    return F.when(line.rlike(JSON_START) & whole, only)


def last_json(stdout: Column) -> Column:
    """Last printed line as a variant; null if empty or not one JSON value."""
    return let(last_line(stdout), _only_value)


def _truthy_text(json: Column) -> Column:
    """Python truth value of a JSON value in compact text form."""
    number = json.rlike("^-?[0-9]")
    return F.when(json.isin("false", "null", '""', "[]", "{}"), False).when(
        number, json.try_cast("double") != 0
    ).otherwise(json.isNotNull())


def truthy(value: Column) -> Column:
    """Python truth value of one JSON value held in a variant; null is false."""
    return let(F.to_json(value), _truthy_text)


def parse_outcome(stdout: Column) -> Column:
    """``struct<kind, results, passed>`` of what a script printed last.

    ``kind`` is ``list``, ``object``, ``other`` (valid JSON of another type) or
    ``invalid``.  ``results`` holds the truth values of a list.  ``passed`` is
    set for objects only: the truth of the key ``passed``, false if absent.
    """

    def outcome(kind: Column | str, results: Column | None = None, passed: Column | bool | None = None):
        return F.struct(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
            (F.lit(None) if results is None else results).cast("array<boolean>").alias("results"),
            (passed if isinstance(passed, Column) else F.lit(passed)).cast("boolean").alias("passed"),
        )

    def any_json(line: Column, value: Column) -> Column:
        texts = F.transform(_as_list(value), lambda item: F.to_json(item))
        found = truthy(F.try_variant_get(value, "$.passed", "variant"))
        return (
            F.when(value.isNull(), outcome("invalid"))
            .when(line.rlike(r"^[ \t\r]*+\["), outcome("list", F.transform(texts, _truthy_text)))
            .when(line.rlike(r"^[ \t\r]*+\{"), outcome("object", passed=found))
            .otherwise(outcome("other"))
        )

    def last(line: Column) -> Column:
        words = F.split(F.translate(line, "[] \t\r", ""), ",")
        return (
            F.when(line.rlike(BOOLEAN_LIST), outcome("list", F.transform(words, lambda w: w == "true")))
            .when(line == PASSED_OBJECT, outcome("object", passed=True))
            .when(line == FAILED_OBJECT, outcome("object", passed=False))
            .otherwise(let(_only_value(line), lambda value: any_json(line, value)))
        )

    return let(last_line(stdout), last)


def count_true(results: Column) -> Column:
    return F.size(F.filter(results, lambda r: r))


def pass_rate(results: Column, empty: float = 0.0) -> Column:
    """Share of true results; ``empty`` for an empty list, null for null."""
    return F.when(F.size(results) == 0, F.lit(empty)).when(
        results.isNotNull(), count_true(results) / F.size(results)
    )


def all_passed(results: Column, empty_is_pass: bool = True) -> Column:
    """Every test true.  An empty list counts as ``empty_is_pass``."""
    passed = F.forall(results, lambda r: r)
    return passed if empty_is_pass else passed & (F.size(results) > 0)


def task_passed(outcome: Column, empty_is_pass: bool = True) -> Column:
    """Task verdict: a list needs all true, an object its ``passed`` key."""
    return F.coalesce(
        F.when(outcome["kind"] == "list", all_passed(outcome["results"], empty_is_pass))
        .when(outcome["kind"] == "object", outcome["passed"]),
        F.lit(False),
    )


def task_pass_rate(outcome: Column) -> Column:
    """Pass rate of a list outcome; null for objects and anything else."""
    return F.when(outcome["kind"] == "list", pass_rate(outcome["results"]))


def reward(code: Column, failed: Column, outcome: Column, binary: bool = False) -> Column:
    """Reward of one completion.

    Zero without code, without an execution, on a failed one, or when the
    outcome is not a list; else the pass rate, or 1.0 only for a full pass
    in binary mode.
    """
    rate = pass_rate(outcome["results"])
    value = F.when(rate == 1.0, 1.0).otherwise(0.0) if binary else rate
    usable = code.isNotNull() & ~F.coalesce(failed, F.lit(True)) & (outcome["kind"] == "list")
    return F.when(usable, value).otherwise(F.lit(0.0))


def combine_rewards(rewards: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of several reward columns (weight 1.0 if not given)."""
    weights = weights or {}
    unknown = set(weights) - set(rewards)
    if unknown:
        raise ValueError(f"weights without a reward: {sorted(unknown)}")
    total = F.lit(0.0)
    for name, value in rewards.items():
        total = total + value * F.lit(float(weights.get(name, 1.0)))
    return total
