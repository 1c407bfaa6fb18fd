"""Quality rules: a table of thresholds compiled into one projection.

Every feature and every verdict is a built-in column expression; no user function
runs.  Defined results: a null or empty text has no words and fails the length rule;
ratios with nothing to divide by are 0; rows are judged one by one, so repeated rows
get repeated verdicts; an empty table gives an empty table.  What is added carries a
``__q_`` prefix; ``keep_good`` takes columns of any name.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "the of and to a in is that it for was on with as be by this are at from "
    "de la le et les des en un du une que pour est par dans qui avec pas sur au "
    "der die und den von zu das mit sich auf für ist im nicht dem ein eine als "
    "el y los se las del por con no su para es al lo"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep rows whose ``feature`` lies in [low, high]; None leaves a side open."""

    name: str
    feature: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.10),
    Rule("stop_words", "stop_word_ratio", 0.04, None),
    Rule("repeated_lines", "dup_line_ratio", None, 0.40),
    Rule("repeated_windows", "repeat_word_ratio", None, 0.50),
)


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def add_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the counts and ratios the rules speak of, each as a ``__q_`` column.

    Repeated windows are found by sorting a text's own windows, so a text of any
    length costs n log n and nothing is exploded or shuffled.
    """
    q = lambda name: F.col(f"__q_{name}")
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("__q_words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    # each match takes one word and looks ahead over three: overlapping windows
    windows = F.regexp_extract_all(
        F.array_join("__q_words", " "), F.lit(r"(?=([^ ]+ [^ ]+ [^ ]+))[^ ]+ "), F.lit(1)
    )
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    df = df.withColumns({"__q_windows": windows, "__q_lines": lines})
    placed = F.arrays_zip(
        q("windows").alias("w"), F.sequence(F.lit(0), F.size("__q_windows") - 1).alias("i")
    )
    repeats = F.size("__q_windows") > F.size(F.array_distinct("__q_windows"))
    df = df.withColumn("__q_sorted", F.when(repeats, F.array_sort(placed)))
    n_sorted = F.size("__q_sorted")
    neighbours = F.arrays_zip(
        F.slice("__q_sorted", F.lit(1), n_sorted - 1).alias("a"), F.slice("__q_sorted", F.lit(2), n_sorted - 1).alias("b")
    )
    equal = F.filter(neighbours, lambda p: p["a"]["w"] == p["b"]["w"])
    covered = F.flatten(F.transform(equal, lambda p: F.array(*[p[s]["i"] + k for s in "ab" for k in range(3)])))
    features = {
        "n_words": F.size("__q_words"),
        "word_chars": F.length(F.array_join("__q_words", "")),
        "n_symbols": F.length(text) - F.length(F.translate(text, SYMBOLS, "")),
        "n_lines": F.size("__q_lines"),
        "n_dup_lines": F.size("__q_lines") - F.size(F.array_distinct("__q_lines")),
        "n_repeat_words": F.when(q("sorted").isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(covered))),
        "n_stop_words": F.size(F.filter("__q_words", lambda w: F.lower(w).isin(*STOP_WORDS))),
    }
    # a verdict needs the row number too (see ``judge``), so filters on it stay above this
    # projection; below it Spark would write the features out once for each of their uses
    df = df.withColumns({f"__q_{k}": v.cast("long") for k, v in features.items()} | {"__q_row": F.monotonically_increasing_id()})
    df = df.drop("__q_words", "__q_windows", "__q_lines", "__q_sorted")
    return df.withColumns({
        "__q_mean_word_chars": _ratio("__q_word_chars", "__q_n_words"),
        "__q_symbol_ratio": _ratio("__q_n_symbols", "__q_n_words"),
        "__q_stop_word_ratio": _ratio("__q_n_stop_words", "__q_n_words"),
        "__q_dup_line_ratio": _ratio("__q_n_dup_lines", "__q_n_lines"),
        "__q_repeat_word_ratio": _ratio("__q_n_repeat_words", "__q_n_words"),
    })


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the broken rules, in table order, joined by commas."""
    broken = []
    for rule in rules:
        value = F.col(f"__q_{rule.feature}")
        tests = [value < rule.low] if rule.low is not None else []
        tests += [value > rule.high] if rule.high is not None else []
        broken.append(F.when(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(rule.name)))
    return F.concat_ws(",", *broken)


def base_failed() -> Column:
    """The fixed base test: under 50 words, or over half of the words in repeated windows."""
    return (F.col("__q_n_words") < 50) | (100 * F.col("__q_n_repeat_words") > 50 * F.col("__q_n_words"))


def judge(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's columns, the features, ``__q_base_failed``, ``__q_failed_rules`` and ``__q_kept``."""
    df = add_features(df, text_col).withColumns({"__q_base_failed": base_failed(), "__q_failed_rules": failed_rules(rules)})
    kept = ~F.col("__q_base_failed") & (F.col("__q_failed_rules") == "") & (F.col("__q_row") >= 0)
    return df.withColumn("__q_kept", kept)


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that pass, with the input's columns only."""
    rows = df.select(F.struct("*").alias("row"), F.col(text_col).alias("text"))
    return judge(rows, "text", rules).where("__q_kept").select("row.*")
