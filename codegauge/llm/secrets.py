"""Secret scans: fixed patterns, and character Markov models for what has no pattern.

Everything is built-in column expressions.  ``fit`` counts character pairs of labelled
strings: random ones (values found by the patterns, and one digest of each document in
base 64 as a sample of random text) against ordinary identifiers (long words of the
documents, and words in a row written as a path, in snake case and in camel case).  All documents count; pairs are summed before the shuffle, and the model is
a table of the squared alphabet, whatever the size of the corpus.  ``find`` adds every
run of the alphabet whose mean log-likelihood ratio per pair reaches the threshold and
which no pattern has covered.

Spans are (start, kind number, end): code points, end exclusive, sorted by start, then
kind in the order of ``KINDS``.  Defined results: a null text counts as empty and has no
spans; rows are scanned one by one, so repeated rows repeat their spans; with nothing to
fit on every ratio is 0 and the models add nothing; an empty table gives an empty table.
What is added starts with ``__k_``; ``redact`` takes columns of any name.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE_CHARS = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # runs are taken whole, so 18 or more in all
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}"
IDENTIFIER = r"[A-Za-z_-]{10,}"
#: Words in a row, from which identifiers of programs are made.
WORDS = r"[A-Za-z]{2,}(?: [A-Za-z]{2,}){2,4}"
PLACEHOLDER = "[SECRET]"

_SPANS = "array<struct<start:int,kind:int,end:int>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, begin: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """(state, out) after all items; ``step`` gives the next state and an array of results.

    An array that grows item by item is copied each time.  Here results grow within blocks
    of the square root of all items, and blocks are joined in the end.
    """
    empty = F.array().cast(kind)

    def one(acc: Column, item: Column) -> Column:
        state, out = step(acc["state"], item)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def many(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["state"].alias("state"), empty.alias("out")), one)
        return _let(done, lambda d: F.struct(d["state"].alias("state"), F.array_append(acc["out"], d["out"]).alias("out")))

    def whole(items: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(items)))).cast("int")
        starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / width).cast("int"))).otherwise(F.array().cast("array<int>"))
        blocks = F.transform(starts, lambda b: F.slice(items, b * width + 1, width))
        first = F.struct(begin.alias("state"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(blocks, first, many, lambda acc: F.struct(acc["state"].alias("state"), F.flatten(acc["out"]).alias("out")))

    return _let(items, whole)


def _locate(df: DataFrame, pattern: str, kind: str, out: str, value_chars: int = 0, accept: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add the spans of a pattern as column ``out``; ``accept`` judges a match by its text.

    Places come from what lies between the matches: the split at the pattern.
    """
    df = df.withColumn("__k_found", F.regexp_extract_all("__k_text", F.lit(pattern), F.lit(0)))
    some = F.size("__k_found") > 0
    gaps = F.transform(F.split("__k_text", pattern, -1), lambda x: F.length(x))
    value = F.regexp_extract_all("__k_text", F.lit(pattern), F.lit(2)) if value_chars else F.col("__k_found")
    parts = F.zip_with(
        F.zip_with(gaps, F.col("__k_found"), lambda gap, m: F.struct(gap.alias("gap"), F.length(m).alias("len"))),
        value,
        lambda p, v: F.struct(p["gap"].alias("gap"), p["len"].alias("len"), (accept(v) if accept else F.length(v) >= value_chars).alias("ok")),
    )

    def step(at: Column, part: Column) -> tuple[Column, Column]:
        begin = at + part["gap"]
        end = begin + F.coalesce(part["len"], F.lit(0))
        span = F.struct(begin.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"))
        keep = part["len"].isNotNull() & part["ok"]
        return end, F.when(keep, F.array(span)).otherwise(F.array().cast(_SPANS))

    spans = _scan(parts, F.lit(0), step, _SPANS)["out"]
    return df.withColumn(out, F.when(some, spans).otherwise(F.array().cast(_SPANS))).drop("__k_found")


def base_spans(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``__k_text`` (null: empty) and ``__k_base``, the spans of the fixed patterns."""
    df = df.withColumn("__k_text", F.coalesce(F.col(text_col), F.lit("")))
    df = _locate(df, ASSIGN, "assign", "__k_assign", ASSIGN_VALUE_CHARS)
    df = _locate(df, ACCESS, "access", "__k_access")
    df = _locate(df, HEX, "hex", "__k_hex")
    return df.withColumn("__k_base", F.array_sort(F.concat("__k_assign", "__k_access", "__k_hex"))).drop("__k_assign", "__k_access", "__k_hex")


def labelled_samples(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(token, random, n): strings with their label, counted once per different string."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    access = F.regexp_extract_all(text, F.lit(ACCESS), F.lit(0))
    values = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= ASSIGN_VALUE_CHARS)
    digest = F.array(F.rtrim(F.base64(F.unhex(F.sha2(text, 256))), F.lit("=")))
    words = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    # letters of a base span are no identifiers: they hold digits, or stand in upper case
    words = F.filter(words, lambda w: ~w.rlike("^[A-Z]+$"))
    # names as programs write them, of one place of each document: a path, snake and camel case
    row = F.regexp_extract(text, WORDS, 0)
    named = F.array(F.replace(row, F.lit(" "), F.lit("/")), F.replace(row, F.lit(" "), F.lit("_")), F.replace(F.initcap(row), F.lit(" "), F.lit("")))
    words = F.concat(words, F.filter(named, lambda w: F.length(w) > 0))
    rows = df.select(F.explode(F.array(F.struct(F.lit(1).alias("random"), F.concat(access, values, digest).alias("tokens")), F.struct(F.lit(0).alias("random"), words.alias("tokens")))).alias("s"))
    rows = rows.select("s.random", F.explode("s.tokens").alias("token"))
    return rows.groupBy("random", "token").agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratio (random against ordinary) of each pair of alphabet places.

    Place 0 is any character outside the alphabet.
    """

    ratios: tuple[float, ...]
    threshold: float = 0.7
    size: int = len(ALPHABET) + 1

    def mean_ratio(self, token: Column) -> Column:
        table = F.lit(list(self.ratios))
        places = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))
        pairs = F.zip_with(F.slice(places, F.lit(1), F.length(token) - 1), F.slice(places, F.lit(2), F.length(token) - 1), lambda a, b: F.element_at(table, (a * self.size + b + 1).cast("int")))
        total = F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
        return F.when(F.length(token) > 1, total / (F.length(token) - 1)).otherwise(F.lit(0.0))


def fit(samples: DataFrame, smoothing: float = 0.5) -> MarkovModel:
    """Count pairs of (token, random, n) and turn them into log ratios.

    Only the summed pair table reaches the driver: two labels times the squared
    alphabet at most.
    """
    size = len(ALPHABET) + 1
    place = lambda at: F.instr(F.lit(ALPHABET), F.substring(F.col("token"), at, F.lit(1)))
    at = samples.where(F.length("token") > 1).select("random", "token", "n", F.explode(F.sequence(F.lit(1), F.length("token") - 1)).alias("at"))
    pairs = at.select("random", "n", place(F.col("at")).alias("a"), place(F.col("at") + 1).alias("b")).groupBy("random", "a", "b").agg(F.sum("n").alias("n"))
    counts = {(r["random"], r["a"], r["b"]): r["n"] for r in pairs.collect()}
    if not counts:
        return MarkovModel((0.0,) * (size * size))

    def logs(label: int) -> list[float]:
        out = []
        for a in range(size):
            row = [counts.get((label, a, b), 0) + smoothing for b in range(size)]
            total = sum(row)
            out += [math.log(x / total) for x in row]
        return out

    return MarkovModel(tuple(r - o for r, o in zip(logs(1), logs(0))))


def _untouched(candidates: Column, base: Column) -> Column:
    """Candidates that no base span overlaps, by one scan in either direction."""
    events = F.array_sort(F.concat(base, candidates))  # of equal starts base spans come first
    is_base = lambda e: e["kind"] < KINDS.index("markov")
    none = F.array().cast(_SPANS)

    def before(reached: Column, e: Column) -> tuple[Column, Column]:
        return F.when(is_base(e), F.greatest(reached, e["end"])).otherwise(reached), F.when(is_base(e) | (reached <= e["start"]), F.array(e)).otherwise(none)

    def behind(next_start: Column, e: Column) -> tuple[Column, Column]:
        return F.when(is_base(e), e["start"]).otherwise(next_start), F.when(~is_base(e) & (next_start >= e["end"]), F.array(e)).otherwise(none)

    left = _scan(events, F.lit(0), before, _SPANS)["out"]
    return F.reverse(_scan(F.reverse(left), F.lit((1 << 31) - 1), behind, _SPANS)["out"])


def find(df: DataFrame, model: MarkovModel, text_col: str = "text") -> DataFrame:
    """The input with ``__k_text``, ``__k_base`` and ``__k_spans`` (base and added spans)."""
    df = base_spans(df, text_col)
    # the last part of a split has no match and no text
    random = lambda token: F.coalesce(model.mean_ratio(token) >= model.threshold, F.lit(False))
    df = _locate(df, CANDIDATE, "markov", "__k_candidates", accept=random)
    both = F.size("__k_base") * F.size("__k_candidates") > 0
    free = F.when(both, _untouched(F.col("__k_candidates"), F.col("__k_base"))).otherwise(F.col("__k_candidates"))
    return df.withColumn("__k_spans", F.array_sort(F.concat("__k_base", free))).drop("__k_candidates")


def as_text(spans: str) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def redact(df: DataFrame, model: MarkovModel, text_col: str = "text") -> DataFrame:
    """Replace every span (overlapping ones together) by a placeholder; null stays null.

    Other columns are untouched.
    """
    columns = df.columns
    found = find(df.select(F.struct("*").alias("row"), F.col(text_col).alias("text")), model)

    def replaced(chars: Column) -> Column:
        """From an array of characters: a place in a long text is not found by counting to it."""
        part = lambda a, n: F.array_join(F.slice(chars, a + 1, n), "")

        def step(at: Column, s: Column) -> tuple[Column, Column]:
            fresh = F.when(s["start"] >= at, F.array(part(at, s["start"] - at), F.lit(PLACEHOLDER))).otherwise(F.array().cast("array<string>"))
            return F.greatest(at, s["end"]), fresh

        done = _scan(F.col("__k_spans"), F.lit(0), step, "array<string>")
        return _let(done, lambda d: F.concat(F.array_join(d["out"], ""), part(d["state"], F.size(chars) - d["state"])))

    clean = _let(F.split("__k_text", ""), replaced)
    clean = F.when(F.size("__k_spans") > 0, clean).otherwise(F.col("text"))
    return found.select(*[clean.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in columns])
