"""Fan scripts out to a caller's runner and merge the results.

The engine ships no runner.  A runner is a picklable function
``runner(script, limits) -> dict`` with any of ``stdout``, ``stderr``,
``exit_code``, ``is_valid_python``, ``error_class``, ``message``, ``traceback``,
``result``.  Columns named as a script's inputs (environment, files, dependencies,
named values) reach it as ``limits["inputs"]``, a dict read from JSON; binary columns
are base 64 there.  It must be safe to call again for the same script, because tasks of
lost executors run again.  With ``isolate`` each task runs its scripts in a child process
whose memory and time are limited by force (``operators.isolation``); without it the
memory limit is only handed to the runner.  Files and network are the runner's duty.
"""

from __future__ import annotations

import datetime
import json
import signal
import time
import traceback
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.functions import execution as X
from codegauge.operators.isolation import Slot
from codegauge.operators.joins import skew_join
from codegauge.operators.triage import triage
from codegauge.schemas import EXECUTION
from codegauge.storage import stage

Runner = Callable[[str, dict], dict]

HASH = "script_hash"
INPUTS = "script_inputs"

_ERROR = pa.struct([
    ("error_class", pa.string()), ("message", pa.string()), ("traceback", pa.string()),
])
_ARROW_SCHEMA = pa.schema([
    (HASH, pa.string()),
    ("sandbox_type", pa.string()),
    ("stdout", pa.string()),
    ("stderr", pa.string()),
    ("errors", pa.list_(_ERROR)),
    ("is_valid_python", pa.bool_()),
    ("exit_code", pa.int32()),
    ("start_time", pa.timestamp("us", tz="UTC")),
    ("end_time", pa.timestamp("us", tz="UTC")),
    ("duration_sec", pa.float64()),
    ("timed_out", pa.bool_()),
    ("memory_limit_hit", pa.bool_()),
    ("result", pa.string()),
])
_SPARK_SCHEMA = f"{HASH} string, " + ", ".join(
    f"{f.name} {f.dataType.simpleString()}" for f in EXECUTION.fields
)

#: Limits of a run unless the call sets others; None switches one off.
DEFAULT_LIMITS = {"max_duration_sec": 10.0, "max_memory_mb": 64}

_EXIT_CODES = {None: V.EXIT_OK, "timeout": V.EXIT_TIMEOUT, "memory": V.EXIT_MEMORY}


class _Alarm:
    """Raises TimeoutError after the limit, and again if a script swallows it."""

    def __init__(self, seconds: float | None):
        self.seconds = seconds
        self.armed = False

    def _ring(self, signum, frame):
        if self.armed:
            raise TimeoutError("Execution timed out")

    def __enter__(self):
        if self.seconds:
            signal.signal(signal.SIGALRM, self._ring)
            self.armed = True
            signal.setitimer(signal.ITIMER_REAL, self.seconds, max(0.05, self.seconds / 20))

    def __exit__(self, *_):
        self.armed = False
        if self.seconds:
            signal.setitimer(signal.ITIMER_REAL, 0)


def _exit_outcome(error: SystemExit) -> dict:
    """``sys.exit(n)`` ends a script, with exit code n; a text is printed, code 1."""
    if error.code is None or isinstance(error.code, int):
        code, text = error.code or 0, ""
    else:
        code, text = 1, str(error.code)
    failed = {"error_class": "runtime", "message": f"exit code {code}", "traceback": traceback.format_exc()} if code else {}
    return {"exit_code": code, "stderr": text, **failed}


def _call(runner: Runner, script: str, limits: dict) -> dict:
    """Run one script; whatever it raises becomes part of the result."""
    try:
        with _Alarm(limits.get("max_duration_sec")):
            return dict(runner(script, limits))
    except SystemExit as e:
        return _exit_outcome(e)
    except TimeoutError as e:
        found = "timeout", e
    except MemoryError as e:
        found = "memory", e
    except SyntaxError as e:
        found = "syntax", e
    except NotImplementedError as e:
        found = "not_supported", e
    except BaseException as e:  # one script never ends the batch
        found = "runtime", e
    error_class, error = found
    return {
        "error_class": error_class,
        "message": str(error),
        "traceback": traceback.format_exc(),
        "is_valid_python": error_class != "syntax",
    }


def _execution_row(script_hash: str, script: str, engine: str, call: Runner, limits: dict) -> dict:
    started = datetime.datetime.now(datetime.timezone.utc)
    clock = time.perf_counter()
    outcome = call(script, limits)
    seconds = time.perf_counter() - clock
    error_class = outcome.get("error_class")
    exit_code = outcome.get("exit_code")
    if exit_code is None:
        exit_code = _EXIT_CODES.get(error_class, V.EXIT_ERROR)
    errors = []
    if error_class is not None:
        errors = [{k: outcome.get(k) for k in ("error_class", "message", "traceback")}]
    return {
        HASH: script_hash,
        "sandbox_type": engine,
        "stdout": (outcome.get("stdout") or "").strip(),
        "stderr": (outcome.get("stderr") or "").strip(),
        "errors": errors,
        "is_valid_python": bool(outcome.get("is_valid_python", True)),
        "exit_code": int(exit_code),
        "start_time": started,
        "end_time": started + datetime.timedelta(seconds=seconds),
        "duration_sec": seconds,
        "timed_out": exit_code == V.EXIT_TIMEOUT,
        "memory_limit_hit": exit_code == V.EXIT_MEMORY,
        "result": outcome.get("result"),
    }


def _run_distinct(scripts: DataFrame, runner: Runner, engine: str, limits: dict, partitions: int, isolate: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = lambda script, limits: _call(runner, script, limits)
        slot = Slot(call, limits.get("max_memory_mb")) if isolate else None
        try:
            for batch in batches:
                rows = [
                    _execution_row(h, s, engine, slot.run if slot else call, limits | ({"inputs": json.loads(i)} if i else {}))
                    for h, s, i in zip(*(batch.column(k).to_pylist() for k in range(3)))
                ]
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW_SCHEMA)
        finally:
            if slot:
                slot.stop()

    # script costs differ by orders of magnitude: many small tasks, spread by hash
    return (
        scripts.select(HASH, "script", INPUTS)
        .repartition(partitions, HASH)
        .mapInArrow(run, _SPARK_SCHEMA)
    )


def _inputs(input_columns: Sequence[str]) -> Column:
    """A row's inputs as JSON; null if it has no such columns."""
    return F.to_json(F.struct(*input_columns)) if input_columns else F.lit(None).cast("string")


def _hash(script_column: str, input_columns: Sequence[str]) -> Column:
    """Scripts are equal if their text and their inputs are."""
    script = F.col(script_column)
    if not input_columns:
        return F.sha2(script, 256)
    return F.sha2(F.concat(F.sha2(script, 256), _inputs(input_columns)), 256)


def distinct_scripts(df: DataFrame, script_column: str, input_columns: Sequence[str] = ()) -> DataFrame:
    """Each script with its inputs once; copies are dropped before the shuffle."""
    script = F.col(script_column)
    return (
        df.where(script.isNotNull())
        .select(_hash(script_column, input_columns).alias(HASH), script.alias("script"), _inputs(input_columns).alias(INPUTS))
        .distinct()
    )


def _partitions(df: DataFrame, partitions: int | None) -> int:
    return partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def to_rows(
    df: DataFrame, executions: DataFrame, row_key: str, script_column: str, attach: bool, input_columns: Sequence[str] = ()
) -> DataFrame:
    """Executions of distinct scripts back on the rows that asked for them.

    One script may belong to any share of the rows.  With ``attach`` the execution
    columns come beside all columns of ``df`` and are null on rows without a
    script, so scoring needs no further join.  Without it the result has the row
    key and the execution, for rows with a script.
    """
    script_hash = _hash(script_column, input_columns).alias(HASH)
    if attach:
        return skew_join(df.select("*", script_hash), executions, [HASH], "left", [row_key]).drop(HASH)
    asked = df.where(F.col(script_column).isNotNull()).select(row_key, script_hash)
    return skew_join(asked, executions, [HASH], "inner", [row_key]).drop(HASH)


def execute_scripts(
    df: DataFrame,
    row_key: str,
    script_column: str,
    runner: Runner,
    engine: str = V.CONTAINER_ENGINE,
    limits: dict | None = None,
    partitions: int | None = None,
    attach: bool = False,
    input_columns: Sequence[str] = (),
    isolate: bool = False,
) -> DataFrame:
    """One execution per row with a script; scripts with equal text and inputs run once.

    ``df`` is read three times (scripts, hash counts, rows): pass a stored table.
    """
    runs = _run_distinct(
        distinct_scripts(df, script_column, input_columns), runner, engine, DEFAULT_LIMITS | (limits or {}), _partitions(df, partitions), isolate
    )
    return to_rows(df, runs, row_key, script_column, attach, input_columns)


def is_fallback_candidate() -> Column:
    """Fast-engine run that failed although the script is valid Python."""
    ok = X.succeeded(
        F.col("exit_code"),
        F.col("is_valid_python"),
        F.col("errors"),
        F.col("timed_out"),
        F.col("memory_limit_hit"),
    )
    return (F.col("sandbox_type") == V.FAST_ENGINE) & ~ok & F.col("is_valid_python")


def merge_fallback(first: DataFrame, retry: DataFrame, key: str) -> DataFrame:
    """Retry results over first results, row by row; both have unique keys."""
    columns = [c for c in first.columns if c != key]
    second = retry.select(key, F.struct(*columns).alias("__retry"))
    chosen = F.coalesce("__retry", F.struct(*columns))
    return (
        first.join(second, key, "left")
        .select(key, chosen.alias("__row"))
        .select(key, *[F.col(f"__row.{c}").alias(c) for c in columns])
    )


def execute_with_fallback(
    df: DataFrame,
    row_key: str,
    script_column: str,
    fast_runner: Runner,
    container_runner: Runner,
    limits: dict | None = None,
    skip_compatibility_check: bool = False,
    partitions: int | None = None,
    attach: bool = False,
    input_columns: Sequence[str] = (),
    isolate: bool = False,
) -> DataFrame:
    """Fast engine where it can run a script, container elsewhere, then retries.

    Fast-engine failures on valid Python run again in the container.  Everything
    happens once per distinct script.  Input scripts and first results are kept as
    tables in the shared folder, because several steps read them.
    """
    limits = DEFAULT_LIMITS | (limits or {})
    partitions = _partitions(df, partitions)
    df = stage(df if attach else df.select(row_key, script_column, *input_columns), "asked")
    scripts = distinct_scripts(df, script_column, input_columns)
    if skip_compatibility_check:
        scripts = stage(scripts, "scripts")
        first = _run_distinct(scripts, fast_runner, V.FAST_ENGINE, limits, partitions, isolate)
    else:
        scripts = stage(triage(scripts, "script").select(HASH, "script", INPUTS, "is_compatible"), "scripts")
        fast = _run_distinct(
            scripts.where("is_compatible"), fast_runner, V.FAST_ENGINE, limits, partitions, isolate
        )
        slow = _run_distinct(
            scripts.where(~F.col("is_compatible")),
            container_runner,
            V.CONTAINER_ENGINE,
            limits,
            partitions,
            isolate,
        )
        first = fast.unionByName(slow)
    first = stage(first, "executions")
    candidates = first.where(is_fallback_candidate()).select(HASH).join(scripts, HASH)
    retry = _run_distinct(candidates, container_runner, V.CONTAINER_ENGINE, limits, partitions, isolate)
    merged = stage(merge_fallback(first, retry, HASH), "merged")  # retries run once
    return to_rows(df, merged, row_key, script_column, attach, input_columns)
