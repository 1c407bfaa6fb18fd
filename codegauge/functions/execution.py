"""Status of script executions: error class, exit code, success."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge import fixed_values as V


def error_class_of_message(kind: Column, message: Column) -> Column:
    """Error class from what the fast engine raised.

    ``kind`` is ``runtime``, ``not_implemented``, ``syntax`` or anything else;
    null means no error.
    """
    return (
        F.when(kind.isNull(), F.lit(None).cast("string"))
        .when((kind == "runtime") & message.contains("TimeoutError"), "timeout")
        .when((kind == "runtime") & message.contains("MemoryError"), "memory")
        .when(kind == "runtime", "runtime")
        .when(kind == "not_implemented", "not_supported")
        .when(kind == "syntax", "syntax")
        .otherwise("error")
    )


def error_class_of_exit(exit_code: Column) -> Column:
    return (
        F.when(exit_code == V.EXIT_OK, F.lit(None).cast("string"))
        .when(exit_code == V.EXIT_TIMEOUT, "timeout")
        .when(exit_code == V.EXIT_MEMORY, "memory")
        .otherwise("runtime")
    )


def exit_code_of(error_class: Column) -> Column:
    return (
        F.when(error_class.isNull(), V.EXIT_OK)
        .when(error_class == "timeout", V.EXIT_TIMEOUT)
        .when(error_class == "memory", V.EXIT_MEMORY)
        .otherwise(V.EXIT_ERROR)
    )


def error_message_of_exit(exit_code: Column, stderr: Column, limit_sec: Column) -> Column:
    """Message the container engine reports for an exit code; null if it is 0."""
    return (
        F.when(exit_code == V.EXIT_OK, F.lit(None).cast("string"))
        .when(
            exit_code == V.EXIT_TIMEOUT,
            F.concat(
                F.lit("Execution timed out after "), limit_sec.cast("string"), F.lit(" seconds")
            ),
        )
        .when(exit_code == V.EXIT_MEMORY, "Memory limit exceeded (OOM)")
        .otherwise(
            F.concat(
                F.lit("Execution failed with exit code "),
                exit_code.cast("string"),
                F.lit(": "),
                F.coalesce(stderr, F.lit("")),
            )
        )
    )


def timed_out(exit_code: Column) -> Column:
    return exit_code == V.EXIT_TIMEOUT


def memory_limit_hit(exit_code: Column) -> Column:
    return exit_code == V.EXIT_MEMORY


def valid_python_by_stderr(stderr: Column) -> Column:
    return ~F.coalesce(stderr.contains("SyntaxError"), F.lit(False))


def duration_seconds(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)


def succeeded(
    exit_code: Column,
    is_valid_python: Column,
    errors: Column | None = None,
    timeout: Column | None = None,
    memory: Column | None = None,
) -> Column:
    """Exit code 0, valid Python, no limit hit, no errors."""
    ok = (exit_code == V.EXIT_OK) & is_valid_python
    if timeout is not None:
        ok = ok & ~timeout
    if memory is not None:
        ok = ok & ~memory
    if errors is not None:
        ok = ok & (F.coalesce(F.size(errors), F.lit(0)) <= 0)
    return F.coalesce(ok, F.lit(False))


def joined_messages(errors: Column) -> Column:
    """Messages of all errors, separated by a full stop and a blank."""
    return F.coalesce(
        F.array_join(F.transform(errors, lambda e: e["message"]), ". "), F.lit("")
    )


def throughput(tokens: Column, seconds: Column) -> Column:
    """Tokens per second, 0 if no time was taken."""
    return F.when(seconds > 0, tokens / seconds).otherwise(F.lit(0.0))


def utc_stamp(ts: Column) -> Column:
    """``2024-01-31T05-06-07Z``; needs a session in UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss'Z'")


def run_name(model_id: Column, ts: Column) -> Column:
    return F.concat(model_id, F.lit("_"), utc_stamp(ts))


def is_binary(content: Column) -> Column:
    """A zero byte among the first 1,024 bytes."""
    head = F.substring(content, 1, V.BINARY_SNIFF_BYTES)
    return F.coalesce(F.locate("\0", F.decode(head, "ISO-8859-1")) > 0, F.lit(False))
