"""Prompts and test scripts as column expressions."""

from __future__ import annotations

import inspect
import logging
import re
import textwrap
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from codegauge import fixed_values as V
from codegauge.functions.text import first_line, let, message_list, strip

log = logging.getLogger(__name__)

SOLUTION_MARKER = "{solution}"


def render(template: str, **values: Column) -> Column:
    """Fill the named markers of a fixed template; other braces stay."""
    if not values:
        return F.lit(template)
    markers = "|".join(re.escape("{%s}" % name) for name in values)
    parts = [
        values[part[1:-1]] if re.fullmatch(markers, part) else F.lit(part)
        for part in re.split(f"({markers})", template)
        if part
    ]
    return F.concat(*parts)


def literal_replace(text: Column, find: str, replacement: Column | str) -> Column:
    value = F.lit(replacement) if isinstance(replacement, str) else replacement
    return F.replace(text, F.lit(find), value)


# --- prompts -------------------------------------------------------------------


def completion_prompt(prompt: Column) -> Column:
    """Benchmark A: prefix, new line, start of the function (fence left open)."""
    return message_list("user", F.concat(F.lit(V.COMPLETE_FUNCTION_PREFIX + "\n"), prompt))


def instruction_text(prompt: Column, function_name: Column) -> Column:
    """Prompt, blank line, instructions; an unknown name reads ``None``."""
    name = F.coalesce(function_name, F.lit("None"))
    return F.concat(prompt, F.lit("\n\n"), render(V.CODING_INSTRUCTIONS, function_name=name))


def instruction_prompt(prompt: Column, function_name: Column) -> Column:
    """Benchmark B and training prompt."""
    return message_list("user", instruction_text(prompt, function_name))


def entry_point(test: Column, mode: str = "name") -> Column:
    """Name of the function a test calls inside ``assertion(``; null if none.

    ``mode='name'`` takes the first word that is called; ``mode='greedy'`` takes
    everything up to the last opening bracket of the line.
    """
    patterns = {
        "name": r"assertion\(([\p{L}\p{N}_]+)\(",
        "greedy": r"(?d)assertion\((.*)\(",
    }
    if mode not in patterns:
        raise ValueError(f"unknown mode: {mode!r} (use 'name' or 'greedy')")
    pattern = patterns[mode]
    return F.when(test.rlike(pattern), F.regexp_extract(test, pattern, 1))


# --- tests ---------------------------------------------------------------------


def rewrite(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Apply literal (find, replace) rules in order."""
    for find, replacement in rules:
        text = literal_replace(text, find, replacement)
    return text


def collect_results(test: Column) -> Column:
    """Turn an asserting test into one that collects results in a list."""
    return F.regexp_replace(
        rewrite(test, V.TEST_REWRITES),
        "(?d)" + V.ASSERTION_CALL_PATTERN,
        V.ASSERTION_CALL_REPLACEMENT,
    )


def pass_fail_script(task_id: Column, test: Column, function_name: Column) -> Column:
    return render(
        V.PASS_FAIL_SCRIPT, task_id=task_id, test_cases=test, entry_point=function_name
    )


def result_list_script(task_id: Column, test: Column) -> Column:
    return render(V.RESULT_LIST_SCRIPT, task_id=task_id, test_cases=test)


def boolean_tests(test_list: Column, only_asserts: bool = False) -> Column:
    """``assert x`` texts as ``bool(x)`` expressions."""
    if only_asserts:
        test_list = F.filter(test_list, lambda t: strip(t).startswith("assert"))
    return F.transform(
        test_list,
        lambda t: F.concat(F.lit("bool("), strip(literal_replace(t, "assert ", "")), F.lit(")")),
    )


def list_literal(expressions: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(expressions, ", "), F.lit("]"))


def short_test_script(task_id: Column, imports: Column, test_cases: Column) -> Column:
    return render(
        V.SHORT_TEST_SCRIPT,
        task_id=task_id,
        other_imports=F.array_join(imports, "\n"),
        test_cases=test_cases,
    )


def training_test_script(test_list: Column) -> Column:
    cases = list_literal(boolean_tests(test_list, only_asserts=True))
    return render(V.TRAINING_TEST_SCRIPT, test_cases=cases)


def fill_solution(test: Column, code: Column) -> Column:
    """Put code at the marker; a literal replace, so braces in tests survive."""
    return literal_replace(test, SOLUTION_MARKER, code)


def append_tests(code: Column, tests: Column) -> Column:
    return F.concat(code, F.lit("\n\n"), tests)


def task_id_of_script(script: Column) -> Column:
    """Task id from the first line of a script, empty if absent."""
    return F.regexp_extract(first_line(script), r"(?d)Task ID: (.*)", 1)


# --- what is put before a script -------------------------------------------------


def dependency_header(script: Column, dependencies: Column) -> Column:
    """Inline script metadata naming the packages; unchanged if there are none."""
    lines = F.transform(dependencies, lambda d: F.concat(F.lit('#   "'), d, F.lit('",\n')))
    header = F.concat(
        F.lit("# /// script\n# dependencies = [\n"),
        F.array_join(lines, ""),
        F.lit("# ]\n# ///\n\n"),
    )
    return F.when(F.size(dependencies) > 0, F.concat(header, script)).otherwise(script)


def helper_sources(functions: Iterable[Callable]) -> list[str]:
    """Source texts of helper functions; those without a source are left out."""
    sources = []
    for function in functions:
        try:
            sources.append(textwrap.dedent(inspect.getsource(function)))
        except (OSError, TypeError) as error:
            log.warning("no source for helper %r: %s", function, error)
    return sources


def with_helpers(script: Column, sources: Iterable[str]) -> Column:
    """Helper function sources before a script; unchanged if there are none."""
    sources = list(sources)
    return F.concat(F.lit("\n\n".join(sources) + "\n\n"), script) if sources else script


def container_script(script: Column, dependencies: Column, sources: Iterable[str] = ()) -> Column:
    """What the container engine runs: helpers, dependency header, script."""
    return with_helpers(dependency_header(script, dependencies), sources)


def _string_literal(text: Column) -> Column:
    """Text as a quoted JSON string, which is also a Python literal."""
    return let(
        F.to_json(F.array(text)), lambda quoted: quoted.substr(F.lit(2), F.length(quoted) - 2)
    )


def with_inputs(script: Column, inputs: Column, names: Iterable[str]) -> Column:
    """Named inputs, given as one JSON object, as assignments before a script."""
    names = list(names)
    for name in names:
        if not name.isidentifier():
            raise ValueError(f"not a variable name: {name!r}")
    if not names:
        return script

    def assignments(values: Column) -> Column:
        lines = [
            F.concat(
                F.lit(f"{name} = json.loads("),
                _string_literal(F.to_json(F.try_variant_get(values, f"$.{name}", "variant"))),
                F.lit(")\n"),
            )
            for name in names
        ]
        return F.concat(F.lit("import json\n"), *lines)

    return F.concat(let(F.try_parse_json(inputs), assignments), script)


def requires_async(script: Column) -> Column:
    """Does a line define a coroutine, or await before any quote or comment?

    Looking at one line at a time gives the same answer as looking back over
    several and keeps the match linear.
    """
    blanks = V.PYTHON_WHITESPACE.replace("\n", "")
    return script.rlike(f"(?md)^([{blanks}]*async def|[^#\"'\\n]*await)")
