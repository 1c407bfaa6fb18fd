"""Values that must be equal for results to be equal: texts, names, limits.

Nothing here is logic.  Markers in braces are filled by
``functions.scripts.render``; ``{solution}`` stays in prepared tests and is
filled when a completion is scored.
"""

# Characters that Python's ``str.strip`` and the regex class ``\s`` remove.
PYTHON_WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- prompts -----------------------------------------------------------------

COMPLETE_FUNCTION_PREFIX = (
    "You are given the beginning of a Python function below. "
    "Please complete the function.\n\n```python"
)

CODING_INSTRUCTIONS = """\
When writing your code, use only standard Python with no external libraries or
built-in modules except for `asyncio.gather`, `dataclasses`, `datetime`, `json`, `math`, `os`, `re`, `sys`, or `typing` if needed.

Name the function `{function_name}`.

Provide your answer in a Python code block like this:
```python
# Your code here
```"""

# --- test scripts (each prints its outcome as JSON on the last line) ----------

PASS_FAIL_SCRIPT = """\
# Task ID: {task_id}
import json

{solution}

{test_cases}

try:
    check({entry_point})
    print(json.dumps({"passed": True}))
except AssertionError:
    print(json.dumps({"passed": False}))"""

RESULT_LIST_SCRIPT = """\
# Task ID: {task_id}
import json

{solution}

{test_cases}

print(json.dumps(__test_results))"""

SHORT_TEST_SCRIPT = """\
# Task ID: {task_id}
import json
{other_imports}

{solution}

results = {test_cases}
print(json.dumps(results))"""

TRAINING_TEST_SCRIPT = """
import json
results = {test_cases}
print(json.dumps(results))"""

# --- rewriting an asserting test into a result-collecting one -----------------
# (find, replace) applied in this order; the last one is a pattern.

CHECK_BY_TRUTH_BEFORE = """
def assertion(out, exp, atol):
    if isinstance(out, bool):
        exact_match = out == exp
    else:
        exact_match = exp == (out is not None)
"""
CHECK_BY_TRUTH_AFTER = """
def __check(out, exp, atol):
    if isinstance(out, bool):
        exact_match = out == exp
    else:
        exact_match = exp == (out is not None)
    return exact_match
"""
TEST_REWRITES = [
    (CHECK_BY_TRUTH_BEFORE, CHECK_BY_TRUTH_AFTER),
    ("def assertion(out, exp, atol):", "def __check(out, exp, atol):"),
    (
        "assert np.allclose(out, exp, rtol=1e-07, atol=atol)",
        "return np.allclose(out, exp, rtol=1e-07, atol=atol)",
    ),
    ('assert out == exp, f"out: {out}, exp: {exp}"', "return out == exp"),
    (
        "for i, inp in enumerate(inputs):",
        "__test_results = []\nfor i, inp in enumerate(inputs):",
    ),
    (
        "for i, (inp, exp) in enumerate(zip(inputs, results)):",
        "__test_results = []\nfor i, (inp, exp) in enumerate(zip(inputs, results)):",
    ),
]
ASSERTION_CALL_PATTERN = r"assertion\((.*)\)"
ASSERTION_CALL_REPLACEMENT = "__test_results.append(__check($1))"

# --- known-bad benchmark tasks -------------------------------------------------

BENCHMARK_A_REPAIRS = [
    ("HumanEval/32", "_poly(*candidate(*inp), inp)", "_poly(*inp, candidate(*inp))"),
]
BENCHMARK_A_EXCLUDED = ["HumanEval/32"]
BENCHMARK_B_EXCLUDED = ["255", "596"]

# --- engines, limits, exit codes -----------------------------------------------

FAST_ENGINE = "monty"
CONTAINER_ENGINE = "docker"
AUTO_ENGINE = "auto"
ENGINES = [CONTAINER_ENGINE, FAST_ENGINE, AUTO_ENGINE]

FAST_ENGINE_MODULES = [
    "asyncio", "dataclasses", "datetime", "json", "math",
    "os", "pathlib", "re", "sys", "typing",
]
FAST_ENGINE_MAX_LINE = 65_535
LONG_LINE_REASON = "Code contains lines longer than 65,536 characters"

EXIT_OK = 0
EXIT_ERROR = 1
EXIT_TIMEOUT = 124
EXIT_MEMORY = 137

BINARY_SNIFF_BYTES = 1024
