"""Fragments of checking SQL used by several queries."""

# every white-space character Python strips that the derived texts can hold
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160))"


def stripped(expr: str) -> str:
    return f"trim({expr}, {BLANKS})"


def last_line(expr: str) -> str:
    return f"list_last(string_split({stripped(expr)}, chr(10)))"


# over fx_executions: parsed outcome of each execution
PARSED = f"""
lines AS (
  SELECT *, {last_line('stdout')} AS line FROM fx_executions
), typed AS (
  SELECT *, CASE WHEN line <> '' AND json_valid(line) THEN json_type(line) END AS jtype FROM lines
), parsed AS (
  SELECT *,
    CASE WHEN jtype IS NULL THEN 'invalid' WHEN jtype = 'ARRAY' THEN 'list'
         WHEN jtype = 'OBJECT' THEN 'object' ELSE 'other' END AS kind,
    CASE WHEN jtype = 'ARRAY' THEN from_json(line, '["BOOLEAN"]') END AS results,
    CASE WHEN jtype = 'OBJECT' THEN coalesce(CAST(json_extract(line, '$.passed') AS BOOLEAN), false) END AS obj_passed,
    exit_code = 0 AND is_valid_python AS success
  FROM typed
), outcome AS (
  SELECT *,
    CAST(len(results) AS BIGINT) AS n_results,
    CAST(len(list_filter(results, lambda x: x)) AS BIGINT) AS n_true
  FROM parsed
), verdict AS (
  SELECT *,
    coalesce(CASE WHEN kind = 'list' THEN n_true = n_results WHEN kind = 'object' THEN obj_passed END, false) AS passed,
    CASE WHEN kind = 'list' THEN CASE WHEN n_results = 0 THEN 0.0 ELSE n_true / n_results END END AS pass_rate
  FROM outcome
)"""

# over fx_completions: extracted code of each completion
EXTRACTED = f"""
tiers AS (
  SELECT *,
    regexp_extract_all(completion, '(?s)```python\\s*(.*?)\\s*```', 1) AS t1,
    regexp_extract_all(completion, '(?s)```\\s*(.*?)\\s*```', 1) AS t2,
    regexp_extract_all(completion, '(?s)```(?:\\w*)?\\s*(.*)$', 1) AS t3
  FROM fx_completions
), blocks AS (
  SELECT *, len(t1) > 0 AS correct_format,
    CASE WHEN len(t1) > 0 THEN t1 WHEN len(t2) > 0 THEN t2 ELSE t3 END AS found
  FROM tiers
), extracted AS (
  SELECT *,
    {stripped("coalesce(list_filter(found, lambda x: contains(x, 'def ') OR contains(x, 'class '))[-1], found[-1])")} AS code,
    array_to_string(found, concat(chr(10), chr(10))) AS all_code
  FROM blocks
)"""
