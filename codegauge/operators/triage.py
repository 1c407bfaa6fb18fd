"""Which engine a script can run on, and which packages it needs.

One Arrow UDF parses each script and reports what it saw; every rule about it is
a Spark expression.
"""

from __future__ import annotations

import ast
import sys
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge import fixed_values as V
from codegauge.operators.joins import skew_join
from codegauge.storage import stage

_NODE = T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("modules", T.ArrayType(T.StringType())),
])
ANALYSIS = T.StructType([
    T.StructField("parse_ok", T.BooleanType()),
    T.StructField("nodes", T.ArrayType(_NODE)),
])
_ARROW_TYPE = pa.struct([
    ("parse_ok", pa.bool_()),
    ("nodes", pa.list_(pa.struct([("kind", pa.string()), ("modules", pa.list_(pa.string()))]))),
])
#: Bytes of scripts a Python worker takes at once (or one script), whatever the session says.
BATCH_BYTES = 1 << 20
_KINDS = {ast.ClassDef: "Class", ast.Match: "Match", ast.Delete: "Delete"}


def _top_level(names: list[str]) -> list[str]:
    return [name.split(".")[0] for name in names]


def describe_script(code: str | None) -> dict | None:
    """Imports, classes, ``match`` and ``del`` of one script in walk order."""
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(code)
    except Exception:  # syntax, zero bytes, too deep: the parser's limits vary
        return {"parse_ok": False, "nodes": []}
    nodes = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            nodes.append({"kind": "import", "modules": _top_level([a.name for a in node.names])})
        elif isinstance(node, ast.ImportFrom):
            if node.module:
                nodes.append({"kind": "import", "modules": _top_level([node.module])})
        elif type(node) in _KINDS:
            nodes.append({"kind": _KINDS[type(node)], "modules": []})
    return {"parse_ok": True, "nodes": nodes}


@F.arrow_udf(ANALYSIS)
def analyse_code(code: pa.Array) -> pa.Array:
    return pa.array([describe_script(c.as_py()) for c in code], _ARROW_TYPE)


def has_long_line(code: Column, limit: int = V.FAST_ENGINE_MAX_LINE) -> Column:
    lines = F.split(code, "\n")
    return (F.length(code) > limit) & F.exists(lines, lambda line: F.length(line) > limit)


def modules_of(analysis: Column) -> Column:
    """Distinct top-level modules of a script, sorted; empty if it does not parse."""
    imported = F.flatten(F.transform(analysis["nodes"], lambda n: n["modules"]))
    return F.coalesce(F.array_sort(F.array_distinct(imported)), F.array().cast("array<string>"))


def has_feature(analysis: Column, kind: str) -> Column:
    return F.exists(analysis["nodes"], lambda n: n["kind"] == kind)


def _unsupported(node: Column, allowed: Column) -> Column:
    outside = F.size(F.array_except(node["modules"], allowed)) > 0
    return F.when(node["kind"] == "import", outside).otherwise(F.lit(True))


def triage(df: DataFrame, code_column: str, allowed: list[str] | None = None) -> DataFrame:
    """Add what a script uses and whether the fast engine can run it.

    Columns: ``parse_ok, modules, has_class, has_match, has_del, is_compatible,
    reason``.  A script that does not parse counts as compatible, so the fast
    engine reports the error.  The reason is that of the first offending node.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    supported = F.lit(sorted(allowed or V.FAST_ENGINE_MODULES))
    analysis = F.col("__analysis")
    offender = F.col("__offender")
    reason = (
        F.when(F.col("__long"), V.LONG_LINE_REASON)
        .when(
            offender["kind"] == "import",
            F.concat(
                F.lit("Unsupported module(s): "),
                F.array_join(
                    F.array_sort(F.array_except(offender["modules"], supported)), ", "
                ),
            ),
        )
        .when(
            offender.isNotNull(),
            F.concat(F.lit("Unsupported feature: "), offender["kind"], F.lit(" declaration")),
        )
    )
    first_offender = F.try_element_at(
        F.filter(analysis["nodes"], lambda n: _unsupported(n, supported)), F.lit(1)
    )
    return (
        df.withColumn("__analysis", analyse_code(F.col(code_column)))
        .withColumns({
            "parse_ok": analysis["parse_ok"],
            "modules": modules_of(analysis),
            "has_class": has_feature(analysis, "Class"),
            "has_match": has_feature(analysis, "Match"),
            "has_del": has_feature(analysis, "Delete"),
            "__offender": first_offender,
            "__long": has_long_line(F.col(code_column)),
        })
        .withColumn("reason", reason)
        .withColumn("is_compatible", F.col("reason").isNull())
        .drop("__analysis", "__offender", "__long")
    )


def resolve_dependencies(
    df: DataFrame,
    row_key: str,
    module_map: DataFrame,
    stdlib: list[str] | None = None,
) -> DataFrame:
    """Add ``dependencies``: the packages of a script's non-standard modules.

    ``module_map`` has columns ``module, package``.  A module listed more than once
    means its alphabetically first package; rows with a null are ignored.  Modules
    the map does not name are their own package.  Hot modules are split; ``df``,
    usually the result of parsing, is kept as a table in the shared folder
    meanwhile, because it is read three times.
    """
    known = F.lit(sorted(stdlib or sys.stdlib_module_names))
    named = module_map.dropna(subset=["module", "package"]).groupBy("module").agg(F.min("package").alias("package"))
    df = stage(df, "modules")
    needed = df.select(row_key, F.explode(F.array_except("modules", known)).alias("module"))
    joined = skew_join(needed, named, ["module"], "left", [row_key])
    per_row = joined.groupBy(row_key).agg(
        F.array_sort(F.collect_set(F.coalesce("package", "module"))).alias("dependencies")
    )
    empty = F.array().cast("array<string>")
    return df.join(per_row, row_key, "left").withColumn(
        "dependencies", F.coalesce("dependencies", empty)
    )
