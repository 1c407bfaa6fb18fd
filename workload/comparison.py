"""Tolerant comparison of values."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.functions import compare as C
from workload.views import table

LINES = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS quantity, l_extendedprice AS expected,
  l_extendedprice + CASE l_linenumber % 7 WHEN 0 THEN CAST(0 AS double) WHEN 1 THEN 1.0E-7 WHEN 2 THEN 1.0E-2
    WHEN 3 THEN 1.0E-3 WHEN 4 THEN 5.0E-7 WHEN 5 THEN CAST('nan' AS double) ELSE CAST('infinity' AS double) END AS result
FROM lineitem"""


def _lines(spark, sf_dir):
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql(LINES)


def _count(df, **flags):
    return df.groupBy("l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(v).alias(k) for k, v in flags.items()]
    )


def values_close(spark, sf_dir):
    df = _lines(spark, sf_dir)
    a, b = F.col("result"), F.col("expected")
    return _count(
        df,
        close=C.is_close(a, b),
        close_loose=C.is_close(a, b, abs_tol=0.005, rel_tol=0.0),
        close_swapped=C.is_close(b, a, abs_tol=0.0, rel_tol=1e-6),
    )


def values_correct(spark, sf_dir):
    """Tolerance for fractional expected values, equality for whole ones."""
    df = _lines(spark, sf_dir).withColumns({
        "whole": F.col("quantity"), "near": F.col("quantity") + 1e-8, "as_int": F.col("quantity").cast("int"),
        "missing": F.when(F.col("l_linenumber") % 2 == 0, F.col("expected")),
    })
    return _count(
        df,
        price_correct=C.is_correct(df, "result", "expected"),
        near_whole_correct=C.is_correct(df, "near", "whole"),
        int_correct=C.is_correct(df, "as_int", "whole"),
        missing_correct=C.is_correct(df, "missing", "expected"),
    )


def float_detect(spark, sf_dir):
    """Which numbers are not whole, as numbers, as texts and in lists."""
    df = _lines(spark, sf_dir)
    text = F.col("expected").cast("decimal(18,2)").cast("string")
    pair = F.array(text, F.col("quantity").cast("int").cast("string"))
    pair_type = T.ArrayType(T.StringType())
    return _count(
        df,
        fractional=C.is_float(F.col("expected"), T.DoubleType()),
        odd_result=C.is_float(F.col("result"), T.DoubleType()),
        fractional_text=C.is_float(text),
        all_fractional=C.is_float(pair, pair_type),
        any_fractional=C.is_float(pair, pair_type, require_all=False),
    )


def vectors_close(spark, sf_dir):
    """Whole vectors against slightly changed ones, against a scalar, and as sets."""
    df = table(spark, sf_dir, "embeddings")
    vector = F.col("embedding").cast("array<double>")
    moved = F.transform(vector, lambda v, i: F.when(i == 3, v + F.lit(1e-5) * (F.col("vec_id") % 2)).otherwise(v))
    kind = T.ArrayType(T.DoubleType())
    return df.select(
        "vec_id",
        C.is_close(vector, moved, kind, kind).alias("close"),
        C.is_close(vector, F.lit(0.0), kind, T.DoubleType(), abs_tol=0.25).alias("near_zero"),
        C.is_correct_typed(moved, vector, kind, kind).alias("correct"),
        C.is_correct_typed(F.slice(vector, 1, 5), vector, kind, kind).alias("shorter_correct"),
        C.is_correct_typed(
            C.as_set(F.reverse(vector)), C.as_set(F.concat(vector, vector)), kind, kind
        ).alias("set_correct"),
    )


def nested_correct(spark, sf_dir):
    """Lists of lists with numbers that differ by a little or a lot."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"))
    nest = lambda p: F.array(F.array(p, p * 2), F.array(p))
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    other = F.col("p") + F.when(F.col("o_orderkey") % 3 == 0, 1e-9).when(F.col("o_orderkey") % 3 == 1, 0.5).otherwise(0.0)
    correct = C.is_correct_typed(nest(other), nest(F.col("p")), kind, kind)
    return df.groupBy((F.col("o_orderkey") % 3).alias("form")).agg(
        F.count_if(correct).alias("n_correct"), F.count(F.lit(1)).alias("n")
    )


QUERIES = {
    f.__name__: f for f in (values_close, values_correct, float_detect, vectors_close, nested_correct)
}

CLOSE = """(NOT isnan({a}) AND NOT isnan({b}) AND ({a} = {b} OR
  (CASE WHEN isinf({a}) OR isinf({b}) THEN {rel} > 0
    ELSE abs({a} - {b}) <= greatest({rel} * greatest(abs({a}), abs({b})), {abs}) END)))"""


def close(a, b, abs_tol="1.0E-6", rel_tol="1.0E-7"):
    return CLOSE.format(a=a, b=b, abs=abs_tol, rel=rel_tol)


WITH_LINES = f"WITH lines AS ({LINES})"
FRACTIONAL = "({0} <> round({0}) OR isnan({0}) OR isinf({0}))"

ORACLES = {
    "values_close": f"""{WITH_LINES}
        SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE {close('result', 'expected')}) AS close,
          count(*) FILTER (WHERE {close('result', 'expected', '0.005E0', '0.0E0')}) AS close_loose,
          count(*) FILTER (WHERE {close('expected', 'result', '0.0E0', '1.0E-6')}) AS close_swapped
        FROM lines GROUP BY l_linenumber""",
    "values_correct": f"""{WITH_LINES}
        SELECT l_linenumber, count(*) AS n,
          count(*) FILTER (WHERE CASE WHEN {FRACTIONAL.format('expected')} THEN {close('result', 'expected')} ELSE result = expected END) AS price_correct,
          count(*) FILTER (WHERE quantity + 1.0E-8 = quantity) AS near_whole_correct,
          count(*) FILTER (WHERE CAST(quantity AS int) = quantity) AS int_correct,
          count(*) FILTER (WHERE l_linenumber % 2 = 0) AS missing_correct
        FROM lines GROUP BY l_linenumber""",
    "float_detect": f"""{WITH_LINES}
        SELECT l_linenumber, count(*) AS n, count(*) FILTER (WHERE expected <> round(expected)) AS fractional,
          count(*) FILTER (WHERE {FRACTIONAL.format('result')}) AS odd_result,
          count(*) FILTER (WHERE expected <> round(expected)) AS fractional_text,
          CAST(0 AS BIGINT) AS all_fractional,
          count(*) FILTER (WHERE expected <> round(expected)) AS any_fractional
        FROM lines GROUP BY l_linenumber""",
    "vectors_close": """
        SELECT vec_id, vec_id % 2 = 0 AS close,
          len(list_filter(embedding, lambda v: abs(v) > 0.25)) = 0 AS near_zero,
          vec_id % 2 = 0 AS correct, len(embedding) = 5 AS shorter_correct, true AS set_correct
        FROM embeddings""",
    "nested_correct": """
        SELECT o_orderkey % 3 AS form,
          count(*) FILTER (WHERE o_orderkey % 3 = 2 OR (o_orderkey % 3 = 0
            AND (2 * o_totalprice <> round(2 * o_totalprice) OR o_totalprice + 1.0E-9 = o_totalprice))) AS n_correct,
          count(*) AS n
        FROM orders GROUP BY o_orderkey % 3""",
}
