import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.functions import compare as C

INF, NAN = float("inf"), float("nan")
DOUBLES = T.ArrayType(T.DoubleType())


def one(spark, expression, **columns):
    types = {k: v[0] for k, v in columns.items()}
    schema = T.StructType([T.StructField(k, t) for k, t in types.items()])
    df = spark.createDataFrame([tuple(v[1] for v in columns.values())], schema)
    return df.select(expression(df).alias("x")).first().x


def close_by_python(a, b, abs_tol=1e-6, rel_tol=1e-7):
    if a is None or b is None:
        return a is b
    if a == b:
        return True
    return abs(a - b) <= max(rel_tol * max(abs(a), abs(b)), abs_tol)


def is_fractional(v):
    return v is not None and (math.isinf(v) or math.isnan(v) or v != math.floor(v))


def test_scalars_follow_python(spark):
    pool = [0.0, -0.0, 1.0, 1.0000001, 1.1, 2.5, 2.5000001, INF, -INF, NAN, None, 1e300, 2.0000001, 2.0, 5e-7]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in pool for b in pool)]
    df = spark.createDataFrame(pairs, "i int, a double, b double")
    rows = df.select("i", C.is_close(F.col("a"), F.col("b")).alias("close"),
                     C.is_close(F.col("a"), F.col("b"), abs_tol=0.2, rel_tol=0.0).alias("loose"),
                     C.is_correct(df, "a", "b").alias("correct")).collect()
    for row in rows:
        _, a, b = pairs[row.i]
        assert row.close == close_by_python(a, b), (a, b)
        assert row.loose == close_by_python(a, b, 0.2, 0.0), (a, b)
        exact = (a is None and b is None) or (a is not None and b is not None and a == b)
        assert row.correct == (close_by_python(a, b) if is_fractional(b) and a is not None else exact), (a, b)


def test_infinities_are_close_and_nan_is_not(spark):
    df = spark.createDataFrame([(INF, -INF, NAN)], "i double, j double, n double")
    row = df.select(C.is_close(F.col("i"), F.col("j")).alias("a"), C.is_close(F.col("n"), F.col("n")).alias("b")).first()
    assert (row.a, row.b) == (True, False)


def test_number_texts_follow_python(spark):
    rng = random.Random(1)
    pieces = ["1", "0", ".", "e", "E", "-", "+", "_", "inf", "nan", "Infinity", " ", "5", "d", "f", "x", "\xa0", "NaN"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 6))) for _ in range(6000)]
    texts += ["3.14", "1e-5", "abc", "", "1e400", "1_0.5", "1__0.5", "0x1p3", "1.5d"]

    def by_python(text):
        try:
            return not float(text).is_integer()
        except ValueError:
            return False

    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for row in df.select("i", C.is_float(F.col("t")).alias("f")).collect():
        assert row.f == by_python(texts[row.i]), texts[row.i]


@pytest.mark.parametrize("values,all_,any_", [
    (["3.14", "2.71"], True, True), (["1", "2.0"], False, False), (["1", "2.1"], False, True),
    (["abc", "3.14"], False, True), (["abc", "def"], False, False), ([], False, False), (None, False, False),
    ([None, "1.5"], False, True),
])
def test_lists_of_texts(spark, values, all_, any_):
    kind = T.ArrayType(T.StringType())
    assert one(spark, lambda d: C.is_float(d.v, kind), v=(kind, values)) is all_
    assert one(spark, lambda d: C.is_float(d.v, kind, require_all=False), v=(kind, values)) is any_


def test_lists_close(spark):
    close = lambda a, b: one(spark, lambda d: C.is_close(d.a, d.b, DOUBLES, DOUBLES), a=(DOUBLES, a), b=(DOUBLES, b))
    assert close([1.0, 2.0], [1.0000001, 2.0]) is True
    assert close([1.0, 2.0], [1.1, 2.0]) is False
    with pytest.raises(Exception, match="Lists must have the same length"):
        close([1.0, 2.0], [1.0])
    scalar = lambda a, b: one(spark, lambda d: C.is_close(d.a, d.b, DOUBLES, T.DoubleType()), a=(DOUBLES, a), b=(T.DoubleType(), b))
    assert scalar([1.0], 1.0) is True
    assert scalar([1.0, 2.0], 1.5) is False


def test_tolerances_can_be_swapped_inside_lists(spark):
    pair = dict(a=(DOUBLES, [1e3]), b=(DOUBLES, [1e3 + 5e-4]))
    plain = one(spark, lambda d: C.is_close(d.a, d.b, DOUBLES, DOUBLES), **pair)
    swapped = one(spark, lambda d: C.is_close(d.a, d.b, DOUBLES, DOUBLES, swap_nested_tolerances=True), **pair)
    assert (plain, swapped) == (False, True)


@pytest.mark.parametrize("kind_a,a,kind_b,b,want", [
    ("array<double>", [1.0, 2.4], "array<double>", [1.0, 2.4], True),
    ("array<double>", [1.0, 2.0], "array<int>", [1, 2], True),
    ("array<int>", [1, 2], "array<int>", [1, 3], False),
    ("array<array<double>>", [[1.0, 2.5], [3.0]], "array<array<double>>", [[1.0, 2.5000001], [3.0]], True),
    ("array<array<double>>", [[1.0, 2.5]], "array<array<double>>", [[1.0, 3.5]], False),
    ("array<int>", [1, 2], "array<int>", [1], False),
    ("array<int>", [1], "int", 1, False),
    ("int", 1, "array<int>", [1], False),
    ("string", "hello", "string", "hello", True),
    ("string", "hello", "int", 1, False),
    ("boolean", True, "int", 1, True),
    ("int", None, "int", None, True),
    ("int", 1, "int", None, False),
    ("bigint", 2**60, "bigint", 2**60 + 1, False),
])
def test_correct_values(spark, kind_a, a, kind_b, b, want):
    df = spark.createDataFrame([(a, b)], f"a {kind_a}, b {kind_b}")
    assert df.select(C.is_correct(df, "a", "b").alias("x")).first().x is want


def test_sets_are_sorted_arrays(spark):
    df = spark.createDataFrame([([2.5, 1.0, 1.0], [1.0, 2.5])], "a array<double>, b array<double>")
    same = C.is_correct_typed(C.as_set(F.col("a")), C.as_set(F.col("b")), DOUBLES, DOUBLES)
    assert df.select(same.alias("x")).first().x is True


def test_maps_are_refused(spark):
    with pytest.raises(TypeError):
        C.is_close(F.lit(1), F.lit(1), T.MapType(T.StringType(), T.IntegerType()), T.IntegerType())
