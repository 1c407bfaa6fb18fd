"""Tolerant comparison of results with expected values.

The expression is built from the column's data type, so nested arrays are
compared without Python at run time.  Sets have no Spark type: pass them through
``as_set`` first.  Map types are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.fixed_values import PYTHON_WHITESPACE
from codegauge.functions.text import let, strip

DEFAULT_ABS_TOL = 1e-6
DEFAULT_REL_TOL = 1e-7

# Number texts that Python's ``float`` accepts, in ASCII digits.
_DIGITS = r"\d++(?:_\d++)*+"
_EDGE = "[" + "".join(rf"\x{{{ord(c):x}}}" for c in PYTHON_WHITESPACE) + "]*+"
FLOAT_TEXT = (
    rf"(?i)^{_EDGE}[+-]?(?:inf|infinity|nan|"
    rf"(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?){_EDGE}$"
)

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)


def as_set(values: Column) -> Column:
    """A set as a sorted array without duplicates."""
    return F.array_sort(F.array_distinct(values))


def _is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def _refuse_maps(data_type: T.DataType) -> None:
    if isinstance(data_type, (T.MapType, T.StructType, T.VariantType, T.BinaryType)):
        raise TypeError(f"cannot compare values of type {data_type.simpleString()}")


def _double(value: Column, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.BooleanType):
        return value.cast("int").cast("double")
    return value.cast("double")


def text_to_double(text: Column) -> Column:
    """Python's ``float(text)``; null where it would raise.

    The pattern allows white space at the edges, so only numbers are trimmed.
    """
    value = F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("double")
    # of the accepted texts only a signed NaN is no number to Spark
    return F.when(text.rlike(FLOAT_TEXT), F.coalesce(value, F.lit(float("nan"))))


def _has_fraction(value: Column) -> Column:
    """Not an integer: infinities and NaN count as fractional."""
    return value % 1 != 0


def is_float(value: Column, data_type: T.DataType = T.StringType(), require_all: bool = True) -> Column:
    """Is the value (or text) a non-integer number?

    Arrays: all elements, or any with ``require_all=False``; an empty array and
    null give false.  Other types give false.
    """
    if isinstance(data_type, T.ArrayType):
        quantifier = F.forall if require_all else F.exists
        element = lambda v: is_float(v, data_type.elementType, require_all)
        return F.coalesce((F.size(value) > 0) & quantifier(value, element), F.lit(False))
    if isinstance(data_type, T.StringType):
        return F.coalesce(_has_fraction(text_to_double(value)), F.lit(False))
    if isinstance(data_type, (*_FLOATING, T.DecimalType)):
        return F.coalesce(_has_fraction(value.cast("double")), F.lit(False))
    return F.lit(False)


def _difference(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    if isinstance(a_type, _INTEGRAL) and isinstance(b_type, _INTEGRAL):
        # exact also beyond 2^53 and without overflow
        return F.abs(a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")
    return F.abs(_double(a, a_type) - _double(b, b_type))


def _equal(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> Column:
    """Python's ``==`` on two non-null scalars: NaN equals nothing."""
    if _is_numeric(a_type) and _is_numeric(b_type):
        if isinstance(a_type, T.BooleanType):
            a = a.cast("int")
        if isinstance(b_type, T.BooleanType):
            b = b.cast("int")
        if isinstance(a_type, _FLOATING) and isinstance(b_type, _FLOATING):
            return (a.cast("double") == b.cast("double")) & ~F.isnan(a)
        return a == b
    if type(a_type) is type(b_type):
        return a == b
    return F.lit(False)


def _null_safe(a: Column, b: Column, both_present: Column) -> Column:
    """Null equals null only."""
    return (
        F.when(a.isNull() & b.isNull(), True)
        .when(a.isNull() | b.isNull(), False)
        .otherwise(both_present)
    )


def _close_scalars(a, a_type, b, b_type, abs_tol, rel_tol) -> Column:
    if not (_is_numeric(a_type) and _is_numeric(b_type)):
        return _null_safe(a, b, _equal(a, a_type, b, b_type))
    diff = _difference(a, a_type, b, b_type)
    largest = F.greatest(F.abs(_double(a, a_type)), F.abs(_double(b, b_type)))
    tolerance = F.greatest(largest * F.lit(float(rel_tol)), F.lit(float(abs_tol)))
    # Spark ranks NaN above every number, Python finds no order at all
    within = ~F.isnan(diff) & ~F.isnan(tolerance) & (diff <= tolerance)
    return _null_safe(a, b, _equal(a, a_type, b, b_type) | within)


def is_close(
    result: Column,
    expected: Column,
    result_type: T.DataType = T.DoubleType(),
    expected_type: T.DataType = T.DoubleType(),
    abs_tol: float = DEFAULT_ABS_TOL,
    rel_tol: float = DEFAULT_REL_TOL,
    swap_nested_tolerances: bool = False,
) -> Column:
    """``diff <= max(rel_tol * larger magnitude, abs_tol)``.

    Arrays are compared element by element (a length difference is an error), an
    array against a scalar compares every element with it.  Two infinities of any
    sign, and an infinity with any number, are close; NaN never is.
    ``swap_nested_tolerances`` exchanges the two tolerances at every array level.
    """
    _refuse_maps(result_type)
    _refuse_maps(expected_type)
    inner = (rel_tol, abs_tol) if swap_nested_tolerances else (abs_tol, rel_tol)

    def nested(a, a_type, b, b_type):
        return is_close(a, b, a_type, b_type, *inner, swap_nested_tolerances)

    result_is_array = isinstance(result_type, T.ArrayType)
    expected_is_array = isinstance(expected_type, T.ArrayType)
    if result_is_array and expected_is_array:
        same = F.forall(
            F.zip_with(
                result,
                expected,
                lambda a, b: nested(a, result_type.elementType, b, expected_type.elementType),
            ),
            lambda ok: ok,
        )
        checked = F.when(
            F.size(result) != F.size(expected),
            F.raise_error(F.lit("Lists must have the same length.")).cast("boolean"),
        ).otherwise(same)
        return _null_safe(result, expected, checked)
    if result_is_array:
        each = F.forall(result, lambda a: nested(a, result_type.elementType, expected, expected_type))
        return F.coalesce(each, F.lit(False))
    if expected_is_array:
        each = F.forall(expected, lambda b: nested(result, result_type, b, expected_type.elementType))
        return F.coalesce(each, F.lit(False))
    return _close_scalars(result, result_type, expected, expected_type, abs_tol, rel_tol)


def is_correct_typed(
    result: Column,
    expected: Column,
    result_type: T.DataType,
    expected_type: T.DataType,
    abs_tol: float = 0.0,
    rel_tol: float = DEFAULT_REL_TOL,
) -> Column:
    """Tolerance where the expected value is a non-integer, equality elsewhere.

    Arrays are compared recursively; a length or shape difference is false.
    ``abs_tol=0`` means the default tolerance.
    """
    _refuse_maps(result_type)
    _refuse_maps(expected_type)
    abs_tol = abs_tol or DEFAULT_ABS_TOL
    result_is_array = isinstance(result_type, T.ArrayType)
    expected_is_array = isinstance(expected_type, T.ArrayType)
    if result_is_array and expected_is_array:
        same = F.forall(
            F.zip_with(
                result,
                expected,
                lambda a, b: is_correct_typed(
                    a, b, result_type.elementType, expected_type.elementType, abs_tol, rel_tol
                ),
            ),
            lambda ok: ok,
        )
        return _null_safe(result, expected, (F.size(result) == F.size(expected)) & same)
    if result_is_array or expected_is_array:
        return result.isNull() & expected.isNull()
    equal = _equal(result, result_type, expected, expected_type)
    if isinstance(expected_type, (*_FLOATING, T.DecimalType)) and _is_numeric(result_type):
        close = _close_scalars(result, result_type, expected, expected_type, abs_tol, rel_tol)
        equal = F.when(is_float(expected, expected_type), close).otherwise(equal)
    return _null_safe(result, expected, equal)


def is_correct(
    df: DataFrame, result: str, expected: str, abs_tol: float = 0.0, rel_tol: float = DEFAULT_REL_TOL
) -> Column:
    """``is_correct_typed`` with the types taken from the DataFrame's schema."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return is_correct_typed(
        F.col(result), F.col(expected), types[result], types[expected], abs_tol, rel_tol
    )
