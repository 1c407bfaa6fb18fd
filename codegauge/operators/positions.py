"""Rows by their place: numbers from 0 without a global sort, and pairing by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.storage import stage

POSITION = "position"
#: Spark's row ids hold the partition above these bits and the row's place in it below.
_BITS = 33


def with_positions(df: DataFrame, order_by: list[str | Column], position: str = POSITION) -> DataFrame:
    """Number the rows 0, 1, … in the given order; the order should tell all rows apart.

    Rows are dealt to ranges and sorted there, and their place in the range is stored with
    them, so a task that runs again cannot number them anew.  The ranges' sizes, one row
    per task, are summed up to each range's first number: no task sees all rows.
    """
    if not order_by:
        raise ValueError("positions need an order")
    ranged = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    held = stage(ranged.withColumn("__row", F.monotonically_increasing_id()), "positions")
    part = F.shiftright("__row", _BITS)
    sizes = held.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row per task
    firsts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__first"))
    numbered = held.withColumn("__part", part).join(F.broadcast(firsts), "__part")
    place = F.col("__first") + F.col("__row").bitwiseAND(F.lit((1 << _BITS) - 1))
    return numbered.select(*[f"`{c}`" for c in df.columns], place.alias(position))


def positional_zip(
    left: DataFrame, right: DataFrame, left_order: list[str | Column], right_order: list[str | Column],
    lengths: str = "shortest", position: str = POSITION,
) -> DataFrame:
    """Pair the n-th row of one table with the n-th of the other.

    ``lengths``: ``shortest`` drops what has no partner, ``longest`` pairs it with nulls,
    ``equal`` makes it an error.  Column names of the two sides must differ.
    """
    how = {"shortest": "inner", "longest": "full", "equal": "full"}.get(lengths)
    if how is None:
        raise ValueError(f"unknown lengths: {lengths!r} (use 'shortest', 'longest' or 'equal')")
    clash = (set(left.columns) & set(right.columns)) | ({position} & {*left.columns, *right.columns})
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    a, b = with_positions(left, left_order, "__a"), with_positions(right, right_order, "__b")
    both = a.join(b, F.col("__a") == F.col("__b"), how)
    place = F.coalesce("__a", "__b")
    if lengths == "equal":
        alone = F.col("__a").isNull() | F.col("__b").isNull()
        place = F.when(alone, F.raise_error(F.concat(F.lit("no partner at position "), place.cast("string"))).cast("long")).otherwise(place)
    return both.select(place.alias(position), *[f"`{c}`" for c in (*left.columns, *right.columns)])
