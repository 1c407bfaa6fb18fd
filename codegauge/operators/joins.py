"""Joins whose left side may have very frequent keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FAN_OUT = "__fan_out"
_SALT = "__salt"


def hot_keys(df: DataFrame, on: list[str], partitions: int) -> DataFrame:
    """Keys that fill more than one average shuffle partition, with how many.

    Null keys are left out: they match nothing.  Counts are aggregated before the
    shuffle, and one count serves both the total and the list (both plans filter alike,
    so Spark reuses the exchange).  Each listed key holds more than
    ``1/partitions`` of the rows, so there are fewer than ``partitions`` of them:
    the list may be broadcast whatever the size of the data.
    """
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    counts = df.where(known).groupBy(*on).agg(F.count(F.lit(1)).alias("__rows"))
    total = counts.agg(F.sum("__rows")).scalar()
    fan_out = F.ceil(F.col("__rows") * F.lit(partitions) / total).cast("int")
    return counts.select(*on, fan_out.alias(_FAN_OUT)).where(F.col(_FAN_OUT) > 1)


def skew_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str,
    spread_by: list[str],
    partitions: int | None = None,
) -> DataFrame:
    """Equi join that splits the left rows of hot keys over several tasks.

    A hot key gets as many salts as average partitions it would fill; its right
    rows are repeated once per salt, so at most about ``2 * partitions`` right
    rows per key multiplicity are added in total.  ``spread_by`` names left
    columns that tell rows of one key apart.  Rows with a null key match nothing
    and are spread too.  The left side is read twice (once for its keys only): pass a
    stored table if it is costly.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"cannot split the left side of a {how!r} join")
    spark = left.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = F.broadcast(hot_keys(left, on, partitions))

    missing_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.xxhash64(*spread_by)
    salt = F.when(missing_key, F.pmod(spread, F.lit(partitions))).otherwise(
        F.pmod(spread, F.coalesce(_FAN_OUT, F.lit(1)))
    )
    salted_left = left.join(hot, on, "left").withColumn(_SALT, salt.cast("int")).drop(_FAN_OUT)
    salts = F.sequence(F.lit(0), F.coalesce(_FAN_OUT, F.lit(1)) - 1)
    salted_right = right.join(hot, on, "left").withColumn(_SALT, F.explode(salts)).drop(_FAN_OUT)
    return salted_left.join(salted_right, [*on, _SALT], how).drop(_SALT)


