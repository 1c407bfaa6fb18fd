"""Dealing rows of unequal cost to slots of equal load.

Longest first: the costliest row goes to the slot with the least load, and so on; the
greatest load is then at most 4/3 of the best possible one.  Rows are not walked through
one by one: costs are rounded up to steps of ``STEP``, and of all rows of one cost each slot
takes as many as that rule would give it, which a search for the common level finds.  The
driver sees a count per cost and makes a table of as many entries as costs times slots;
rows find their slot by their place among the rows of all costs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.operators.positions import with_positions

#: Relative width of a cost step: the bound of 4/3 grows by as much.
STEP = 0.02
#: Costs below this count as this.
LEAST = 1e-6


def predicted_cost(df: DataFrame, history: DataFrame, keys: list[str], seconds: str = "duration_sec", out: str = "predicted_sec") -> DataFrame:
    """Add the mean seconds of earlier executions with the same keys, else of all."""
    means = history.where(F.col(seconds).isNotNull()).groupBy(*keys).agg(F.avg(seconds).alias("__mean"))
    overall = history.agg(F.avg(seconds)).scalar()
    return df.join(means, keys, "left").withColumn(out, F.coalesce("__mean", overall, F.lit(1.0))).drop("__mean")


def shares(count: int, cost: float, loads: np.ndarray) -> np.ndarray:
    """How many of ``count`` rows of one cost each slot takes, least load first."""
    taken = lambda level: np.maximum(0, np.floor((level - loads) / cost + 1e-9).astype(np.int64) + 1)
    low, high = loads.min() - cost, loads.max() + cost * (count + 1)
    for _ in range(100):  # the last level at which not too many are taken
        middle = (low + high) / 2
        low, high = (middle, high) if taken(middle).sum() <= count else (low, middle)
    out = taken(low)
    for _ in range(count - int(out.sum())):  # slots that reach the next level together
        out[np.argmin(loads + out * cost)] += 1
    return out


def plan(costs: list[tuple[int, int]], slots: int, step: float = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(ends, slot) of the places dealt to slots, for (cost step, rows), and in that order
    of costs, greatest first."""
    loads, ends, owner, at = np.zeros(slots), [], [], 0
    for level, count in sorted(costs, reverse=True):
        cost = (1 + step) ** level
        mine = shares(count, cost, loads)
        loads += mine * cost
        for slot in np.flatnonzero(mine):
            at += int(mine[slot])
            ends.append(at)
            owner.append(slot)
    return np.array(ends, np.int64), np.array(owner, np.int32)


def dispatch(df: DataFrame, cost: str, key: list[str], slots: int, step: float = STEP, slot: str = "slot") -> DataFrame:
    """Add the slot of every row; ``key`` tells rows of one cost apart."""
    bounded = F.greatest(F.coalesce(F.col(cost).cast("double"), F.lit(LEAST)), F.lit(LEAST))
    level = F.ceil(F.log(bounded) / math.log1p(step) - 1e-9).cast("int")
    rows = with_positions(df.withColumn("__level", level), [F.col("__level").desc(), *key], "__place")
    ends, owner = plan([(r["__level"], r["n"]) for r in rows.groupBy("__level").agg(F.count(F.lit(1)).alias("n")).collect()], slots, step)

    @F.arrow_udf("int")
    def slot_of(place: pa.Array) -> pa.Array:
        return pa.array(owner[np.searchsorted(ends, place.to_numpy(), "right")], pa.int32())

    return rows.withColumn(slot, slot_of("__place")).drop("__level", "__place")
