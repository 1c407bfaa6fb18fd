"""Rows of unequal cost dealt to slots, against brute force and the plain rule."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.operators import dispatch


def best(costs, slots):
    """The least greatest load of all ways to deal."""
    return min(max(sum(c for c, s in zip(costs, way) if s == k) for k in range(slots)) for way in itertools.product(range(slots), repeat=len(costs)))


def one_by_one(costs, slots):
    loads = [0.0] * slots
    for cost in sorted(costs, reverse=True):
        loads[loads.index(min(loads))] += cost
    return max(loads)


@pytest.mark.parametrize("seed", range(6))
def test_bound_against_brute_force(spark, seed):
    rng = random.Random(seed)
    costs = [rng.choice([1.0, 2.0, 3.0, 7.5, rng.uniform(0.01, 9)]) for _ in range(8)]
    slots = 2 + seed % 2
    df = spark.createDataFrame(list(enumerate(costs)), "i int, cost double")
    rows = dispatch.dispatch(df, "cost", ["i"], slots).collect()
    assert sorted(r.i for r in rows) == list(range(8)) and {r.slot for r in rows} <= set(range(slots))
    loads = [sum(r.cost for r in rows if r.slot == k) for k in range(slots)]
    assert max(loads) <= best(costs, slots) * 4 / 3 * (1 + dispatch.STEP) + 1e-9


def test_many_rows_of_few_costs_equal_the_plain_rule():
    rng = random.Random(9)
    for _ in range(30):
        slots = rng.randrange(1, 9)
        counts = {level: rng.randrange(1, 40) for level in rng.sample(range(0, 200), 6)}
        ends, owner = dispatch.plan(list(counts.items()), slots)
        level_of = [level for level in sorted(counts, reverse=True) for _ in range(counts[level])]
        slot = owner[np.searchsorted(ends, np.arange(len(level_of)), "right")]
        loads = np.bincount(slot, weights=[(1 + dispatch.STEP) ** level for level in level_of], minlength=slots)
        assert ends[-1] == len(level_of)
        assert loads.max() == pytest.approx(one_by_one([(1 + dispatch.STEP) ** level for level in level_of], slots))


def test_odd_costs_and_a_third_of_one_cost(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 5 == 0, -1.0).otherwise(F.col("id") / 100).alias("cost"))
    rows = dispatch.dispatch(df, "cost", ["id"], 16).collect()
    loads = np.bincount([r.slot for r in rows], weights=[max(r.cost or 0, 0) for r in rows], minlength=16)
    assert len(rows) == 3000 and loads.max() <= 1.05 * loads.mean()
    assert dispatch.dispatch(df.limit(0), "cost", ["id"], 4).count() == 0


def test_predicted_cost(spark):
    history = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 8.0), ("c", None)], "k string, duration_sec double")
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    assert {r.k: r.predicted_sec for r in dispatch.predicted_cost(df, history, ["k"]).collect()} == {"a": 2.0, "b": 8.0, "c": 4.0, "d": 4.0}
    assert [r.predicted_sec for r in dispatch.predicted_cost(df.limit(1), history.limit(0), ["k"]).collect()] == [1.0]
