import pytest
from pyspark.sql import functions as F

from codegauge.operators.joins import hot_keys, skew_join
from codegauge.operators.prepare import sample_rows


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share key 1, a fifth of the rest have none."""
    key = F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") % 50)
    return spark.range(6000).select(F.col("id"), key.cast("long").alias("k"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_the_plain_join(spark, skewed, how):
    right = spark.range(0, 30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    right = right.unionByName(right.where("k % 4 = 1"))  # several right rows per key
    got = skew_join(skewed, right, ["k"], how, ["id"])
    want = skewed.join(right, ["k"], how).select(*got.columns)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_hot_key_is_split(spark, skewed):
    fan_out = {r.k: r["__fan_out"] for r in hot_keys(skewed, ["k"], 12).collect()}
    assert fan_out[1] >= 4
    assert len(fan_out) < 12


def test_keys_are_counted_once(spark, skewed, tmp_path):
    skewed.write.parquet(str(tmp_path / "left"))
    left = spark.read.parquet(str(tmp_path / "left"))
    joined = skew_join(left, spark.range(30).withColumnRenamed("id", "k"), ["k"], "left", ["id"])
    joined.count()
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan or "ReusedSubquery" in plan, plan
    assert final.count("partial_count") <= 1, plan


def test_full_join_is_refused(skewed):
    with pytest.raises(ValueError):
        skew_join(skewed, skewed, ["k"], "outer", ["id"])


def test_sample_is_the_same_for_any_partitioning(spark):
    rows = spark.range(5000).withColumnRenamed("id", "key")
    place = F.md5(F.concat(F.lit("9:"), F.col("key").cast("string")))
    want = {r.key for r in rows.orderBy(place, "key").limit(700).collect()}
    for parts in (1, 16):
        got = [r.key for r in sample_rows(rows.repartition(parts), "key", 700, seed=9).collect()]
        assert len(got) == 700 and set(got) == want
    # coarse buckets: the edge bucket holds many rows
    assert {r.key for r in sample_rows(rows, "key", 700, seed=9, digits=1).collect()} == want


def test_sample_with_null_and_repeated_keys(spark):
    rows = spark.range(100).selectExpr("CASE WHEN id % 5 > 0 THEN id % 40 END AS key", "id AS number")
    for n in (50, 90, 100):
        picks = [sorted(r.number for r in sample_rows(rows.repartition(p), "key", n, seed=3).collect()) for p in (1, 16)]
        assert len(picks[0]) == n and picks[0] == picks[1]


@pytest.mark.parametrize("n,want", [(-1, 100), (0, 0), (1, 1), (99, 99), (100, 100), (500, 100)])
def test_sample_sizes(spark, n, want):
    assert sample_rows(spark.range(100), "id", n, seed=1).count() == want


def test_sample_without_seed_is_stable_within_one_plan(spark):
    sample = sample_rows(spark.range(1000), "id", 10)
    assert sample.collect() == sample.collect()
