"""Samples, sketches and metrics from parts; positions without a global sort."""

import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegauge.operators import incremental, metrics, positions, prepare, sampling, sketches

# --- positions ------------------------------------------------------------------------


@pytest.mark.parametrize("parts", [1, 16])
def test_positions_are_those_of_a_sort(spark, parts):
    rng = random.Random(1)
    values = [(rng.choice([None, *range(50)]), k) for k in range(700)]
    df = spark.createDataFrame(values, "a long, b long").repartition(parts)
    got = {r.b: r.position for r in positions.with_positions(df, ["a", "b"]).collect()}
    order = sorted(values, key=lambda v: (v[0] is not None, v[0] or 0, v[1]))
    assert got == {b: k for k, (_, b) in enumerate(order)}
    down = {r.b: r.position for r in positions.with_positions(df, [F.col("b").desc()]).collect()}
    assert down == {b: 699 - b for b in range(700)}


def test_positions_need_no_task_with_all_rows(spark):
    df = spark.range(1000).repartition(8)
    plan = positions.with_positions(df, ["id"])._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert "rangepartitioning" not in physical  # the order is stored before the plan begins
    # the one window runs on a row per task
    assert physical.count("Window") <= physical.count("WindowExec") + 2 and "HashAggregate" in physical.split("Window")[1]


def test_zip_by_position(spark):
    a = spark.createDataFrame([(k,) for k in (5, 3, 9)], "x long")
    b = spark.createDataFrame([(k,) for k in "dabc"], "y string")
    zipped = lambda lengths: sorted(tuple(r) for r in positions.positional_zip(a, b, ["x"], ["y"], lengths).collect())
    assert zipped("shortest") == [(0, 3, "a"), (1, 5, "b"), (2, 9, "c")]
    assert zipped("longest") == [(0, 3, "a"), (1, 5, "b"), (2, 9, "c"), (3, None, "d")]
    with pytest.raises(Exception, match="no partner at position 3"):
        zipped("equal")
    assert positions.positional_zip(a.limit(0), b, ["x"], ["y"]).count() == 0
    with pytest.raises(ValueError, match="both sides"):
        positions.positional_zip(a, a, ["x"], ["x"])
    with pytest.raises(ValueError, match="lengths"):
        zipped("other")
    with pytest.raises(ValueError, match="order"):
        positions.with_positions(a, [])


# --- sample -----------------------------------------------------------------------------


def test_heaps_merge(spark):
    rows = pa.table({"k": pa.array([None, *range(100)], pa.int64()), "v": [str(k % 7) for k in range(101)]})
    whole = sampling.Heap(10, ["k"])
    whole.add(rows)
    parts = [sampling.Heap(10, ["k"]) for _ in range(4)]
    for k in range(101):
        parts[k % 4].add(rows.slice(k, 1))
    for part in parts[1:]:
        parts[0].merge(part)
    assert parts[0].rows.to_pylist() == whole.rows.to_pylist() and whole.rows["k"].to_pylist() == [None, *range(9)]


@pytest.mark.parametrize("n", [0, 1, 40, 5000])
def test_one_pass_takes_the_rows_of_the_seeded_sample(spark, n):
    df = spark.range(1200).select(F.when(F.col("id") % 4 > 0, F.col("id") % 500).alias("key"), F.col("id").alias("row"), F.array("id").alias("list"))
    want = sorted(r.row for r in prepare.sample_rows(df, "key", n, 3, spread_by=["row"]).collect())
    for parts in (1, 9):
        got = sampling.sample_one_pass(df.repartition(parts), "key", n, 3, ["row"])
        assert sorted(r.row for r in got.collect()) == want and got.schema == df.schema
    plan = sampling.sample_one_pass(df, "key", n, 3, ["row"])._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count("Range (") == 1 and plan.count("MapInArrow") == 3


def test_sample_of_a_stream(spark, tmp_path):
    df = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("v"))
    folder, home, state = (str(tmp_path / n) for n in ("in", "sample", "state"))
    assert sampling.read_sample(spark, home) is None
    for k in range(3):
        df.where(F.col("key") % 3 == k).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
        sampling.sample_stream(stream, home, state, "key", 50, 9, ["key"]).awaitTermination()
        want = prepare.sample_rows(df.where(F.col("key") % 3 <= k), "key", 50, 9, spread_by=["key"])
        assert sorted(sampling.read_sample(spark, home).collect()) == sorted(want.collect())


# --- sketches ------------------------------------------------------------------------------


def test_merged_sketches_keep_their_bound(spark):
    rng = random.Random(2)
    rows = [(k % 9, "docker" if k % 4 else "monty", rng.lognormvariate(0, 3), k % 3 == 0) for k in range(20_000)]
    rows += [(1, "other", None, False), (2, None, None, None)]
    df = spark.createDataFrame(rows, "run long, sandbox_type string, duration_sec double, success boolean")
    for k in (64, 512):
        parts = sketches.telemetry_parts(df, ["run"], k)
        assert parts.count() == 20
        got = {r.sandbox_type: r for r in sketches.merged_telemetry(parts, k).collect()}
        exact = {r.sandbox_type: r for r in metrics.execution_telemetry(df).collect()}
        assert got.keys() == exact.keys() == {"docker", "monty", "unknown"}
        for engine, row in got.items():
            assert (row.n, row.success_rate, row.share) == (exact[engine].n, exact[engine].success_rate, exact[engine].share)
            values = sorted(v for _, e, v, _ in rows if e == engine and v is not None)
            if not values:
                assert row.median_sec is None and row.mean_sec is None
                continue
            assert row.mean_sec == pytest.approx(exact[engine].mean_sec)
            rank = sum(v <= row.median_sec for v in values) / len(values)
            assert abs(rank - 0.5) <= 2 * sketches.rank_error(k) + 1 / len(values)
    assert sketches.rank_error(4096) < sketches.rank_error(200) < 0.0134


def test_parts_of_some_runs_are_enough(spark):
    rows = [(run, "docker", float(v), True) for run in (1, 2) for v in range(run * 10)]
    parts = sketches.telemetry_parts(spark.createDataFrame(rows, "run long, sandbox_type string, duration_sec double, success boolean"), ["run"])
    row = sketches.merged_telemetry(parts.where("run = 1")).collect()[0]
    assert (row.n, row.mean_sec, row.share) == (10, 4.5, 1.0) and row.median_sec in (4.0, 5.0)
    assert sketches.merged_telemetry(parts.where("run = 3")).count() == 0


# --- metrics by batches ---------------------------------------------------------------------

RESULT = "model_id string, dataset_name string, task_id string, token_count int, passed boolean, correct_format boolean, extraction_success boolean, sandbox_execution_time double, result_ts timestamp, result_id long"


def results(spark, seed, n, first):
    rng = random.Random(seed)
    rows = [
        (rng.choice(["m", "n", None]), rng.choice("de"), str(rng.randrange(12)), rng.choice([None, 0, 3, 8]), rng.choice([None, True, False]), rng.random() < 0.5,
         rng.random() < 0.5, rng.choice([None, 0.1, 0.7, 1e-6]), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(40)), first + k)
        for k in range(n)
    ]
    return spark.createDataFrame(rows, RESULT)


def ordered(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()), key=str)


def test_metrics_after_every_batch(spark, tmp_path):
    """Each batch equals the metrics of all rows so far; a batch taken twice changes nothing."""
    home, seen = str(tmp_path / "state"), None
    assert incremental.stored_metrics(spark, home).count() == 0
    for batch, n in enumerate((60, 40, 0, 80)):
        rows = results(spark, batch, n, 1000 * batch)
        seen = rows if seen is None else seen.union(rows)
        for _ in range(2):
            incremental.update_metrics(rows, home, batch, buckets=5)
        want = metrics.dataset_metrics(seen, dedupe="latest")
        got = incremental.stored_metrics(spark, home)
        assert got.columns == want.columns and ordered(got) == ordered(want)
    early = metrics.dataset_metrics(results(spark, 0, 60, 0), dedupe="latest")
    assert ordered(incremental.stored_metrics(spark, home, 0)) == ordered(early)


def test_a_batch_reads_only_itself_and_its_buckets(spark, tmp_path):
    import shutil

    home = str(tmp_path / "state")
    for batch in range(2):
        incremental.update_metrics(results(spark, batch, 200, 1000 * batch), home, batch, buckets=4)
    one = results(spark, 7, 1, 9000).withColumns({"token_count": F.lit(5).cast("int"), "task_id": F.lit("new")})
    touched = one.select(F.pmod(F.xxhash64(*incremental.RESULT_KEY), F.lit(4))).first()[0]
    before = incremental.stored_metrics(spark, home).agg(F.sum("completed_tasks")).first()[0]
    for folder in tmp_path.glob("state/batch=*/tasks/bucket=*"):
        if folder.name != f"bucket={touched}":
            shutil.rmtree(folder)
    incremental.update_metrics(one, home, 2, buckets=4)
    assert incremental.stored_metrics(spark, home).agg(F.sum("completed_tasks")).first()[0] == before + 1


def test_a_batch_that_stopped_half_way_is_taken_again(spark, tmp_path):
    import shutil

    home = str(tmp_path / "state")
    first, second = results(spark, 1, 50, 0), results(spark, 2, 50, 1000)
    incremental.update_metrics(first, home, 0, buckets=3)
    incremental.update_metrics(second, home, 1, buckets=3)
    shutil.rmtree(tmp_path / "state" / "commit=1")  # as if the job had ended before its commit
    shutil.rmtree(tmp_path / "state" / "batch=1" / "sums")
    assert ordered(incremental.stored_metrics(spark, home)) == ordered(metrics.dataset_metrics(first, dedupe="latest"))
    incremental.update_metrics(second, home, 1, buckets=3)
    assert ordered(incremental.stored_metrics(spark, home)) == ordered(metrics.dataset_metrics(first.union(second), dedupe="latest"))


def test_a_large_bucket_has_several_writers(spark, tmp_path):
    rows = spark.range(4000).select(
        F.lit("m").alias("model_id"), F.lit("d").alias("dataset_name"), F.col("id").cast("string").alias("task_id"), F.lit(1).alias("token_count"),
        *[F.lit(True).alias(c) for c in ("passed", "correct_format", "extraction_success")], F.rand(1).alias("sandbox_execution_time"),
        F.timestamp_seconds("id").alias("result_ts"), F.col("id").alias("result_id"),
    ).repartition(8)
    names = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.minPartitionSize"]
    before = [spark.conf.get(n) for n in names]
    for n in names:
        spark.conf.set(n, "8k")
    try:
        incremental.update_metrics(rows, str(tmp_path), 0, buckets=1)
    finally:
        for n, value in zip(names, before):
            spark.conf.set(n, value)
    assert spark.read.parquet(str(tmp_path / "batch=0" / "tasks")).count() == 4000
    for kind in ("new", "tasks"):
        assert len(list(tmp_path.glob(f"batch=0/{kind}/bucket=0/*.parquet"))) > 1, kind


def test_metrics_of_a_stream(spark, tmp_path):
    folder, home, state = (str(tmp_path / n) for n in ("in", "state", "checkpoint"))
    both = [results(spark, k, 60, 1000 * k) for k in range(2)]
    for rows in both:
        rows.coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(both[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)
    incremental.metrics_stream(stream, home, state, buckets=3).awaitTermination()
    assert ordered(incremental.stored_metrics(spark, home)) == ordered(metrics.dataset_metrics(both[0].union(both[1]), dedupe="latest"))
