"""The result store as a data source, and resuming from it with keyed state."""

import json
import threading
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from codegauge.sources import result_source as source
from codegauge.streaming import resume

KEYS = ("model_id", "run_ts", "task_id")


def rows_of(spark, keys, **more):
    """Result rows; what is not given is null."""
    df = spark.createDataFrame(keys, "model_id string, run_ts string, task_id string").withColumns({k: F.lit(v) for k, v in more.items()})
    return df.select(*[F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in source.STORED_RESULT])


def keys(df):
    return sorted((tuple(r) for r in df.select(*KEYS).collect()), key=str)


FIRST = [("a", "1", "x"), ("a", "2", "y"), ("b", "1", "x"), (None, "9", "n"), ("a", None, "z")]
SECOND = [("a", "2", "w"), ("b", "0", "v")]


def test_round_trip_and_filters(spark, tmp_path):
    path = str(tmp_path / "store")
    assert source.read_store(spark, path).count() == 0  # nothing is there yet
    source.append_to_store(rows_of(spark, FIRST, passed=True), path)
    source.append_to_store(rows_of(spark, SECOND, passed=False), path)
    everything = source.read_store(spark, path)
    assert keys(everything) == sorted(FIRST + SECOND, key=str) and everything.schema == source.STORED_RESULT
    frame = spark.createDataFrame(FIRST + SECOND, "model_id string, run_ts string, task_id string")
    for chosen, condition in (
        ({"model_id": "a"}, "model_id = 'a'"), ({"run_from": "1"}, "run_ts >= '1'"), ({"run_to": "1"}, "run_ts <= '1'"),
        ({"model_id": "a", "run_from": "1", "run_to": "1"}, "model_id = 'a' AND run_ts = '1'"), ({"model_id": "none"}, "false"),
    ):
        assert keys(source.read_store(spark, path, **chosen)) == keys(frame.where(condition)), condition


def test_a_frame_may_be_filtered_in_several_ways(spark, tmp_path):
    """Spark keeps filters it pushes to a Python source once per relation; nothing may depend on them."""
    path = str(tmp_path / "store")
    source.append_to_store(rows_of(spark, FIRST + SECOND), path)
    df = source.read_store(spark, path)
    a, b = df.where("model_id = 'a'"), df.where("model_id = 'b'")
    assert (a.count(), df.count(), b.count(), a.count()) == (4, 7, 2, 4)
    assert a.crossJoin(b).count() == 8 and a.union(b).union(df).count() == 13 and df.where("model_id = 'b' OR task_id = 'x'").count() == 3


def test_planning_reads_no_file_of_another_run(spark, tmp_path):
    path = str(tmp_path / "store")
    source.append_to_store(rows_of(spark, FIRST), path)
    store = source.Store(path)
    for file in store.files():
        if (file.model_id, file.run_ts) != ("a", "2"):
            store.fs.delete_file(f"{path}/{file.path}")
    assert keys(source.read_store(spark, path, model_id="a", run_from="2")) == [("a", "2", "y")]


def test_newest_run(spark, tmp_path):
    path = str(tmp_path / "store")
    source.append_to_store(rows_of(spark, FIRST), path)
    source.append_to_store(rows_of(spark, SECOND), path)
    newest = source.read_store(spark, path, latest=True)
    assert keys(newest) == sorted([("a", "2", "y"), ("a", "2", "w"), ("b", "1", "x"), (None, "9", "n")], key=str)
    # bounds on runs come after the choice
    assert keys(source.read_store(spark, path, latest=True, run_to="1")) == [("b", "1", "x")]
    assert keys(source.read_store(spark, path, "a", latest=True)) == [("a", "2", "w"), ("a", "2", "y")]


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    source.append_to_store(rows_of(spark, SECOND), path)
    bad = rows_of(spark, [("a", "1", str(k)) for k in range(100)]).repartition(4)
    bad = bad.withColumn("token_count", F.when(F.col("task_id") == "77", F.raise_error(F.lit("broken")).cast("int")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format(source.NAME).mode("append").save(path)
    assert keys(source.read_store(spark, path)) == SECOND and source.Store(path).numbers() == [0]


def test_written_files_are_deleted_on_abort(tmp_path):
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    writer = source.ResultWriter(str(tmp_path), source.STORED_RESULT)
    schema = to_arrow_schema(source.STORED_RESULT)
    batch = pa.RecordBatch.from_pylist([{"model_id": "m", "run_ts": "1"}, {"model_id": None, "run_ts": "1"}], schema)
    message = writer.write(iter([batch]))
    assert len(message.files) == 2 and len(list((tmp_path / "data").iterdir())) == 2
    writer.abort([message, None])
    assert list((tmp_path / "data").iterdir()) == [] and source.Store(str(tmp_path)).files() == []


def test_commits_at_once_get_different_numbers(tmp_path):
    threads = [threading.Thread(target=lambda k=k: source.Store(str(tmp_path)).publish({"files": [], "k": k})) for k in range(20)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    store = source.Store(str(tmp_path))
    assert store.numbers() == list(range(20)) and {store.commit_of(n)["k"] for n in range(20)} == set(range(20))


def test_pieces_are_cut_at_row_groups(spark, tmp_path, monkeypatch):
    file = lambda name, *sizes: source.ResultFile(name, "m", "1", 1, [(s, 1) for s in sizes])
    pieces = source.plan([file("a", 4, 4, 4), file("b", 1), file("c", 20), file("d")], 8)
    assert [p.parts for p in pieces] == [[("a", 0, 2)], [("a", 2, 3), ("b", 0, 1)], [("c", 0, 1)]]
    monkeypatch.setattr(source, "GROUP_ROWS", 10)
    path = str(tmp_path / "store")
    source.append_to_store(rows_of(spark, [("m", "1", str(k)) for k in range(95)]).coalesce(1), path)
    assert [n for f in source.Store(path).files() for _, n in f.groups] and sum(f.rows for f in source.Store(path).files()) == 95
    assert source.read_store(spark, path).select("task_id").distinct().count() == 95


def test_overwriting_and_missing_columns_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="appended"):
        rows_of(spark, FIRST).write.format(source.NAME).mode("overwrite").save(str(tmp_path))
    source.register(spark)
    with pytest.raises(Exception, match="run_ts"):
        spark.range(3).select(F.lit("m").alias("model_id")).write.format(source.NAME).mode("append").save(str(tmp_path))


def test_a_stream_follows_the_commits(spark, tmp_path):
    path, out, state = (str(tmp_path / n) for n in ("store", "out", "state"))

    def follow():
        stream = source.read_store_stream(spark, path).select(*KEYS)
        stream.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return keys(spark.read.schema("model_id string, run_ts string, task_id string").parquet(out))

    source.append_to_store(rows_of(spark, SECOND), path)
    assert follow() == SECOND
    assert follow() == SECOND  # nothing new
    source.append_to_store(rows_of(spark, FIRST), path)
    assert follow() == sorted(FIRST + SECOND, key=str)


def test_a_batch_written_twice_counts_once(tmp_path):
    from pyspark.sql.pandas.types import to_arrow_schema
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([{"model_id": "m", "run_ts": "1"}], to_arrow_schema(source.STORED_RESULT))
    for stream in ("one", "one", "two"):
        writer = source.ResultStreamWriter(str(tmp_path), source.STORED_RESULT, stream)
        writer.commit([writer.write(iter([batch])), None], 0)
    store = source.Store(str(tmp_path))
    assert len(store.files()) == 2 and len(list((tmp_path / "data").iterdir())) == 2


# --- resuming -------------------------------------------------------------------------

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def arriving(tmp_path, *batches):
    folder = tmp_path / "in"
    folder.mkdir(exist_ok=True)
    for k, batch in enumerate(batches):
        lines = [json.dumps(dict(zip(("task_id", "hour", "result_id", "token_count"), row))) for row in batch]
        (folder / f"{len(list(folder.iterdir()))}.json").write_text("\n".join(lines))
    return str(folder)


def resumed(spark, folder, path, state, delay="3 hours"):
    stream = spark.readStream.schema("task_id string, hour double, result_id long, token_count int").option("maxFilesPerTrigger", 1).json(folder)
    stream = stream.select(
        F.lit("m").alias("model_id"), F.lit("d").alias("dataset_name"), "task_id", "result_id", "token_count",
        F.timestamp_micros((F.lit(int(START.timestamp() * 1e6)) + F.col("hour") * 3_600_000_000).cast("long")).alias("at"),
        F.lit("run").alias("run_ts"), F.col("result_id").cast("string").alias("completion"),
    )
    resume.resume_into_store(stream, path, state, "s", "at", "result_id", delay).awaitTermination()
    return sorted((r.task_id, r.completion) for r in source.read_store(spark, path).where("completion IS NOT NULL").collect())


def test_first_answer_by_event_time(spark, tmp_path):
    """Late and repeated rows, ties, unanswered rows, stored tasks, and a second start."""
    path, state = str(tmp_path / "store"), str(tmp_path / "state")
    stored = rows_of(spark, [("m", "run", "done"), ("m", "run", "empty")], dataset_name="d")
    source.append_to_store(stored.withColumn("token_count", F.when(F.col("task_id") == "done", 5).otherwise(0)), path)
    folder = arriving(
        tmp_path,
        [("1", 2, 10, 1), ("2", 1, 11, 0), ("done", 1, 12, 3), ("3", 2, 21, 1), ("3", 2, 3, 1), ("empty", 1, 13, 1)],
        [("1", 1, 14, 1), ("1", 2, 10, 1), ("2", 2.5, 15, 1), ("4", 9, 16, 1)],  # earlier, but within the delay
        [("3", 8, 1, 1), ("5", 20, 18, 1), ("6", 13, 19, 1)],
        [("1", 0, 17, 1), ("5", 19, 20, 1), ("7", 30, 22, 1)],  # the first of these is too late
    )
    assert resumed(spark, folder, path, state) == [("1", "14"), ("2", "15"), ("3", "3"), ("4", "16"), ("5", "20"), ("6", "19"), ("empty", "13")]
    folder = arriving(tmp_path, [("1", 40, 23, 1), ("8", 40, 24, 1)], [("9", 60, 25, 1)])
    again = resumed(spark, folder, path, state)
    assert [x for x in again if x[0] in ("1", "7", "8", "9")] == [("1", "14"), ("7", "22"), ("8", "24")] and len(again) == 9


def test_the_kept_row_is_whole(spark, tmp_path):
    folder = str(tmp_path / "rows")
    at = START + timedelta(microseconds=123_457)
    row = spark.createDataFrame([("m", "d", "1", 3, at, 0.1, True, 7, [("user", 'a "b"\n')])], "model_id string, dataset_name string, task_id string, token_count int, at timestamp, x double, passed boolean, n long, prompt array<struct<role:string,content:string>>")
    later = row.withColumn("task_id", F.lit("2")).withColumn("at", F.col("at") + F.expr("INTERVAL 2 DAYS"))
    row.union(later).write.parquet(folder)
    stream = spark.readStream.schema(row.schema).parquet(folder)
    found = resume.first_answers(stream, row.limit(0), "at", "n", "1 hour")
    found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "s")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert spark.read.schema(row.schema).parquet(str(tmp_path / "o")).collect() == row.collect()
