import json
import os

import pytest
from pyspark.sql import functions as F

from codegauge import storage
from codegauge.sources import results, support, tables
from codegauge.streaming import scoring


def test_materialise_reuses_only_finished_tables(spark, tmp_path):
    path = str(tmp_path / "table")
    assert storage.materialise(spark.range(3), path).count() == 3
    assert storage.materialise(spark.range(99), path).count() == 3
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "part-0.parquet").write_text("x")
    with pytest.raises(Exception, match="already exists"):
        storage.materialise(spark.range(3), str(tmp_path / "broken"))


def test_shared_folder_comes_from_the_session(spark):
    assert storage.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    five = storage.stage(spark.range(5), "five")
    assert five.count() == 5
    assert storage.clear_staged(spark) >= 1
    assert not any(storage.path_exists(spark, f) for f in five.inputFiles())


def test_module_map(spark, tmp_path):
    good = tmp_path / "map.json"
    good.write_text(json.dumps({"_metadata": {"x": 1}, "mapping": {"PIL": "Pillow", "cv2": "opencv-python"}}, indent=2))
    assert sorted(map(tuple, support.read_module_map(spark, str(good)).collect())) == [("PIL", "Pillow"), ("cv2", "opencv-python")]
    bad = tmp_path / "bad.json"
    bad.write_text("{")
    assert support.read_module_map(spark, str(bad)).count() == 0
    assert support.read_module_map(spark, str(tmp_path / "none.json")).count() == 0


def test_logs_keep_extra_fields(spark, tmp_path):
    lines = [
        {"timestamp": "2024-01-01T00:00:00Z", "level": "DEBUG", "path": "p", "function": "f", "line": 3, "message": "m",
         "duration": 0.5, "nested": {"a": [1]}},
        {"timestamp": "2024-01-01T00:00:01Z", "level": "ERROR", "path": "p", "function": "f", "line": 4, "message": "m",
         "exc_info": "Traceback"},
    ]
    path = tmp_path / "log.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\nnot json\n")
    logs = support.read_logs(spark, str(path))
    rows = logs.select("level", "line", "exc_info", support.log_field("duration", "double").alias("d"),
                       support.log_field("nested.a", "array<int>").alias("n")).collect()
    assert [tuple(r) for r in rows] == [("DEBUG", 3, None, 0.5, [1]), ("ERROR", 4, "Traceback", None, None), (None,) * 5]


def test_input_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("héllo", encoding="utf-8")
    (tmp_path / "b.bin").write_bytes(b"x" * 1023 + b"\0")
    (tmp_path / "c.txt").write_bytes(b"x" * 1024 + b"\0")
    (tmp_path / "d.txt").write_bytes(b"\xff\xfe")
    rows = {r.name: r for r in support.read_input_files(spark, str(tmp_path)).collect()}
    assert {n: r.is_binary for n, r in rows.items()} == {"a.txt": False, "b.bin": True, "c.txt": False, "d.txt": False}
    assert rows["a.txt"].text == "héllo" and rows["b.bin"].text is None and rows["d.txt"].text is None


def test_failed_generations(spark, tmp_path):
    path = tmp_path / "g.jsonl"
    path.write_text('{"task_id": "1", "completion": "x", "token_count": 3, "generation_time": 0.5, "throughput": 6.0}\n{"task_id": "2"}\n')
    rows = {r.task_id: r for r in tables.read_generations(spark, str(path)).collect()}
    assert (rows["2"].completion, rows["2"].token_count, rows["2"].throughput) == ("", 0, 0.0)
    assert rows["1"].token_count == 3


SCHEMA = "model_id string, dataset_name string, task_id string, token_count int, passed boolean, ts timestamp, stdout string"


def write_batches(tmp_path, *batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for i, rows in enumerate(batches):
        lines = [json.dumps(dict(zip(("model_id", "dataset_name", "task_id", "token_count", "passed", "ts", "stdout"), r))) for r in rows]
        (folder / f"{i}.json").write_text("\n".join(lines))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))  # read in this order
    return str(folder)


def row(task, hour, passed=True, tokens=5, minute=0):
    return ("m", "d", task, tokens, passed, f"2024-01-01T{hour:02d}:{minute:02d}:00Z", "[true]" if passed else "[false]")


def test_streamed_scores_equal_batch_and_resume(spark, tmp_path):
    folder = write_batches(tmp_path, [row("1", 1), row("2", 1, False)], [row("3", 2)])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")

    def run():
        stream = scoring.read_stream(spark, folder, SCHEMA, files_per_trigger=1)
        scoring.append_to(scoring.score_stream(stream), out, state, "scores").awaitTermination()
        return {r.task_id: r.pass_rate for r in spark.read.parquet(out).collect()}

    assert run() == {"1": 1.0, "2": 0.0, "3": 1.0}
    with open(f"{folder}/9.json", "w") as f:
        f.write(json.dumps({"task_id": "4", "stdout": "[true, false]"}))
    assert run() == {"1": 1.0, "2": 0.0, "3": 1.0, "4": 0.5}
    assert spark.read.parquet(out).count() == 4


def test_streamed_duplicates(spark, tmp_path):
    folder = write_batches(tmp_path, [row("1", 1), row("1", 1, minute=5), row("2", 1, tokens=0)], [row("1", 2), row("2", 2)])
    stream = scoring.first_per_task(scoring.read_stream(spark, folder, SCHEMA, files_per_trigger=1), "ts", "1 day")
    out = str(tmp_path / "out")
    scoring.append_to(stream, out, str(tmp_path / "state"), "first").awaitTermination()
    assert sorted(r.task_id for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_streamed_windows_equal_batch_and_drop_late_rows(spark, tmp_path):
    folder = write_batches(tmp_path, [row("1", 1), row("2", 1, False)], [row("3", 5)], [row("6", 6)], [row("4", 1), row("5", 12)])
    results = scoring.read_stream(spark, folder, SCHEMA, files_per_trigger=1)
    out = str(tmp_path / "out")
    stream = scoring.windowed_metrics(results, "ts", "2 hours", "1 hour")
    scoring.append_to(stream, out, str(tmp_path / "state"), "windows").awaitTermination()
    rows = {r.window_start.hour: (r.n_results, r.pass_rate) for r in spark.read.parquet(out).collect()}
    # the row of task 4 came after its window was closed
    assert rows == {0: (2, 0.5), 4: (1, 1.0), 6: (1, 1.0)}


def test_streamed_results_are_read_back_and_kept(spark, tmp_path):
    """A second stream begins at batch 0 again and must not touch the first one's rows."""
    folder, out = write_batches(tmp_path, [row("1", 1)], [row("2", 2)]), str(tmp_path / "out")
    for name in ("a", "b"):
        stream = scoring.score_stream(scoring.read_stream(spark, folder, SCHEMA, files_per_trigger=1))
        values = {"run_ts": F.lit("2024-01-01"), "completion": F.lit(name)}
        stream = stream.withColumns(values)
        columns = [F.col(f.name) if f.name in stream.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in results.STORED_RESULT]
        for _ in range(2):  # the second start finds nothing new
            scoring.append_results_stream(stream.select(*columns), out, str(tmp_path / name)).awaitTermination()
    rows = results.read_latest_run(spark, out, "m").collect()
    assert sorted((r.completion, r.task_id) for r in rows) == [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2")]


def test_result_files_follow_the_size(spark, tmp_path):
    """Few files for many tasks, and a repeated part replaces only itself."""
    rows = spark.range(4000).select(F.lit("m").alias("model_id"), (F.col("id") % 3).cast("string").alias("run_ts"), F.col("id").cast("string").alias("task_id"))
    rows = rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in results.STORED_RESULT])
    out = str(tmp_path / "out")
    results.append_results(rows.repartition(16), out)
    assert len(list(tmp_path.glob("out/part=*/model_id=m/run_ts=*/*.json"))) <= 6
    for _ in range(2):
        results.append_results(rows.limit(5), out, "again")
    assert results.read_results(spark, out).count() == 4005
    assert results.newest_run(spark, out, "m") == "2"
