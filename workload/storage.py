"""Stored tables, files, logs and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from codegauge import storage
from codegauge.sources import result_source
from codegauge.sources import results as R
from codegauge.sources import support, tables
from codegauge.streaming import resume, scoring
from workload.sqltext import PARSED
from workload.views import VIEWS, table, view, with_views


def _stored_results(spark, sf_dir):
    """fx_task_results in the stored form, one run per day."""
    df = view(spark, sf_dir, "fx_task_results")
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("task "), "task_id").alias("content")))
    values = {
        "model_name": F.concat(F.lit("org/"), "model_id"),
        "timestamp": F.date_format("result_ts", "yyyy-MM-dd'T'HH:mm:ss"),
        "pass_rate": F.when(F.col("passed"), 1.0),
        "generation_time": F.lit(0.5),
        "throughput": F.lit(2.0),
        "error_message": F.when(~F.col("passed"), "Sandbox failed: \"x\"\nline"),
        "prompt": prompt,
        "completion": F.col("result_id").cast("string"),
        "extracted_code": F.lit(None).cast("string"),
        "run_ts": F.date_format("result_ts", "yyyy-MM-dd"),
    }
    df = df.withColumns(values)
    return df.select(*[F.col(f.name).cast(f.dataType) for f in R.STORED_RESULT.fields])


def results_round_trip(spark, sf_dir):
    """Appended as JSON lines in two parts, read back, nothing lost."""
    path = storage.new_path(spark, "results")
    rows = _stored_results(spark, sf_dir)
    R.append_results(rows.where("token_count > 50"), path)
    R.append_results(rows.where("NOT coalesce(token_count > 50, false)"), path)
    back = R.read_results(spark, path)
    return back.select(
        "completion", "model_name", "model_id", "run_ts", "dataset_name", "task_id", "token_count", "passed",
        "pass_rate", "error_message", F.col("prompt")[0]["content"].alias("prompt"),
    )


def missing_results(spark, sf_dir):
    """No file yet means no rows, so every task is pending."""
    nothing = R.read_results(spark, storage.new_path(spark, "none"))
    tasks = view(spark, sf_dir, "fx_tasks")
    return tasks.join(nothing.select("task_id"), "task_id", "left_anti").select("task_id")


def latest_run_stored(spark, sf_dir):
    """Rows of one model's newest run; other runs' folders are not read."""
    path = storage.new_path(spark, "results")
    R.append_results(_stored_results(spark, sf_dir), path)
    return R.read_latest_run(spark, path, "model_1").select("completion", "run_ts", "task_id", "token_count")


def result_source_pushdown(spark, sf_dir):
    """Results committed to a store in two steps; only the files of some runs are read."""
    path = storage.new_path(spark, "store")
    rows = _stored_results(spark, sf_dir)
    result_source.append_to_store(rows.where("token_count > 50"), path)
    result_source.append_to_store(rows.where("NOT coalesce(token_count > 50, false)"), path)
    some = result_source.read_store(spark, path, "model_1", run_from="2024-01-10").where("token_count > 20")
    return some.select("completion", "model_name", "run_ts", "task_id", "token_count", "error_message", F.col("prompt")[0]["content"].alias("prompt"))


def result_source_latest(spark, sf_dir):
    """Each model's newest run, chosen from the commits alone."""
    path = storage.new_path(spark, "store")
    result_source.append_to_store(_stored_results(spark, sf_dir), path)
    return result_source.read_store(spark, path, latest=True).select("model_id", "run_ts", "completion", "token_count")


def result_source_stream(spark, sf_dir):
    """A stream follows a store: results as they are committed."""
    path = storage.new_path(spark, "store")
    rows = _stored_results(spark, sf_dir)
    result_source.append_to_store(rows.where("passed"), path)
    stream = result_source.read_store_stream(spark, path).select("model_id", "run_ts", "completion")
    out, checkpoint = storage.new_path(spark, "followed"), storage.new_path(spark, "followed-state")
    scoring.append_to(stream, out, checkpoint, "followed").awaitTermination()
    result_source.append_to_store(rows.where("NOT passed"), path)
    scoring.append_to(stream, out, checkpoint, "followed").awaitTermination()
    return spark.read.parquet(out)


def stream_resume_state(spark, sf_dir):
    """Results streamed into a store that holds a third of the tasks already.

    Rows arrive in four micro-batches: by time, but some a batch late, some twice.  A start
    of the stream takes one; the next goes on from its checkpoint.
    """
    results = view(spark, sf_dir, "fx_task_results").withColumn("result_ts", F.col("result_ts").cast("timestamp"))
    results = results.withColumn("run_ts", F.date_format("result_ts", "yyyy-MM-dd"))
    path, folder = storage.new_path(spark, "store"), storage.new_path(spark, "arriving")
    columns = [F.col(f.name).cast(f.dataType) if f.name in results.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in R.STORED_RESULT]
    result_source.append_to_store(results.where("task_id % 3 = 0").select(*columns), path)
    batch = F.least(F.floor((F.dayofmonth("result_ts") - 1) / 7), F.lit(3)).cast("int")
    # the rows of a week's last days may come with the next week, some rows come again
    late = F.when((F.col("result_id") % 5 == 0) & (F.dayofmonth("result_ts") % 7 == 0), 1).otherwise(0)
    again = F.when(F.col("result_id") % 11 == 0, F.array(batch, batch + 1)).otherwise(F.array(batch + late))
    rows = results.withColumn("batch", F.explode(again)).withColumn("batch", F.least("batch", F.lit(3)))
    state = storage.new_path(spark, "resume-state")
    for k in range(4):
        # each reading task writes its share: no task sorts or holds a batch
        rows.where(F.col("batch") == k).drop("batch").write.mode("append").json(folder)
        arriving = spark.readStream.schema(results.schema).json(folder)
        columns = arriving.withColumn("completion", F.col("result_id").cast("string"))
        resume.resume_into_store(columns, path, state, "resume", "result_ts", "result_id", "8 days").awaitTermination()
    stored = result_source.read_store(spark, path)
    return stored.where("completion IS NOT NULL").select("model_id", "dataset_name", "task_id", "completion", "run_ts", "token_count", "passed")


def prepared_reuse(spark, sf_dir):
    """A prepared training table is written once and then reused."""
    docs = table(spark, sf_dir, "documents")
    raw = docs.select(
        F.col("doc_id").alias("seq_id"), F.col("text").alias("instruction"), F.col("lang").alias("output"),
        F.lit("def f(x):\n    return x").alias("code"), F.lit("f").alias("entry_point"),
        F.array(F.lit("assert f(1) == 1")).alias("testcase"),
    )
    raw_path = storage.new_path(spark, "raw")
    tables.export_table(raw, raw_path)
    root = storage.new_path(spark, "prepared")
    first = tables.load_training(spark, raw_path, root, seed=3)
    # other raw rows: the second call must not look at them
    tables.export_table(raw.where("seq_id < 0"), f"{raw_path}-none")
    again = tables.load_training(spark, f"{raw_path}-none", root, seed=3)
    return first.join(again.select("seq_id"), "seq_id").select("seq_id", "tests")


def generations_read(spark, sf_dir):
    """Generations from JSON lines; failed calls become empty answers."""
    path = storage.new_path(spark, "generations")
    rows = view(spark, sf_dir, "fx_generations").select(
        F.col("sample_id").cast("string").alias("task_id"),
        F.when(F.col("token_count") > 0, F.lit("answer")).alias("completion"),
        F.when(F.col("token_count") > 0, F.col("token_count")).alias("token_count"),
        F.when(F.col("token_count") > 0, F.col("generation_time")).alias("generation_time"),
    )
    rows.write.json(path)
    return tables.read_generations(spark, path)


def file_kinds(spark, sf_dir):
    """Text or binary by the first 1,024 bytes."""
    pages = table(spark, sf_dir, "pages")
    kind = F.col("page_id") % 4
    content = (
        F.when(kind == 0, F.encode("html", "UTF-8"))
        .when(kind == 1, F.encode(F.concat(F.repeat(F.lit("a"), 1023), F.lit("\0"), "html"), "UTF-8"))
        .when(kind == 2, F.encode(F.concat(F.repeat(F.lit("a"), 1024), F.lit("\0"), "html"), "UTF-8"))
        .otherwise(F.concat(F.encode("html", "UTF-8"), F.unhex(F.lit("FF"))))
    )
    files = support.classify_files(pages.select("page_id", content.alias("content")))
    return files.select(
        "page_id", "is_binary", F.length("text").cast("bigint").alias("n_chars"), F.md5("text").alias("text_md5")
    )


def log_telemetry(spark, sf_dir):
    """Run logs as JSON lines with extra fields, back to counts per engine."""
    executions = view(spark, sf_dir, "fx_executions")
    record = F.to_json(F.struct(
        F.date_format("start_time", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("exit_code") == 0, "DEBUG").otherwise("ERROR").alias("level"),
        F.lit("/src/x.py").alias("path"), F.lit("run").alias("function"),
        F.col("exec_id").cast("int").alias("line"), F.lit('done "ok"').alias("message"),
        F.col("sandbox_type").alias("sandbox"), F.col("duration_sec").alias("duration"),
    ))
    lines = executions.select(F.when(F.col("exec_id") % 50 == 0, F.lit("not json")).otherwise(record).alias("value"))
    path = storage.new_path(spark, "logs")
    lines.write.text(path)
    logs = support.read_logs(spark, path)
    return (
        logs.withColumn("sandbox", support.log_field("sandbox", "string"))
        .groupBy("sandbox", "level")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.round(F.avg(support.log_field("duration", "double")), 9).alias("mean_sec"),
            F.max("line").alias("last_line"),
            F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("last_time"),
        )
    )


# --- streams -----------------------------------------------------------------------


def _event_stream(spark, sf_dir, view_name):
    """A view over the events table, read as a stream."""
    schema = table(spark, sf_dir, "events").schema
    path = f"{sf_dir}/events.parquet"
    if storage.path_exists(spark, f"{path}/*"):  # a folder of files
        stream = scoring.read_stream(spark, path, schema, "parquet")
    else:
        stream = scoring.read_stream(spark, sf_dir, schema, "parquet", pattern="events.parquet")
    stream.withColumn("ts", F.col("ts").cast("timestamp")).createOrReplaceTempView("events")
    return spark.sql(VIEWS[view_name])


def _run(spark, stream, name):
    path, checkpoint = storage.new_path(spark, name), storage.new_path(spark, f"{name}-state")
    query = scoring.append_to(stream, path, checkpoint, name)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_score(spark, sf_dir):
    """Executions scored as they arrive."""
    stream = scoring.score_stream(_event_stream(spark, sf_dir, "fx_executions").select("exec_id", "stdout"))
    return _run(spark, stream, "scored").select("exec_id", "passed", "pass_rate")


def stream_first_per_task(spark, sf_dir):
    """One answered result per task, however often it was sent."""
    results = _event_stream(spark, sf_dir, "fx_task_results")
    stream = scoring.first_per_task(results, "result_ts", "60 days")
    return _run(spark, stream, "first").select("model_id", "dataset_name", "task_id")


def stream_windows(spark, sf_dir):
    """Metrics per six-hour window; windows are final once the watermark passed."""
    results = _event_stream(spark, sf_dir, "fx_task_results")
    stream = scoring.windowed_metrics(results, "result_ts", "6 hours", "1 day")
    rows = _run(spark, stream, "windows")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return rows.select(
        stamp("window_start"), stamp("window_end"), "model_id", "dataset_name", "n_results", "pass_rate"
    )


QUERIES = {
    f.__name__: f
    for f in (
        results_round_trip, missing_results, latest_run_stored, prepared_reuse, generations_read,
        file_kinds, log_telemetry, stream_score, stream_first_per_task, stream_windows,
        result_source_pushdown, result_source_latest, result_source_stream, stream_resume_state,
    )
}

ORACLES = {
    "results_round_trip": with_views(
        ["fx_task_results"],
        """SELECT CAST(result_id AS string) AS completion, concat('org/', model_id) AS model_name, model_id,
          strftime(result_ts, '%Y-%m-%d') AS run_ts, dataset_name, task_id, token_count, passed,
          CASE WHEN passed THEN 1.0E0 END AS pass_rate,
          CASE WHEN NOT passed THEN concat('Sandbox failed: "x"', chr(10), 'line') END AS error_message,
          concat('task ', task_id) AS prompt
        FROM fx_task_results""",
    ),
    "missing_results": with_views(["fx_tasks"], "SELECT task_id FROM fx_tasks"),
    "latest_run_stored": with_views(
        ["fx_task_results"],
        """+ runs AS (SELECT *, strftime(result_ts, '%Y-%m-%d') AS run_ts FROM fx_task_results WHERE model_id = 'model_1')
        SELECT CAST(result_id AS string) AS completion, run_ts, task_id, token_count FROM runs
        WHERE run_ts = (SELECT max(run_ts) FROM runs)""",
    ),
    "result_source_pushdown": with_views(
        ["fx_task_results"],
        """SELECT CAST(result_id AS string) AS completion, concat('org/', model_id) AS model_name, strftime(result_ts, '%Y-%m-%d') AS run_ts,
          task_id, token_count, CASE WHEN NOT passed THEN concat('Sandbox failed: "x"', chr(10), 'line') END AS error_message,
          concat('task ', task_id) AS prompt
        FROM fx_task_results WHERE model_id = 'model_1' AND strftime(result_ts, '%Y-%m-%d') >= '2024-01-10' AND token_count > 20""",
    ),
    "result_source_latest": with_views(
        ["fx_task_results"],
        """+ runs AS (SELECT *, strftime(result_ts, '%Y-%m-%d') AS run_ts FROM fx_task_results)
        SELECT model_id, run_ts, CAST(result_id AS string) AS completion, token_count FROM runs
        QUALIFY run_ts = max(run_ts) OVER (PARTITION BY model_id)""",
    ),
    "result_source_stream": with_views(
        ["fx_task_results"],
        "SELECT model_id, strftime(result_ts, '%Y-%m-%d') AS run_ts, CAST(result_id AS string) AS completion FROM fx_task_results",
    ),
    "stream_resume_state": with_views(
        ["fx_task_results"],
        """+ answered AS (SELECT * FROM fx_task_results WHERE token_count > 0),
        done AS (SELECT DISTINCT model_id, dataset_name, task_id FROM answered WHERE CAST(task_id AS int) % 3 = 0),
        firsts AS (SELECT * FROM answered ANTI JOIN done USING (model_id, dataset_name, task_id)
          QUALIFY row_number() OVER (PARTITION BY model_id, dataset_name, task_id ORDER BY result_ts, result_id) = 1)
        SELECT model_id, dataset_name, task_id, CAST(result_id AS string) AS completion, strftime(result_ts, '%Y-%m-%d') AS run_ts, token_count, passed
        FROM firsts WHERE date_trunc('millisecond', result_ts) <=
          (SELECT date_trunc('millisecond', max(result_ts)) - INTERVAL '8 days' FROM answered)""",
    ),
    "prepared_reuse": """
        SELECT doc_id AS seq_id, concat(chr(10), 'import json', chr(10), 'results = [bool(f(1) == 1)]', chr(10), 'print(json.dumps(results))') AS tests
        FROM documents""",
    "generations_read": with_views(
        ["fx_generations"],
        """SELECT CAST(sample_id AS string) AS task_id, CASE WHEN token_count > 0 THEN 'answer' ELSE '' END AS completion,
          token_count, CASE WHEN token_count > 0 THEN generation_time ELSE 0.0E0 END AS generation_time, 0.0E0 AS throughput
        FROM fx_generations""",
    ),
    "file_kinds": """
        SELECT page_id, page_id % 4 = 1 AS is_binary,
          CASE page_id % 4 WHEN 0 THEN length(html) WHEN 2 THEN length(html) + 1025 END AS n_chars,
          CASE page_id % 4 WHEN 0 THEN md5(html) WHEN 2 THEN md5(concat(repeat('a', 1024), chr(0), html)) END AS text_md5
        FROM pages""",
    "log_telemetry": with_views(
        ["fx_executions"],
        """+ logs AS (SELECT CASE WHEN exec_id % 50 <> 0 THEN exec_id END AS line, * FROM fx_executions)
        SELECT CASE WHEN line IS NOT NULL THEN sandbox_type END AS sandbox,
          CASE WHEN line IS NOT NULL THEN CASE WHEN exit_code = 0 THEN 'DEBUG' ELSE 'ERROR' END END AS level,
          count(*) AS n, round(avg(CASE WHEN line IS NOT NULL THEN duration_sec END), 9) AS mean_sec,
          CAST(max(line) AS INTEGER) AS last_line,
          strftime(max(CASE WHEN line IS NOT NULL THEN start_time END), '%Y-%m-%d %H:%M:%S') AS last_time
        FROM logs GROUP BY 1, 2""",
    ),
    "stream_score": with_views(
        ["fx_executions"], f"+ {PARSED} SELECT exec_id, passed, pass_rate FROM verdict"
    ),
    "stream_first_per_task": with_views(
        ["fx_task_results"],
        "SELECT DISTINCT model_id, dataset_name, task_id FROM fx_task_results WHERE token_count > 0",
    ),
    "stream_windows": with_views(
        ["fx_task_results"],
        """+ windows AS (
          SELECT time_bucket(INTERVAL '6 hours', result_ts) AS started, model_id, dataset_name,
            count(*) AS n_results, count(*) FILTER (WHERE passed) / count(*) AS pass_rate
          FROM fx_task_results WHERE token_count > 0 GROUP BY 1, 2, 3)
        SELECT strftime(started, '%Y-%m-%d %H:%M:%S') AS window_start,
          strftime(started + INTERVAL '6 hours', '%Y-%m-%d %H:%M:%S') AS window_end,
          model_id, dataset_name, n_results, pass_rate
        FROM windows WHERE started + INTERVAL '6 hours' <=
          (SELECT date_trunc('millisecond', max(result_ts)) - INTERVAL '1 day' FROM fx_task_results WHERE token_count > 0)""",
    ),
}
