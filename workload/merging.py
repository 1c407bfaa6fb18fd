"""Results made of mergeable parts: samples, sketches, metrics by batches; rows paired by place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge import storage
from codegauge.operators import dispatch, incremental, metrics, positions, sampling, sketches
from workload.evaluation import METRICS, _rounded
from workload.outcomes import _executions
from workload.preparation import ORACLES as PREPARATION_ORACLES
from workload.views import table, view, with_views

#: Rows of a staged file; a reader's task takes whole files.
FILE_ROWS = 250_000


def sample_one_pass(spark, sf_dir):
    """The rows of ``sample_seeded`` from one scan."""
    events = table(spark, sf_dir, "events").withColumn("key", F.when(F.col("event_id") % 5 > 0, F.col("event_id")))
    return sampling.sample_one_pass(events, "key", 2500, 7, ["event_id"]).select("event_id", "user_id", "value")


def sample_batches(spark, sf_dir):
    """The same rows again, kept up to date over three batches of a stream, one per start."""
    events = table(spark, sf_dir, "events").withColumn("key", F.when(F.col("event_id") % 5 > 0, F.col("event_id")))
    events = events.select("event_id", "user_id", "value", "key")
    folder, home = storage.new_path(spark, "arriving"), storage.new_path(spark, "sample")
    state = storage.new_path(spark, "sample-state")
    for k in range(3):
        # each reading task writes its share: no task sorts or holds a batch
        rows = events.where(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)
        rows.write.mode("append").option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
        stream = spark.readStream.schema(events.schema).parquet(folder)
        sampling.sample_stream(stream, home, state, "key", 2500, 7, ["event_id"]).awaitTermination()
    return sampling.read_sample(spark, home).select("event_id", "user_id", "value")


def telemetry_merged(spark, sf_dir):
    """Telemetry of all days from one stored row per day and engine.

    The sketch's median differs from run to run within its bound, so what is told of it
    is whether its exact rank keeps twice the bound (99 % of medians keep it once).
    """
    executions = _executions(spark, sf_dir)
    path = storage.new_path(spark, "telemetry")
    sketches.telemetry_parts(executions.withColumn("day", F.to_date("start_time")), ["day"]).write.parquet(path)
    merged = sketches.merged_telemetry(spark.read.parquet(path))
    merged = storage.stage(merged, "telemetry-merged")
    ranks = executions.withColumn("sandbox_type", metrics.checked_engine(F.col("sandbox_type"))).join(
        F.broadcast(merged.select("sandbox_type", "median_sec")), "sandbox_type"  # four engines at most
    ).groupBy("sandbox_type").agg(
        (F.count_if(F.col("duration_sec") < F.col("median_sec")) / F.count("duration_sec")).alias("below"),
        (F.count_if(F.col("duration_sec") <= F.col("median_sec")) / F.count("duration_sec")).alias("upto"),
    )
    bound = 2 * sketches.rank_error()
    within = (F.col("below") <= 0.5 + bound) & (F.col("upto") >= 0.5 - bound)
    told = merged.join(ranks, "sandbox_type").select("sandbox_type", "n", "share", "mean_sec", within.alias("median_within_bound"), "success_rate", "runs_per_sec")
    return _rounded(told, "mean_sec", "runs_per_sec")


def metrics_incremental(spark, sf_dir):
    """Metrics of each task's newest answer, after each of three batches of a stream.

    Answers of a task come in any order, so a later batch may hold older ones.
    """
    results = view(spark, sf_dir, "fx_task_results").withColumn("result_ts", F.col("result_ts").cast("timestamp"))
    folder, home = storage.new_path(spark, "arriving"), storage.new_path(spark, "metrics")
    number = F.col("result_id") * 7 % 3
    for k in range(3):
        # each reading task writes its share: no task sorts or holds a batch
        results.where(number == k).write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{folder}/batch={k}")
        incremental.update_metrics(spark.read.schema(results.schema).parquet(f"{folder}/batch={k}"), home, k, buckets=16)
    after = [incremental.stored_metrics(spark, home, k).withColumn("batch", F.lit(k)) for k in range(3)]
    return _rounded(reduce(DataFrame.unionByName, after), "avg_sandbox_execution_time")


def positional_zip(spark, sf_dir):
    """Generations and executions paired by their place, neither of which has the other's key."""
    generations = view(spark, sf_dir, "fx_generations").where("token_count > 0").select("sample_id", "token_count")
    runs = view(spark, sf_dir, "fx_executions").where("exit_code <> 124").select("exec_id", "exit_code")
    return positions.positional_zip(generations, runs, ["sample_id"], [F.col("exec_id").desc()])


SLOTS = 24


def balanced_dispatch(spark, sf_dir):
    """Executions dealt by the mean cost of their prompt's earlier half to slots of equal load.

    The bound is 4/3 of the larger of the mean load and the greatest cost, and a cost step.
    """
    runs = view(spark, sf_dir, "fx_executions").select("exec_id", "prompt_id", "duration_sec")
    later = dispatch.predicted_cost(runs.where("exec_id % 2 = 1").drop("duration_sec"), runs.where("exec_id % 2 = 0"), ["prompt_id"])
    dealt = dispatch.dispatch(later, "predicted_sec", ["exec_id"], SLOTS)
    loads = dealt.groupBy("slot").agg(F.sum("predicted_sec").alias("load"), F.max("predicted_sec").alias("most"), F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.sum("load") / SLOTS, F.max("most"))  # no dealing has a smaller greatest load
    return loads.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_slots"), F.round(F.sum("load"), 6).alias("seconds"),
        (F.max("load") <= least * (4 / 3 * (1 + dispatch.STEP))).alias("within_bound"),
    )


QUERIES = {f.__name__: f for f in (sample_one_pass, sample_batches, telemetry_merged, metrics_incremental, positional_zip, balanced_dispatch)}

ORACLES = {
    "sample_one_pass": PREPARATION_ORACLES["sample_seeded"],
    "sample_batches": PREPARATION_ORACLES["sample_seeded"],
    "telemetry_merged": with_views(
        ["fx_executions"],
        """SELECT sandbox_type, count(*) AS n, count(*) / sum(count(*)) OVER () AS share,
          round(avg(duration_sec), 9) AS mean_sec, true AS median_within_bound,
          sum(CASE WHEN exit_code = 0 AND is_valid_python THEN 1 ELSE 0 END) / count(*) AS success_rate,
          round(count(*) / sum(duration_sec), 9) AS runs_per_sec
        FROM fx_executions GROUP BY sandbox_type""",
    ),
    "metrics_incremental": with_views(
        ["fx_task_results"],
        f"""+ seen AS (
          SELECT r.*, b.batch FROM fx_task_results r, (SELECT CAST(unnest(range(3)) AS INTEGER) AS batch) b
          WHERE r.result_id * 7 % 3 <= b.batch AND token_count > 0),
        ranked AS (
          SELECT *, row_number() OVER (PARTITION BY batch, model_id, dataset_name, task_id ORDER BY result_ts DESC, result_id DESC) AS place
          FROM seen)
        SELECT batch, model_id, dataset_name, {METRICS} FROM ranked WHERE place = 1 GROUP BY batch, model_id, dataset_name""",
    ),
    "positional_zip": with_views(
        ["fx_generations", "fx_executions"],
        """+ a AS (SELECT sample_id, token_count, row_number() OVER (ORDER BY sample_id) - 1 AS position FROM fx_generations WHERE token_count > 0),
        b AS (SELECT exec_id, exit_code, row_number() OVER (ORDER BY exec_id DESC) - 1 AS position FROM fx_executions WHERE exit_code <> 124)
        SELECT position, sample_id, token_count, exec_id, exit_code FROM a JOIN b USING (position)""",
    ),
    "balanced_dispatch": with_views(
        ["fx_executions"],
        f"""+ means AS (SELECT prompt_id, avg(duration_sec) AS mean FROM fx_executions WHERE exec_id % 2 = 0 GROUP BY prompt_id),
        overall AS (SELECT avg(duration_sec) AS mean FROM fx_executions WHERE exec_id % 2 = 0)
        SELECT count(*) AS n_rows, {SLOTS} AS n_slots, round(sum(coalesce(m.mean, o.mean)), 6) AS seconds, true AS within_bound
        FROM fx_executions e LEFT JOIN means m USING (prompt_id), overall o WHERE exec_id % 2 = 1""",
    ),
}
