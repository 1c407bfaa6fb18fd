"""The evaluation loop as Structured Streaming.

New executions are scored as they arrive; the stream's checkpoint takes the place
of a hand-made resume file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codegauge.functions import outcome as O
from codegauge.operators.checkpoints import answered
from codegauge.sources.results import append_results

RESULT_KEY = ["model_id", "dataset_name", "task_id"]


def read_stream(spark: SparkSession, folder: str, schema, fmt: str = "json", pattern: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(folder)


def score_stream(executions: DataFrame, empty_is_pass: bool = True) -> DataFrame:
    """Verdict and pass rate per execution; stateless."""
    outcome = O.parse_outcome(F.col("stdout"))
    return executions.withColumn("__outcome", outcome).withColumns({
        "passed": O.task_passed(F.col("__outcome"), empty_is_pass),
        "pass_rate": O.task_pass_rate(F.col("__outcome")),
    }).drop("__outcome")


def first_per_task(results: DataFrame, event_time: str, delay: str) -> DataFrame:
    """One answered result per task: later copies within the delay are dropped."""
    return (
        results.where(answered())
        .withWatermark(event_time, delay)
        .dropDuplicatesWithinWatermark(RESULT_KEY)
    )


def windowed_metrics(results: DataFrame, event_time: str, window: str, delay: str) -> DataFrame:
    """Pass rate per model, data set and time window of answered results."""
    return (
        results.where(answered())
        .withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window), "model_id", "dataset_name")
        .agg(
            F.count(F.lit(1)).alias("n_results"),
            (F.count_if(F.col("passed")) / F.count(F.lit(1))).alias("pass_rate"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "model_id",
            "dataset_name",
            "n_results",
            "pass_rate",
        )
    )


def append_to(stream: DataFrame, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Process what is there and append it to a Parquet table.

    The file sink keeps a log of finished batches, so a batch that is run again
    after a failure is not stored twice.
    """
    return (
        stream.writeStream.queryName(name)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .format("parquet")
        .start(path)
    )


def append_results_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append task results (``STORED_RESULT`` columns) where ``read_run`` finds them.

    A part is named by the stream's own id, which its checkpoint keeps, and the batch:
    a batch that is run again replaces its part and no other stream's.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        append_results(batch, path, f"{query_id}-{batch_id}")

    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
