"""Data-set metrics kept up to date batch by batch.

The state is a folder: the newest answered row of each task, in hash buckets, and the
sums of each model and data set.  A batch reads itself, the buckets its tasks lie in and
the sums.  Where its answer of a task is newer than the stored one, the old row's share
is taken out of the sums and the new one's put in.  Sums are integers and decimals, so
what is taken out is exactly what was put in.

Each batch writes tables of its own and then one small commit that names the newest
table of every bucket; a batch that stopped half way, or is run again, changes nothing
that a commit names.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codegauge.operators.checkpoints import answered
from codegauge.operators.metrics import RESULT_KEY, latest_per_task
from codegauge.storage import list_paths

BUCKETS = 64
GROUP = ["model_id", "dataset_name"]
_SUMS = ["completed_tasks", "passed", "formatted", "extracted", "seconds", "total_tokens"]
_USED = ["passed", "correct_format", "extraction_success", "sandbox_execution_time", "token_count"]


class MetricState:
    """The folder of a state and its newest commit."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def commits(self) -> list[int]:
        return sorted(int(p.rsplit("commit=", 1)[1].split("/")[0]) for p in list_paths(self.spark, f"{self.folder}/commit=*/_SUCCESS"))

    def tables(self, before: int | None = None) -> dict:
        """{"sums": batch or None, "buckets": {bucket: batch}} of the newest commit (before one)."""
        numbers = [n for n in self.commits() if before is None or n < before]
        if not numbers:
            return {"sums": None, "buckets": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/commit={numbers[-1]}").first()[0])

    def commit(self, batch: int, tables: dict) -> None:
        text = self.spark.createDataFrame([(json.dumps(tables),)], "value string")
        text.coalesce(1).write.mode("overwrite").text(f"{self.folder}/commit={batch}")

    def newest(self, buckets: dict[str, int], schema) -> DataFrame:
        """Stored rows of some buckets."""
        paths = [f"{self.folder}/batch={b}/tasks/bucket={k}" for k, b in buckets.items()]
        paths = [p for p in paths if list_paths(self.spark, p)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def _shares(rows: DataFrame, sign: int) -> DataFrame:
    """What each row adds to the sums of its group."""
    one = lambda flag: F.when(F.col(flag), sign).otherwise(0).cast("long")
    return rows.select(
        *GROUP, F.lit(sign).cast("long").alias("completed_tasks"), one("passed").alias("passed"),
        one("correct_format").alias("formatted"), one("extraction_success").alias("extracted"),
        (F.coalesce("sandbox_execution_time", F.lit(0.0)).cast("decimal(28,12)") * sign).cast("decimal(38,12)").alias("seconds"),
        (F.col("token_count").cast("long") * sign).alias("total_tokens"),
    )


def update_metrics(
    results: DataFrame, folder: str, batch: int, order_by: str = "result_ts", tie_breaker: str = "result_id", buckets: int = BUCKETS
) -> None:
    """Take one batch of results into the state; the number of a batch tells it apart."""
    spark = results.sparkSession
    state = MetricState(spark, folder)
    if batch in state.commits():
        return
    tables = state.tables(before=batch)
    rows = results.where(answered()).select(*RESULT_KEY, *_USED, order_by, tie_breaker)
    bucket = F.pmod(F.xxhash64(*RESULT_KEY), F.lit(buckets)).cast("int")
    home = f"{state.folder}/batch={batch}"
    # rebalanced: a large bucket is written by several tasks, each of which sorts its part alone
    latest_per_task(rows, order_by, tie_breaker).withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/new")
    touched = [p.rsplit("bucket=", 1)[1] for p in list_paths(spark, f"{home}/new/bucket=*")]
    if not touched:
        state.commit(batch, tables)
        return
    fresh = spark.read.schema(rows.schema).parquet(*[f"{home}/new/bucket={b}" for b in touched])
    stored = state.newest({b: tables["buckets"][b] for b in touched if b in tables["buckets"]}, rows.schema)

    old = stored.select(*[F.col(c).alias(f"__old_{c}") for c in rows.columns])
    same = [F.col(c).eqNullSafe(F.col(f"__old_{c}")) for c in RESULT_KEY]
    both = fresh.withColumn("__new", F.lit(True)).join(old.withColumn("__old", F.lit(True)), same, "full")
    # places compare as in ``latest_per_task``
    newer = F.struct(order_by, tie_breaker) > F.struct(F.col(f"__old_{order_by}"), F.col(f"__old_{tie_breaker}"))
    taken = F.col("__old").isNull() | (F.col("__new").isNotNull() & newer)
    both = both.withColumn("__taken", taken)
    kept = both.select(*[F.when(F.col("__taken"), F.col(c)).otherwise(F.col(f"__old_{c}")).alias(c) for c in rows.columns])
    kept.withColumn("bucket", bucket).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{home}/tasks")

    came = both.where("__taken")
    left = came.where("__old").select(*[F.col(f"__old_{c}").alias(c) for c in rows.columns])
    change = _shares(came, 1).unionByName(_shares(left, -1))
    sums = change
    if tables["sums"] is not None:
        sums = change.unionByName(spark.read.parquet(f"{state.folder}/batch={tables['sums']}/sums"))
    sums = sums.groupBy(*GROUP).agg(*[F.sum(c).cast("decimal(38,12)" if c == "seconds" else "long").alias(c) for c in _SUMS])
    sums.write.mode("overwrite").parquet(f"{home}/sums")
    state.commit(batch, {"sums": batch, "buckets": {**tables["buckets"], **{b: batch for b in touched}}})


def stored_metrics(spark: SparkSession, folder: str, batch: int | None = None) -> DataFrame:
    """``dataset_metrics`` with the newest answer of each task, from the sums alone; those
    after a given batch, or the newest."""
    state = MetricState(spark, folder)
    source = state.tables(None if batch is None else batch + 1)["sums"]
    if source is None:
        fields = "pass_rate double, format_success_rate double, extraction_success_rate double, avg_sandbox_execution_time double, total_tokens long, avg_tokens double, completed_tasks long"
        return spark.createDataFrame([], f"model_id string, dataset_name string, {fields}")
    n = F.col("completed_tasks")
    sums = spark.read.parquet(f"{state.folder}/batch={source}/sums")
    return sums.select(
        *GROUP, (F.col("passed") / n).alias("pass_rate"), (F.col("formatted") / n).alias("format_success_rate"),
        (F.col("extracted") / n).alias("extraction_success_rate"), (F.col("seconds").cast("double") / n).alias("avg_sandbox_execution_time"),
        "total_tokens", (F.col("total_tokens") / n).alias("avg_tokens"), "completed_tasks",
    )


def metrics_stream(results: DataFrame, folder: str, checkpoint: str, **options) -> StreamingQuery:
    """Keep the metrics of a stream of results."""
    return (
        results.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .foreachBatch(lambda batch, number: update_metrics(batch, folder, number, **options)).start()
    )
