"""Resuming an evaluation as a stream with keyed state.

Each task of a model has a state of its own.  Stored results are the initial state: their
tasks are done.  For the others the answered result that is first by event time (then by
a tie breaker) is kept until the watermark has passed it; no earlier one can arrive then,
so it is final, is sent on once, and the task is done.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from codegauge.operators.checkpoints import answered
from codegauge.sources import result_source
from codegauge.streaming.scoring import RESULT_KEY

#: Keyed state with timers and initial state needs this store.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class FirstAnswer(StatefulProcessor):
    """Rows (key, micros, tie, payload) -> the first of each key, when it is final."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "micros long, tie string, payload string")
        self.done = handle.getValueState("done", "done boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.done.update((True,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if not self.done.exists():
            before = self.best.get()
            best = before
            for part in rows:
                first = min(zip(part["micros"].tolist(), part["tie"].tolist(), part["payload"].tolist()))
                best = first if best is None else min(best, first)
            if best != before:
                if before is not None:
                    self.handle.deleteTimer(before[0] // 1000)
                self.handle.registerTimer(best[0] // 1000)
                self.best.update(tuple(best))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, _, payload = self.best.get()
        self.best.clear()
        self.done.update((True,))
        yield pd.DataFrame({"payload": [payload]})

    def close(self) -> None:
        pass


def first_answers(results: DataFrame, stored: DataFrame, event_time: str, tie_breaker: str, delay: str) -> DataFrame:
    """First answered result of every task that ``stored`` has no answer for.

    ``results`` is a stream with the columns of ``RESULT_KEY``, ``token_count``,
    ``event_time`` and a tie breaker; all its columns are kept.
    """
    spark = results.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = results.schema
    # the payload is the row as it was; times keep their microseconds
    payload = F.to_json(F.struct(*results.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    # every type of tie breaker as text of one length where it is a number
    tie = F.col(tie_breaker).cast("string")
    tie = F.lpad(tie, 20, "0") if schema[tie_breaker].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint") else tie
    rows = results.where(answered()).withWatermark(event_time, delay)
    rows = rows.select(*RESULT_KEY, event_time, F.unix_micros(event_time).alias("micros"), F.coalesce(tie, F.lit("")).alias("tie"), payload.alias("payload"))
    done = stored.where(answered()).select(*RESULT_KEY).distinct()
    first = rows.groupBy(*RESULT_KEY).transformWithStateInPandas(
        FirstAnswer(), "payload string", "Append", "EventTime", initialState=done.groupBy(*RESULT_KEY)
    )
    row = F.from_json("payload", schema, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    return first.select(row.alias("row")).select("row.*")


def append_to_store_stream(stream: DataFrame, path: str, checkpoint: str, name: str) -> StreamingQuery:
    """Append task results (``STORED_RESULT`` columns) to a store, each batch in one commit."""
    result_source.register(stream.sparkSession)
    return (
        stream.writeStream.format(result_source.NAME).outputMode("append").option("stream", name)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    )


def resume_into_store(results: DataFrame, path: str, checkpoint: str, name: str, event_time: str, tie_breaker: str, delay: str) -> StreamingQuery:
    """Add to a store what its tasks still lack: the first answers of a stream.

    What the store holds when the stream starts is the initial state; later starts go on
    from the stream's checkpoint.
    """
    spark: SparkSession = results.sparkSession
    stored = result_source.read_store(spark, path).select(*RESULT_KEY, "token_count")
    first = first_answers(results, stored, event_time, tie_breaker, delay)
    columns = [F.col(f.name).cast(f.dataType) if f.name in first.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in result_source.STORED_RESULT]
    return append_to_store_stream(first.select(*columns), path, checkpoint, name)
