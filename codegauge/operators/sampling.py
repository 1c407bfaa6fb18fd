"""The seeded sample in one pass: the rows with the least hashes, kept in bounded heaps.

A heap holds the ``n`` least rows it has seen; two heaps merge to the heap of both.  So a
sample of a whole is made of samples of parts: of tasks, or of the batches of a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codegauge.operators.prepare import sample_rank
from codegauge.storage import list_paths

_PLACE = ["__place", "__key", "__spread"]


class Heap:
    """The ``n`` least rows by some columns, nulls first."""

    def __init__(self, n: int, by: list[str]):
        self.n, self.by = n, by
        self.rows: pa.Table | None = None

    def add(self, rows: pa.Table) -> None:
        """Take rows in; more than twice ``n`` are never held after a cut."""
        if self.rows is not None and self.rows.num_rows == self.n:
            # most rows of a long table come after the greatest of the heap
            worst = self.rows[self.by[0]][-1]
            rows = rows.filter(pc.less_equal(rows[self.by[0]], worst))
        if not rows.num_rows:
            return
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        order = pc.sort_indices(rows, [(c, "ascending") for c in self.by], null_placement="at_start")
        self.rows = rows.take(order[: self.n]).combine_chunks()

    def merge(self, other: "Heap") -> None:
        if other.rows is not None:
            self.add(other.rows)


def _least(n: int, by: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap = Heap(n, by)
        for batch in batches:
            heap.add(pa.Table.from_batches([batch]))
        if heap.rows is not None:
            yield from heap.rows.to_batches()

    return keep


def _placed(df: DataFrame, key: str, seed: int, spread_by: list[str]) -> DataFrame:
    spread = F.concat_ws(",", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in spread_by])
    return df.withColumns({"__place": sample_rank(F.col(key), seed, spread), "__key": F.col(key), "__spread": spread})


def _merged(placed: DataFrame, n: int) -> DataFrame:
    """Heaps of tasks, then of as many tasks as a shuffle has, then one: a task takes at
    most ``n`` rows of each task before it and holds ``n``."""
    keep = _least(n, _PLACE)
    spark = placed.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    fields = placed.schema
    parts = placed.mapInArrow(keep, fields).repartition(partitions)
    return parts.mapInArrow(keep, fields).repartition(1).mapInArrow(keep, fields)


def sample_one_pass(df: DataFrame, key: str, num_samples: int, seed: int, spread_by: list[str]) -> DataFrame:
    """The rows of ``sample_rows``, with one scan of the table and no second job."""
    return _merged(_placed(df, key, seed, spread_by), num_samples).drop(*_PLACE)


def read_sample(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest finished sample of a stream, or None."""
    finished = list_paths(spark, f"{folder}/batch=*/_SUCCESS")
    if not finished:
        return None
    newest = max(int(p.rsplit("/batch=", 1)[1].split("/")[0]) for p in finished)
    return spark.read.parquet(f"{folder}/batch={newest}").drop(*_PLACE)


def sample_stream(
    rows: DataFrame, folder: str, checkpoint: str, key: str, num_samples: int, seed: int, spread_by: list[str]
) -> StreamingQuery:
    """Keep the sample of all rows so far: after each batch the heap of the last one is
    merged with the batch's.  A batch that is run again starts from the heap before it."""

    def update(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        placed = _placed(batch, key, seed, spread_by)
        before = [int(p.rsplit("/batch=", 1)[1].split("/")[0]) for p in list_paths(spark, f"{folder}/batch=*/_SUCCESS")]
        before = max((b for b in before if b < batch_id), default=None)
        if before is not None:
            placed = placed.unionByName(spark.read.parquet(f"{folder}/batch={before}"))
        _merged(placed, num_samples).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(update).start()
