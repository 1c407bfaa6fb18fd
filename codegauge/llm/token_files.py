"""Token ids of documents as ORC files in ascending id order.

One row per document: id, part, first (ids before it in the part), n_tokens, ids.  ORC
keeps the numbers run-length encoded in stripes, with an index entry every
``INDEX_ROWS`` rows and a Bloom filter on the id, so Spark reads stripes in parallel
and skips stripes and index groups a filter on the id rules out.

Rows are dealt by ranges of (id, text hash): a part holds a range, parts follow each
other, and repeated ids spread over parts.  Place in the whole stream = ids of the parts
before (one row per part, summed in order) + place in the part.

Defined results: a null text counts as empty and holds the end id alone; repeated rows
are written each, in order of their text hash; null ids come first; an empty table gives
a folder that reads back empty.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codegauge.llm.tokens import encoded, worker_encoder

INDEX_ROWS = 1_000
OPTIONS = {
    "orc.stripe.size": str(16 << 20),
    "orc.row.index.stride": str(INDEX_ROWS),
    "orc.bloom.filter.columns": "id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.compress": "zstd",
}


def _add_part(batch: pa.RecordBatch, part: int, first: np.ndarray, offsets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    arrays = [
        batch.column(0),
        pa.array(np.full(batch.num_rows, part), pa.int32()),
        pa.array(first, pa.int64()),
        pa.array(np.diff(offsets), pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["id", "part", "first", "n_tokens", "ids"])


def write(df: DataFrame, path: str, tokenizer_path: str, blanks: str = "kept", id_col: str = "doc_id", text_col: str = "text", end_id: int = 0) -> None:
    """Encode every text, append ``end_id``, and write the ORC files at ``path``."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, before = worker_encoder(tokenizer_path, blanks), TaskContext.get().partitionId(), 0
        for batch, offsets, ids in encoded(batches, 1, encoder, end_id):
            yield _add_part(batch, part, before + offsets[:-1], offsets, ids)
            before += len(ids)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))
    rows = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    rows = rows.mapInArrow(encode, f"id {id_type}, part int, first long, n_tokens long, ids array<int>")
    rows.write.mode("errorifexists").options(**OPTIONS).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, part, first, n_tokens, ids) as stored."""
    return spark.read.orc(path)


def part_starts(stored: DataFrame) -> DataFrame:
    """(part, before): ids in all earlier parts.  One row per part, so one task orders them."""
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", F.coalesce(before, F.lit(0)).alias("before"))


def stream_places(stored: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every stored document, from its stored ids."""
    id_type = stored.schema["id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            offsets = ids.offsets.to_pylist()
            data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets), pa.int64()), pa.array(crc, pa.int64())], ["id", "part", "first", "n_tokens", "ids_crc32"])

    rows = stored.select("id", "part", "first", "ids").mapInArrow(digest, f"id {id_type}, part int, first long, n_tokens long, ids_crc32 long")
    # one row per part: bounded by the number of files
    rows = rows.join(F.broadcast(part_starts(stored)), "part")
    return rows.select("id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")
