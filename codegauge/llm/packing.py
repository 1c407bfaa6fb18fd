"""Best-fit packing of token pieces into sequences under several capacities.

A document's ids (with an end id) are cut into pieces of at most ``max_tokens``.  Full
pieces are sequences of their own.  The others are dealt by hash into groups of about
``GROUP_ROWS`` and packed there, longest first: among the open sequences that have room
in every dimension (tokens, documents, attention cost = sum of squared lengths) the
best is taken, by the weighted norm of the residual it would leave or by the weighted
dot product of demand and residual.  A group loses at most its last sequences, so groups
cost about 0.02 % more sequences than one list would, and nothing is ever in one task.

Defined results: a null text counts as empty and makes one piece holding the end id;
repeated rows are packed each; a null id is kept; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.llm.tokens import encoded, worker_encoder
from codegauge.storage import stage

#: Pieces packed together; bounds a group's memory and its time.
GROUP_ROWS = 8192


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds.  The defaults for documents and cost bind only together
    with the tokens; smaller ones cost sequences."""

    tokens: int = 2048
    documents: int = 2048
    cost: int = 2048 * 2048
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01)
    select: str = "norm"


def pack_lengths(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length; vector best fit, longest first."""
    if capacity.select not in ("norm", "dot"):
        raise ValueError(f"select: {capacity.select!r}")
    limits = np.array([capacity.tokens, capacity.documents, capacity.cost], np.float64)
    weights = np.array(capacity.weights)
    n = len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    room = np.zeros((n, 3))
    open_ids = np.zeros(n, np.int64)  # sequence number of each open row
    n_open = n_sequences = 0
    order = np.argsort(-lengths, kind="stable")
    least = lengths.min() if n else 0
    for k in order:
        length = int(lengths[k])
        demand = np.array([length, 1, length * length], np.float64)
        if (demand > limits).any():
            raise ValueError(f"a piece of {length} tokens exceeds the capacity")
        rest = room[:n_open]
        fits = np.flatnonzero((rest >= demand).all(axis=1))
        if len(fits):
            if capacity.select == "norm":
                value = (((rest[fits] - demand) / limits) ** 2 * weights).sum(axis=1)
                best = fits[np.argmin(value)]
            else:
                value = ((rest[fits] / limits) * (demand / limits) * weights).sum(axis=1)
                best = fits[np.argmax(value)]
        else:
            best = n_open
            room[best], open_ids[best] = limits, n_sequences
            n_open += 1
            n_sequences += 1
        sequence[k], offset[k] = open_ids[best], capacity.tokens - room[best, 0]
        room[best] -= demand
        if room[best, 0] < least or room[best, 1] < 1 or room[best, 2] < least * least:  # nothing fits any more
            n_open -= 1
            room[best], open_ids[best] = room[n_open], open_ids[n_open]
    return sequence, offset


def token_pieces(df: DataFrame, tokenizer_path: str, blanks: str, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every document's pieces."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    ids_field = ", ids array<int>" if with_ids else ""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(tokenizer_path, blanks)
        for batch, offsets, ids in encoded(batches, 1, encoder, end_id):
            counts = -(-np.diff(offsets) // max_tokens)
            row = np.repeat(np.arange(batch.num_rows), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            begin = offsets[row] + piece * max_tokens
            end = np.minimum(begin + max_tokens, offsets[row + 1])
            data = memoryview(np.ascontiguousarray(ids, "<i4")).cast("B")
            crc = [zlib.crc32(data[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist())]
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(piece * max_tokens, pa.int64()), pa.array(end - begin, pa.int64()), pa.array(crc, pa.int64())]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[begin, end[-1:]] if len(begin) else [0], pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(cut, f"id {id_type}, piece int, start long, length long, ids_crc32 long{ids_field}")


def pack(pieces: DataFrame, capacity: Capacity = Capacity(), group_rows: int = GROUP_ROWS) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to stored pieces (a column ``length``).

    ``pieces`` is read twice: to count, and to pack.
    """
    numbered = pieces.withColumn("__p_row", F.monotonically_increasing_id())
    alone = (F.col("length") >= capacity.tokens) & F.lit(capacity.documents >= 1)
    full = numbered.where(alone).select(*[f"`{c}`" for c in pieces.columns], (-1 - F.col("__p_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    groups = max(1, -(-pieces.where(~alone).count() // group_rows))
    dealt = numbered.where(~alone).withColumn("__p_group", F.pmod(F.xxhash64("__p_row"), F.lit(groups))).drop("__p_row")

    def best_fit(table: pa.Table) -> pa.Table:
        group = table.column("__p_group")[0].as_py()
        sequence, offset = pack_lengths(table.column("length").to_numpy(), capacity)
        table = table.drop_columns(["__p_group"])
        return table.append_column("sequence_id", pa.array(sequence + (group << 32))).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    packed = dealt.groupBy("__p_group").applyInArrow(best_fit, f"{fields}, sequence_id long, offset long")
    return full.unionByName(packed)


def pack_documents(df: DataFrame, tokenizer_path: str, blanks: str = "dropped", id_col: str = "doc_id", text_col: str = "text", capacity: Capacity = Capacity(), end_id: int = 0) -> DataFrame:
    """Pieces of all documents with their places; ids are made once, their pieces stored."""
    pieces = token_pieces(df, tokenizer_path, blanks, id_col, text_col, capacity.tokens, end_id)
    return pack(stage(pieces, "packing-pieces"), capacity)
