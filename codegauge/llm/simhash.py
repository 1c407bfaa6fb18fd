"""SimHash near-duplicates by anchor-point covering.

Two fingerprints link if at most ``THRESHOLD`` = 2 of 64 bits differ; groups are the
connected components of the links.

The search: of two linked fingerprints one half (32 bits) differs in at most one bit.
In each half the anchors are the words of a covering code, the perfect Hamming code of
length 31 times one free bit: every half lies within radius 1 of an anchor.  A
fingerprint goes to every anchor within covering radius plus the half's threshold,
1 + 1 (at most 17 of them), so linked fingerprints meet at an anchor, where they are
compared.  Anchors are words of 32 bits, so they need no table of their own.

What meets at an anchor is compared up to ``MAX_AT_ANCHOR`` fingerprints at once.
Fingerprints at a fuller anchor take an exact second way: each goes to the 65 words
within one bit of itself.  Fingerprints that meet there differ in at most two bits
without any comparison, linked ones always meet (half way), and no more than 65
fingerprints can meet, so nothing is cut off and no pairs are written.

Defined results: a null text counts as empty; a text without words has fingerprint 0
and is grouped like any other; fewer than three words form one shingle; equal
fingerprints (repeated rows, exact copies) are one node of the search; a null id never
names a group unless all ids of the group are null; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from codegauge.operators.joins import skew_join
from codegauge.storage import stage

THRESHOLD = 2
SEED = 42
SHINGLE_WORDS = 3
CODE_BITS = 31
#: Fingerprints compared at once at one anchor.
MAX_AT_ANCHOR = 256
#: Shingles whose bits are counted at once; bounds the memory of very long texts.
CHUNK = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z and the six blanks
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE_WORDS + 1)
    shingles = map(b" ".join, zip(*(words[k : n + k] for k in range(SHINGLE_WORDS)))) if len(words) >= SHINGLE_WORDS else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    ones = np.zeros(64, np.int64)
    while chunk := list(islice(hashes, CHUNK)):
        bits = np.array(chunk, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprint(text: Column) -> Column:
    """Fingerprint column (bigint) of a text column."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_of(t) for t in texts], dtype="int64")

    return simhash(text)


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def anchor_masks(reach: int) -> list[list[int]]:
    """For each syndrome of the length-31 code: what to flip in a half to get to every
    anchor within ``reach``.  Bit 31 of a half belongs to no code word: it is free."""
    masks: list[list[int]] = [[] for _ in range(CODE_BITS + 1)]
    for weight in range(reach + 1):
        for bits in combinations(range(CODE_BITS + 1), weight):
            syndrome, mask = 0, 0
            for bit in bits:
                mask |= 1 << bit
                syndrome ^= bit + 1 if bit < CODE_BITS else 0
            masks[syndrome].append(mask)
    return masks


def _syndrome(half: Column) -> Column:
    """XOR of the (1-based) positions of the set bits among the first 31."""
    total = F.lit(0)
    for k in range(5):
        members = sum(1 << bit for bit in range(CODE_BITS) if (bit + 1) >> k & 1)
        total = total + F.pmod(F.bit_count(half.bitwiseAND(F.lit(members))), F.lit(2)) * (1 << k)
    return total


def anchors(fps: DataFrame) -> DataFrame:
    """(anchor, fp) for each distinct ``fp``; bit 32 of an anchor tells the half."""
    masks = F.lit(anchor_masks(1 + THRESHOLD // 2)).cast("array<array<bigint>>")
    low = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    high = F.shiftrightunsigned("fp", 32)
    halves = fps.select("fp", F.explode(F.array(F.struct(low.alias("half"), F.lit(0).cast("long").alias("part")), F.struct(high.alias("half"), F.lit(1 << 32).alias("part")))).alias("h"))
    flips = halves.select("fp", "h.half", "h.part", F.explode(F.element_at(masks, (_syndrome(F.col("h.half")) + 1).cast("int"))).alias("mask"))
    return flips.select(F.col("half").bitwiseXOR(F.col("mask")).bitwiseOR(F.col("part")).alias("anchor"), "fp")


def _compare_group(fps: np.ndarray) -> list[tuple[int, int]]:
    """(fp, smallest fp it is connected with) for linked members of one anchor."""
    near = np.bitwise_count((fps[:, None] ^ fps[None, :]).view(np.uint64)) <= THRESHOLD
    labels = np.arange(len(fps))
    while True:
        least = np.where(near, labels[None, :], len(fps)).min(axis=1)
        if (least == labels).all():
            break
        labels = least
    return [(int(fps[i]), int(fps[k])) for i, k in enumerate(labels) if k < i]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor -> links (fp, other), and fps of full anchors (fp, null).

    One anchor's rows may cross batches; never more than ``MAX_AT_ANCHOR`` are held.
    """
    anchor, held, full = None, np.empty(0, np.int64), False
    out: list[tuple[int, int | None]] = []

    def close() -> None:
        if not full and len(held) > 1:
            out.extend(_compare_group(held))

    for batch in batches:
        keys, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else []
        ends = np.r_[starts[1:], len(keys)] if len(keys) else []
        # groups of one row, neither first nor last, link nothing
        for k in [k for k in range(len(starts)) if k in (0, len(starts) - 1) or ends[k] - starts[k] > 1]:
            members = fps[starts[k] : ends[k]]
            if keys[starts[k]] != anchor:
                close()
                anchor, held, full = keys[starts[k]], members[:0], False
            if not full and len(held) + len(members) > MAX_AT_ANCHOR:
                out.extend((int(fp), None) for fp in held)
                held, full = members[:0], True
            if full:
                out.extend((int(fp), None) for fp in members)
            else:
                held = np.concatenate([held, members])
        yield _links_batch(out)
        out = []
    close()
    yield _links_batch(out)


def _links_batch(rows: list[tuple[int, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["fp", "other"])


def links(fps: DataFrame) -> DataFrame:
    """Links (fp, other) that connect what is within the threshold, for distinct ``fp``.

    Not all pairs: enough of them to connect each component.
    """
    met = anchors(fps)
    met = met.repartition("anchor").sortWithinPartitions("anchor", "fp")
    found = stage(met.mapInArrow(_compare, "fp long, other long"), "simhash-links")
    near = F.explode(F.concat(F.array(F.col("fp")), F.array(*[F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)])))
    crowded = found.where(F.col("other").isNull()).select("fp").distinct().select("fp", near.alias("word"))
    least = F.min("fp").over(Window.partitionBy("word"))  # at most 65 rows each
    crowded = crowded.select("fp", least.alias("other")).where("fp <> other")
    return found.where(F.col("other").isNotNull()).unionByName(crowded).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(fp, root) for every node of the links (fp, other), by repeated contraction.

    In each round a node moves to the neighbour (or itself) that a fresh hash puts
    first, so the rest shrinks by a constant share whatever the graph looks like.
    Each round's moves are a table in the shared folder; then they are composed.
    """
    rounds: list[DataFrame] = []
    edges = edges.select(F.col("fp").alias("a"), F.col("other").alias("b")).where("a <> b")
    while True:
        both = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-graph")
        if both.isEmpty():
            break
        moves = stage(_moves(both, len(rounds)), "simhash-moves")
        rounds.append(moves)
        a = moves.select(F.col("fp").alias("a"), F.col("to").alias("a_to"))
        b = moves.select(F.col("fp").alias("b"), F.col("to").alias("b_to"))
        edges = both.join(a, "a").join(b, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a < b").distinct()
    if not rounds:
        return both.select(F.col("a").alias("fp"), F.col("b").alias("root"))
    roots = rounds[-1].select("fp", F.col("to").alias("root"))
    for moves in reversed(rounds[:-1]):
        later = roots.select(F.col("fp").alias("to"), "root")
        roots = moves.join(later, "to", "left").select("fp", F.coalesce("root", "to").alias("root"))
    return roots


def _moves(both: DataFrame, salt: int) -> DataFrame:
    order = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))
    first = both.groupBy("a").agg(F.min(order("b")).alias("first"))
    return first.select(F.col("a").alias("fp"), F.least("first", order("a"))["n"].alias("to"))


def group(ids: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Rows (id, fp) -> rows (id, fp, root, component_id); ``ids`` is read several times,
    so it should be a stored table.  ``component_id`` is the smallest id of the group.
    ``found`` are the links, those within ``THRESHOLD`` if not given."""
    nodes = ids.groupBy("fp").agg(F.min("id").alias("least_id"))
    roots = stage(components(links(nodes.select("fp")) if found is None else found), "simhash-roots")
    linked = nodes.join(roots, "fp")
    named = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = roots.join(named, "root").select("fp", "root", "component_id")
    groups = nodes.join(linked, "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id")
    )
    return skew_join(ids, groups, ["fp"], "inner", ["id"])


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, root, component_id) of every row; texts are read once."""
    ids = df.select(F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"))
    return group(stage(ids, "simhash-fingerprints"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group: that of the smallest id (of rows with one id, the first text)."""
    rows = df.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), fingerprint(F.col(text_col)).alias("fp"))
    marked = stage(rows, "simhash-documents")
    return first_rows(marked, group(marked.select("id", "fp")), text_col)


def first_rows(marked: DataFrame, groups: DataFrame, text_col: str) -> DataFrame:
    """Of rows (row, id, fp), one ``row`` of each group."""
    first = groups.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias("first_id"), F.col("fp").alias("first_fp"), "root").distinct()
    found = marked.join(first, (F.col("fp") == F.col("first_fp")) & F.col("id").eqNullSafe(F.col("first_id")))
    # few rows: those that carry their group's own id
    rank = F.row_number().over(Window.partitionBy("root").orderBy(F.col(f"row.{text_col}").asc_nulls_first(), "fp"))
    return found.withColumn("rank", rank).where("rank = 1").select("row.*")
