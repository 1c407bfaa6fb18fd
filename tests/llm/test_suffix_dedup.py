"""Removal of repeated 50-byte strings against brute force, and the suffix order alone."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codegauge.llm import queries, suffix_dedup
from tests.llm.common import documents, save

SF = "/root/testdata/sf0.01"
BIG = 1 << 62


def brute(rows):
    """(id, text) rows -> {(id, text): (n_bytes, n_removed, n_spans, kept)}."""
    rows = sorted(((BIG if d is None else d), (t or "").encode()) for d, t in rows)
    first, out = {}, {}
    for d, x in rows:
        for p in range(len(x) - 49):
            first.setdefault(x[p : p + 50], d)
    for d, x in rows:
        gone = np.zeros(len(x) + 1, bool)
        for p in range(len(x) - 49):
            if first[x[p : p + 50]] < d:
                gone[p : p + 50] = True
        kept = bytes(np.frombuffer(x, np.uint8)[~gone[:-1]])
        out[None if d == BIG else d, x] = (len(x), len(x) - len(kept), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept)
    return out


def removed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffix_dedup.remove_repeats(df, with_kept=True).collect()
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in found)
    return sorted(((BIG if r.id is None else r.id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found)


def wanted(rows):
    found = brute(rows)
    return sorted(((BIG if d is None else d), *found[d, (t or "").encode()]) for d, t in rows)


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 2])
def test_query(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    want = {d: (n, m, k, hashlib.sha256(x).hexdigest()) for (d, _), (n, m, k, x) in brute(texts).items()}
    rows = queries.QUERIES["op11_suffix_array_dedup"](spark, SF).collect()
    assert len(rows) == len(texts)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == want
    assert sum(m > 0 for _, m, _, _ in want.values()) > 50


def test_small_cases(spark):
    a, b, c = (letter * 3 + "".join(chr(97 + (k * k * step) % 26) for k in range(70)) for letter, step in zip("xyz", (1, 5, 7)))
    rows = [
        (1, a), (2, b + a + c), (3, a[:49]), (4, "é" * 40), (5, "è" * 24 + "é" * 30), (6, a[10:60] + b[:50] + b[1:51]),
        (7, ""), (8, None), (9, a), (9, a), (9, c), (None, c), (None, "w" * 60), (10, "q" * 200), (11, "q" * 51), (12, " " + a[20:] + c),
    ]
    assert removed(spark, rows) == wanted(rows)
    # windows of one id only, and the same rows in another order
    assert removed(spark, rows[::-1]) == wanted(rows)


def test_strings_repeated_in_one_document_stay(spark):
    text = "0123456789" * 30
    assert removed(spark, [(5, text)]) == [(5, 300, 0, 0, text.encode())]
    assert [r[2] for r in removed(spark, [(5, text), (6, text[3:])])] == [0, 297]


def test_long_text_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    monkeypatch.setattr(suffix_dedup, "SLICE", 3000)
    monkeypatch.setattr(suffix_dedup, "CHUNK", 5000)
    monkeypatch.setattr(suffix_dedup, "SORTED", 2000)
    rng = np.random.default_rng(3)
    long = "".join(map(chr, rng.integers(97, 123, 20_000)))
    rows = [(1, long), *((k, long[k * 700 : k * 700 + 300] + long[k * 311 : k * 311 + 99]) for k in range(2, 25)), (30, long[5000:] + "!"), (31, "z" * 8000), (32, "z" * 7999)]
    assert removed(spark, rows) == wanted(rows)


def test_texts_that_repeat_a_few_words(spark):
    rows = [(k, "ab " * (30 + k) + ("cd" if k % 3 else "") + "xy z " * (20 + k % 5) + f"{k}") for k in range(40)] + [(50, "q" * 500), (51, "q" * 60 + "r"), (52, "ab " * 400)]
    assert removed(spark, rows) == wanted(rows)


def test_a_third_of_all_rows_share_a_text_and_a_line(spark):
    line = "this line stands in every document of the table, again and again\n"
    rows = [(k, "copy " * 30) for k in range(100)] + [(k, f"{k * k} {line} {k * 7}") for k in range(100, 300)]
    assert removed(spark, rows) == wanted(rows)


def test_odd_tables(spark, tmp_path):
    df = documents(spark, [None, "", "a" * 70, "a" * 60]).withColumn("h", F.lit(1)).withColumn("sha", F.lit("x")).withColumn("id", F.lit("y"))
    rows = queries.QUERIES["op11_suffix_array_dedup"](spark, save(df.union(df), tmp_path / "a")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in rows) == [(0, 0), (0, 0), (1, 0), (1, 0), (2, 0), (2, 0), (3, 60), (3, 60)]
    assert queries.QUERIES["op11_suffix_array_dedup"](spark, save(df.limit(0), tmp_path / "b")).count() == 0
    strings = spark.createDataFrame([("b", "k" * 50), ("a", "k" * 50), (None, "k" * 50)], "doc_id string, text string")
    assert {r.id: r.n_removed for r in suffix_dedup.remove_repeats(strings).collect()} == {"a": 0, "b": 50, None: 50}


class Weak(suffix_dedup.Hasher):
    """Hashes of three values only, so that most comparisons go wrong."""

    def stretch(self, prefix, start, length):
        return super().stretch(prefix, start, length) % np.uint64(3)


@pytest.mark.parametrize("hasher", [suffix_dedup.Hasher, Weak])
def test_suffix_order_is_the_order_of_bytes(hasher):
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1200] = data[2000:2200]
    data[3000:3300] = 97
    start = rng.permutation(len(data) - suffix_dedup.WINDOW)
    group = rng.integers(0, 3, len(start))
    found = suffix_dedup.SuffixOrder(data, start, group, hasher(10))
    key = lambda k: (group[k], data[start[k] : start[k] + 50].tobytes())
    keys = [key(k) for k in found.order]
    assert keys == sorted(map(key, range(len(start))))
    assert found.same.tolist() == [False, *(x == y for x, y in zip(keys, keys[1:]))]


def test_common_extension():
    data = np.frombuffer(b"abcdefgh" * 10 + b"abcdefgX" * 10, np.uint8)
    order = suffix_dedup.SuffixOrder(data, np.array([0, 8, 30, 31, 80]), np.zeros(5, int), suffix_dedup.Hasher(10))
    assert order.common(np.array([0, 2, 0]), np.array([4, 3, 3])).tolist() == [7, 0, 0]


def test_equal_windows_share_their_anchor():
    text = "".join(chr(97 + (k * k * 3) % 23) for k in range(500))
    texts = [("pad" * 7 + text).encode(), text[100:].encode(), b"short"]
    offsets = np.cumsum([0, *map(len, texts)])
    anchor, owner, start, windows, _ = suffix_dedup.anchor_runs(np.frombuffer(b"".join(texts), np.uint8), offsets, suffix_dedup.Hasher(10))
    at = {(o, s + j - offsets[o]): a for a, o, s, n in zip(anchor, owner, start, windows) for j in range(n)}
    assert len(at) == sum(max(0, len(t) - 49) for t in texts)
    assert all(at[0, 121 + j] == at[1, j] for j in range(len(texts[1]) - 49))
    assert isinstance(suffix_dedup._cut(np.arange(5, dtype=np.uint8), np.array([1]), np.array([2])), pa.BinaryArray)
