"""Fingerprints and likeness against sets of paragraphs in plain Python."""

import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from codegauge.llm import fingerprints, queries
from tests.llm.common import documents, save


def paragraphs(text):
    return set(re.findall(rf"[^\n]{{1,{fingerprints.PARAGRAPH_CHARS}}}", text))


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def plain(texts):
    """doc_id -> (n_chars, edited sha, near edited, near next) of different ids."""
    order = sorted(texts, reverse=True)
    out = {}
    for k, d in enumerate(order):
        text, after = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own = paragraphs(text)
        out[d] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), jaccard(own, paragraphs(edited)), jaccard(own, paragraphs(after)), text)
    return out


def check_rows(rows, texts):
    want = plain(texts)
    assert len(rows) == len(texts)
    by_text = {}
    for r in rows:
        n, sha, near, after, text = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert (r.near_edited, r.near_next) == pytest.approx((near, after))
        assert by_text.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (near == 1.0)


def test_query(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    check_rows(queries.QUERIES["op5_document_fingerprints"](spark, "/root/testdata/sf0.01").collect(), texts)


def test_odd_texts(spark, tmp_path):
    texts = [None, "", "\n\n", "a", "same line\n" * 3000, "same line\n" * 3000, "😀é" * 200, "".join(f"line {k} of a long text\n" for k in range(20_000)), "x" * 151]
    df = documents(spark, texts, first_id=-3).withColumn("row", F.lit(1)).withColumn("id", F.lit("x"))
    check_rows(queries.QUERIES["op5_document_fingerprints"](spark, save(df, tmp_path / "a")).collect(), dict(enumerate(texts, -3)))
    one = queries.QUERIES["op5_document_fingerprints"](spark, save(df.where("doc_id = 0"), tmp_path / "b")).collect()
    check_rows(one, {0: "a"})
    assert queries.QUERIES["op5_document_fingerprints"](spark, save(df.limit(0), tmp_path / "c")).count() == 0


def test_repeated_and_null_ids(spark, tmp_path):
    df = documents(spark, ["b", "a", "c"]).union(documents(spark, ["b"])).withColumn("doc_id", F.when(F.col("text") != "c", F.col("doc_id")))
    rows = fingerprints.with_next(df, "doc_id", "text").collect()
    assert sorted((r.id is None, r.id, r.text, r.next_text) for r in rows) == [(False, 0, "b", "b"), (False, 0, "b", "a"), (False, 1, "a", "b"), (True, None, "c", "a")] or \
        sorted(((r.id is None, r.id or 0, r.text, r.next_text) for r in rows)) == [(False, 0, "b", "b"), (False, 0, "b", "c"), (False, 1, "a", "b"), (True, 0, "c", "a")]


def test_small_sketches_are_tried_again_or_compared(spark, monkeypatch, tmp_path):
    rows = [(1, 0, list(range(100)), list(range(50, 170))), (2, 0, [1, 2], [2, 1]), (3, 0, [], [7]), (3, 1, [5, 6], [])]
    df = spark.createDataFrame(rows, "row long, pair int, a array<bigint>, b array<bigint>")
    want = {(1, 0): 120, (3, 0): 1, (3, 1): 2}
    for cells, tries in ((0.3, 5), (0.01, 1)):
        monkeypatch.setattr(fingerprints, "CELLS_PER_DIGEST", cells)
        monkeypatch.setattr(fingerprints, "MAX_TRIES", tries)
        got = {(r.row, r.pair): r.differing for r in fingerprints.differences(df).collect() if r.differing}
        assert got == want
