"""Divergence of sources: the query by SQL, small cases by plain Python."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from codegauge.llm import divergence, queries
from tests.llm.common import DOCUMENT, save

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=10):
    """(lang, source, text) rows -> the result's rows."""
    counts, holds, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(SMALL))
        langs[lang].add(source)
        counts[lang, source].update(words)
        holds[lang].update(set(words))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, sources in langs.items():
        kept = [t for t, n in holds[lang].items() if n >= least]

        def weights(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        q = weights(sum((counts[lang, s] for s in sources), Counter()))
        p = {s: weights(counts[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def answers(spark, folder):
    return sorted(tuple(r) for r in queries.QUERIES["op13_source_divergence"](spark, folder).collect())


@pytest.mark.parametrize("block, pairs", [(divergence.BLOCK, divergence.PAIRS), (500, 100)])
def test_query(spark, monkeypatch, block, pairs):
    monkeypatch.setattr(divergence, "BLOCK", block)
    monkeypatch.setattr(divergence, "PAIRS", pairs)
    folder = "/root/testdata/sf0.01"
    rows = duckdb.sql(f"SELECT lang, source, text FROM '{folder}/documents.parquet'").fetchall()
    assert answers(spark, folder) == plain(rows)


def test_odd_rows(spark, tmp_path):
    texts = ["Éa ÉA éa Straße x-y_z [K]", "The the THE", None, "", "123 !?", "日本 日本語 ´ü", "a" * 5000 + " the"]
    rows = [(k, t, lang, source, 0) for k, (lang, source) in enumerate([("en", "a"), ("en", "b"), ("en", None), (None, "a"), (None, None), ("x", "only")] * 9) for t in texts]
    rows += [(1, "rare words here", "en", "lonely", 0), (2, None, "fr", "z", 0), (3, "mot", "fr", "y", 0)]
    df = spark.createDataFrame(rows, DOCUMENT).withColumn("term", F.lit(1)).withColumn("n", F.lit("x"))
    got = answers(spark, save(df, tmp_path / "a"))
    assert got == plain([(r[2], r[3], r[1]) for r in rows])
    assert ("fr", "y", "pair", "z", 0, 1) in got and any(r[:3] == ("en", "lonely", "pair") and r[4] for r in got)
    assert answers(spark, save(df.limit(0), tmp_path / "b")) == []


def test_ties_and_long_texts(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(divergence, "PIECE", 64)
    words = " ".join(f"{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(200))
    rows = [(k, words + " " + "z" * 300 + f" {'é' * (k % 5)}", "en", f"s{k % 7}", 0) for k in range(40)]
    df = spark.createDataFrame(rows, DOCUMENT)
    assert answers(spark, save(df, tmp_path)) == plain([(r[2], r[3], r[1]) for r in rows])


def test_weights_of_large_counts(spark):
    rows = [(c, t, v) for c in (0, 7, 10**12, 9 * 10**13) for t in (c, 2 * 10**14) for v in (1, 12345)]
    df = spark.createDataFrame(rows, "c long, t long, v long")
    got = df.select("c", "t", "v", divergence.weight(F.col("c"), F.col("t"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + 10**9 * (r.c + 2) // (r.t + 2 * r.v) for r in got)


def test_runs_are_sorted_and_merge(spark):
    docs = spark.createDataFrame([("en", "a", "b a a"), ("en", "b", "a c")], "lang string, source string, text string").coalesce(1)
    runs = divergence.postings(docs).collect()
    assert [(r.lang, r.term) for r in runs] == sorted((r.lang, r.term) for r in runs)
    merged = divergence.frequencies(divergence.postings(docs.union(docs))).collect()
    assert {(r.term, r.source): (r.n, r.docs) for r in merged} == {("a", "a"): (4, 2), ("b", "a"): (2, 2), ("a", "b"): (2, 2), ("c", "b"): (2, 2)}
