"""Language profiles: held-out accuracy, plain-Python profiles and edge rows."""

import duckdb
import numpy as np
from pyspark.sql import functions as F

from codegauge.llm import langid, queries
from tests.llm.common import documents, save

SF = "/root/testdata/sf0.01"


def plain_profile(text, dimensions=langid.DIMENSIONS):
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    clean = f" {' '.join(letters.split())} "
    vector = lambda c: np.random.default_rng((langid.SEED, ord(c))).integers(0, 2, dimensions, np.int8).astype(int) * 2 - 1
    out = np.zeros(dimensions)
    for a, b, c in zip(clean, clean[1:], clean[2:]):
        out += np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
    return out


def test_profiles_are_bound_and_bundled_vectors():
    texts = ["The cat sat, 12 times.", "", "42 !?", "² ³", "ÉTÉ à l'été", "日本語 text"]
    got = langid.Profiler().profiles(texts)
    for k, text in enumerate(texts):
        want = plain_profile(text) if any(c.isalpha() for c in text) else np.zeros(langid.DIMENSIONS)
        assert np.array_equal(got[k], want)


def test_held_out_accuracy(spark):
    rows = queries.QUERIES["op1_language_id"](spark, SF).collect()
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    assert len(rows) == len(lang)
    held = [r for r in rows if r.held_out]
    assert 250 < len(held) < 420
    assert all(0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def test_held_out_rows_teach_nothing(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(150)
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    other = docs.withColumn("lang", F.when(held, F.lit("xx")).otherwise(F.col("lang")))
    one = {tuple(r) for r in queries.op1_language_id(spark, save(docs, tmp_path / "a")).collect()}
    two = {tuple(r) for r in queries.op1_language_id(spark, save(other, tmp_path / "b")).collect()}
    assert one == two


def test_edge_rows(spark, tmp_path):
    texts = ["the of and to in", "le la de et les", "the of and", None, "", "12 34", "the " * 200_000]
    df = documents(spark, texts).withColumn("lang", F.when(F.col("doc_id") == 1, "fr").when(F.col("doc_id") != 2, "en"))
    df = df.withColumn("found", F.lit(0)).withColumn("score", F.lit("x"))
    prototypes = langid.fit(df)
    assert prototypes.languages == ("en", "fr")
    got = {r.doc_id: (r.f.lang, r.f.score) for r in df.select("doc_id", langid.predict(F.col("text"), prototypes).alias("f")).collect()}
    assert [got[k][0] for k in range(7)] == ["en", "fr", "en", "und", "und", "und", "en"]
    assert got[3][1] == 0.0
    kept = langid.keep_known(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6]
    assert queries.op1_language_id(spark, save(df.limit(0), tmp_path)).count() == 0
    nothing = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.l for r in nothing.select(langid.predict(F.col("text"), langid.fit(nothing))["lang"].alias("l")).collect()} == {"und"}
