"""ORC token files against the tokenizers library."""

import glob
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
from pyarrow import orc
from pyspark.sql import functions as F

from codegauge.llm import queries, token_files, tokens
from tests.llm.common import documents, save
from tests.llm.test_packing import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


def expected(texts):
    library, at, out = tokens.load(PATH), 0, {}
    for d, text in sorted(texts.items()):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out[d] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    return out


def places(rows):
    return {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows}


def test_query(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = queries.QUERIES["op8_token_id_orc"](spark, "/root/testdata/sf0.01").collect()
    assert places(rows) == expected(texts) and len(rows) == len(texts)


def test_odd_texts(spark, tmp_path):
    df = documents(spark, [*ODD, "word " * 50_000], first_id=-5).withColumn("id", F.lit("x")).withColumn("part", F.lit(None).cast("int"))
    rows = queries.QUERIES["op8_token_id_orc"](spark, save(df, tmp_path)).collect()
    assert places(rows) == expected(dict(df.select("doc_id", "text").collect()))


def test_repeated_null_and_no_rows(spark, tmp_path):
    df = documents(spark, ["a b", "c"]).union(documents(spark, ["a b", None])).withColumn("doc_id", F.when(F.col("text") == "c", None).otherwise(F.col("doc_id")))
    rows = sorted(queries.QUERIES["op8_token_id_orc"](spark, save(df, tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, 0, 0, 1]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(4)]
    assert queries.QUERIES["op8_token_id_orc"](spark, save(df.limit(0), tmp_path / "b")).count() == 0


def test_files_have_stripes_indexes_and_prune(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    path = str(tmp_path / "ids")
    token_files.write(docs, path, PATH)
    files = glob.glob(path + "/*.orc")
    assert all(orc.ORCFile(f).row_index_stride == token_files.INDEX_ROWS for f in files)
    assert sum(orc.ORCFile(f).nrows for f in files) == 1000
    stored = token_files.read(spark, path)
    assert stored.where("id = 77").count() == 1 and stored.where("id = 5000").count() == 0
    plan = stored.where("id = 77").select("ids")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,77)" in plan


def test_plain_pieces_skip_the_library_s_cutting(monkeypatch):
    rng = random.Random(5)
    words = ["été", "Übermaß", "x", "word", "123", "7", "!?", "...", "#a", "a1b2", "naïveté's", "÷", "²", "日本", "\u00a0", "e\u0301"]
    texts = ["".join(rng.choice(["", " ", " ", " ", "  ", "\n", "\n\n", "\t"]) + rng.choice(words) for _ in range(40)) for _ in range(300)]
    library, encoder = tokens.load(PATH), tokens.ChunkEncoder(PATH, "kept")
    offsets, ids = encoder.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr(encoder, "_library", None)  # from here on only the model is asked
    text = "plain words, Überall 42 été ... a1 (done)"
    assert encoder.encode([text])[1].tolist() == library.encode(text, add_special_tokens=False).ids
