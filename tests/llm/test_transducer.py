"""Transducer encoding against the tokenizers library, and its automaton against a dict."""

import hashlib
import random

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from codegauge.llm import queries, tokens, transducer
from tests.llm.common import documents, save
from tests.llm.test_packing import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merger():
    return transducer.Merger(PATH)


def check_rows(rows, texts):
    library = tokens.load(PATH)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for d, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[d] = (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want


def test_query(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    rows = queries.QUERIES["op3_bpe_transducer"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts)
    check_rows(rows, texts)


def test_odd_texts(spark, tmp_path):
    texts = [*ODD, "word " * 30_000, *["a b a b"] * 5]
    df = documents(spark, texts).withColumn("ids", F.lit(1)).withColumn("decoded", F.lit("x"))
    rows = queries.QUERIES["op3_bpe_transducer"](spark, save(df.union(df.limit(2)), tmp_path / "a")).collect()
    assert len(rows) == len(texts) + 2
    check_rows(rows, dict(enumerate(texts)))
    assert queries.QUERIES["op3_bpe_transducer"](spark, save(df.limit(0), tmp_path / "b")).count() == 0


def test_merging_is_exact(merger):
    library = tokens.load(PATH)
    rng = random.Random(2)
    texts = [*filter(None, ODD), *("".join(rng.choices("abcdeé ß.,'\n\t1239日😀", k=60)) for _ in range(300))]
    for text in texts:
        assert merger.ids(text) == library.encode(text, add_special_tokens=False).ids


def test_automaton_is_minimal_and_right(tmp_path):
    rng = random.Random(3)
    words = {bytes(rng.choices(b"abc", k=rng.randint(1, 6))) for _ in range(300)} | {b"station", b"nation", b"ration", "é".encode()}
    entries = {w: [rng.randrange(50_000) for _ in range(rng.randint(1, 3))] for w in words}
    transducer.save(transducer.compile_words(entries), str(tmp_path / "x"))
    arrays = transducer.load(str(tmp_path / "x"))
    asked = sorted(words) + [b"", b"zz", b"stat", b"stations", b"abcabcabc" * 3]
    rows = transducer.look_up(arrays, asked)
    got = {w: arrays["ids"][arrays["begin"][r] : arrays["begin"][r + 1]].tolist() for w, r in zip(asked, rows) if r >= 0}
    assert got == entries
    suffixes = {frozenset(w[k:] for w in words if w[:k] == p) for w in words for k in range(len(w) + 1) for p in [w[:k]]}
    assert len(arrays["final"]) == len(suffixes)  # one state per set of endings
    empty = transducer.compile_words({})
    assert transducer.look_up(empty, [b"a", b""]).tolist() == [-1, -1]


def test_counts_and_decoding(spark, merger):
    df = documents(spark, ["a b a b b", None, "", "b b"])
    assert {r.word: r.n for r in transducer.word_counts(df).collect()} == {"b": 4, "a": 1}
    assert transducer.frequent_words(df) == ["b"]
    rows = spark.createDataFrame([(1, [50256, 64]), (2, None), (3, []), (4, [merger.base[0xFF]])], "k int, ids array<int>")
    got = {r.k: r.t for r in rows.select("k", transducer.decode(F.col("ids"), PATH).alias("t")).collect()}
    assert got == {1: "<|endoftext|>a", 2: None, 3: "", 4: "�"}


def test_one_worker_a_task_and_no_sent_files(spark, tmp_path):
    """One Python step reads the table, and the lexicon does not come through the file server."""
    files = spark.sparkContext.listFiles
    rows = queries.QUERIES["op3_bpe_transducer"](spark, save(documents(spark, ODD), tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1
    assert spark.sparkContext.listFiles == files


def test_one_step_is_encoding_and_decoding(spark):
    df = documents(spark, [*ODD, *["a b a b b", "unseenword a"] * 600])
    lexicon = transducer.build_lexicon(df, PATH)
    ids = df.select("doc_id", transducer.encode(F.col("text"), lexicon).alias("ids"))
    want = {tuple(r) for r in ids.select("doc_id", F.col("ids").cast("string"), transducer.decode(F.col("ids"), PATH)).collect()}
    found = transducer.transduce(df, lexicon).select("id", F.col("ids").cast("string"), "decoded").collect()
    assert len(found) == df.count() and {tuple(r) for r in found} == want
