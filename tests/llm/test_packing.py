"""Packing against the tokenizers library, its own invariants and the lower bound."""

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from codegauge.llm import packing, queries, tokens
from tests.llm.common import documents, save

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    None, "", " ", "  a  b ", "Σας ΣΑΣ İstanbul é ́x Å", "a\x1cb\x85c　d e", "<|endoftext|> x <|startoftext|>y", "it's we'll 123 ４５ ²",
    "tab\tnew\nline\r\nend \n", "foo  <|endoftext|>  bar", "x" * 5000, "😀👩‍👩‍👧 ‍", "a \n b\n c \t d", "\n x", " lead", "trail ", "don't\n\n  stop",
]


@pytest.mark.parametrize("name, blanks", [("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "kept")])
def test_chunks_give_the_ids_of_whole_texts(name, blanks):
    path = public_tokenizers.path(name)
    rows = [r[0] for r in duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' ORDER BY doc_id").fetchall()]
    library = tokens.load(path)
    encoder = tokens.ChunkEncoder(path, blanks)
    for texts in (ODD, rows, ODD + rows[:5], []):
        offsets, ids = encoder.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def check_packing(rows, texts, most=2048):
    library = tokens.load(PATH)
    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()}
    want = {}
    for d, x in ids.items():
        for piece, start in enumerate(range(0, len(x), most)):
            part = np.array(x[start : start + most], "<u4")
            want[d, piece] = (start, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= most
    bound = -(-sum(map(len, ids.values())) // most)
    return len(sequences), bound


def test_query(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall())
    n, bound = check_packing(queries.QUERIES["op6_best_fit_packing"](spark, "/root/testdata/sf0.01").collect(), texts)
    assert n <= bound * 1.005 + 1


def test_edge_texts_and_empty(spark, tmp_path):
    texts = [*ODD, "word " * 10_000]
    df = documents(spark, texts).withColumn("id", F.lit(1)).withColumn("sequence_id", F.lit("x"))
    rows = queries.QUERIES["op6_best_fit_packing"](spark, save(df, tmp_path)).collect()
    check_packing(rows, dict(enumerate(texts)))
    twice = packing.pack_documents(df.union(df), PATH).count()
    assert twice == 2 * len(rows)
    assert packing.pack_documents(df.limit(0), PATH).count() == 0


@pytest.mark.parametrize("select", ["norm", "dot"])
def test_every_capacity_holds(select):
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 400, 3000)
    capacity = packing.Capacity(1000, 8, 160_000, select=select)
    sequence, offset = packing.pack_lengths(lengths, capacity)
    for s in np.unique(sequence):
        own = lengths[sequence == s]
        assert own.sum() <= 1000 and len(own) <= 8 and (own**2).sum() <= 160_000
        order = np.argsort(offset[sequence == s])
        assert (offset[sequence == s][order] == np.cumsum(own[order]) - own[order]).all()
    with pytest.raises(ValueError):
        packing.pack_lengths(np.array([1001]), capacity)


def test_groups_lose_little(spark):
    rng = np.random.default_rng(4)
    lengths = np.minimum(2048, rng.lognormal(5.5, 1.2, 40_000)).astype(int).clip(1)
    pieces = spark.createDataFrame([(int(x),) for x in lengths], "length long")
    n = packing.pack(pieces).select("sequence_id").distinct().count()
    assert n <= 1.002 * lengths.sum() / 2048 + 1
