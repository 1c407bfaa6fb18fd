"""SimHash groups against all-pairs comparison of small tables."""

import random

import duckdb
import xxhash
from pyspark.sql import functions as F

from codegauge.llm import queries, simhash
from tests.llm.common import documents, save


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(fps):
    """id -> smallest id reachable, by comparing all pairs."""
    ids = list(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_query_against_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())
    fps = {d: plain_fingerprint(t) for d, t in texts.items()}
    groups = plain_groups(fps)
    rows = queries.QUERIES["op9_simhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fps[d]:016x}", groups[d]) for d in texts}
    assert len(rows) == len(texts)


def test_edge_rows(spark, tmp_path):
    texts = [None, "", " \n\t", "One", "one", "ONE two", "a b c " * 30_000, "a b c " * 30_000, "É b c"]
    df = documents(spark, texts)
    rows = queries.QUERIES["op9_simhash_near_dedup"](spark, save(df.union(df.limit(1)), tmp_path)).collect()
    assert len(rows) == len(texts) + 1
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in rows}
    fps = {k: plain_fingerprint(t) for k, t in enumerate(texts)}
    groups = plain_groups(fps)
    assert got == {k: (f"{fps[k]:016x}", groups[k]) for k in fps}
    assert got[0] == ("0" * 16, 0)


def test_empty_table(spark, tmp_path):
    assert queries.QUERIES["op9_simhash_near_dedup"](spark, save(documents(spark, []), tmp_path)).count() == 0


def ball(rng, n, flips):
    """Fingerprints around one centre, chains and loners."""
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < n:
        fp = rng.choice(sorted(out)) if rng.random() < 0.5 else centre
        for _ in range(rng.randint(1, flips)):
            fp ^= 1 << rng.randrange(64)
        out.add(fp)
    return out


def test_crowded_anchors_agree_with_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    fps = ball(rng, 250, 2) | ball(rng, 100, 3) | ball(rng, 60, 7) | {rng.getrandbits(64) for _ in range(100)} | {0, 2**64 - 1}
    fps = dict(enumerate(sorted(fps)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    ids = spark.createDataFrame([(k, signed(v)) for k, v in fps.items()], "id long, fp long")
    want = plain_groups(fps)
    for most in (4, 256):
        monkeypatch.setattr(simhash, "MAX_AT_ANCHOR", most)
        assert {r.id: r.component_id for r in simhash.group(ids).collect()} == want


def test_each_pair_within_two_bits_meets(spark):
    rng = random.Random(1)
    base = rng.getrandbits(63)
    fps = spark.createDataFrame([(base ^ (1 << a) ^ (1 << b) if a != b else base,) for a in range(63) for b in range(a, 63)], "fp long").distinct()
    at = simhash.anchors(fps)
    mine = at.where(F.col("fp") == base).select("anchor")
    assert at.join(mine, "anchor").select("fp").distinct().count() == fps.count()
    assert at.groupBy("fp").count().agg(F.max("count")).first()[0] <= 34


def test_keep_one(spark):
    df = documents(spark, ["a b c d", "A B c d", "x y z", None, ""]).withColumn("fp", F.lit(1)).withColumn("id", F.lit("k"))
    df = df.union(df.where("doc_id = 0")).union(df.where("doc_id = 2").withColumn("doc_id", F.lit(None).cast("long")))
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert simhash.keep_one(df.limit(0)).count() == 0
