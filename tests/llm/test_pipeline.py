"""The pipeline against plain Python, stage by stage, on given and on odd documents."""

import re
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from codegauge import storage
from codegauge.llm import langid, quality, secrets, tokens
from tests.llm.common import documents, save
from tests.llm.test_packing import check_packing
from tests.llm.test_secrets import plain_base
from tests.llm.test_simhash import plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.01"


def plain_good(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if n < 50:
        return False
    seen = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(n - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    mean = sum(map(len, words)) / n
    return (
        len(covered) <= 0.5 * n and 2 <= mean <= 15 and sum(text.count(s) for s in quality.SYMBOLS) <= 0.1 * n
        and sum(w.lower() in quality.STOP_WORDS for w in words) >= 0.04 * n and len(lines) - len(set(lines)) <= 0.4 * len(lines)
    )


def stored(df, tmp_path, name):
    df.write.parquet(f"{tmp_path}/{name}")
    return df.sparkSession.read.parquet(f"{tmp_path}/{name}")


def test_stages_against_plain_python(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall())
    langs = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{SF}/documents.parquet'").fetchall())
    steps = {name: step for name, step in corpus_pipeline.STAGES}
    assert [n for n, _ in corpus_pipeline.STAGES] == list(steps)
    ids = lambda df: {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    docs = stored(steps["quality rules"](spark, docs, SF), tmp_path, "1")
    texts = {d: t for d, t in texts.items() if plain_good(t)}
    assert ids(docs) == texts and docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    profiler = langid.Profiler()
    profiles = {d: profiler.profiles([t])[0].astype(float) for d, t in texts.items()}
    sums = {lang: sum(p for d, p in profiles.items() if langs[d] == lang) for lang in sorted(set(langs.values()))}
    cosine = lambda a, b: a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9)
    texts = {d: t for d, t in texts.items() if max(cosine(profiles[d], s) for s in sums.values()) >= langid.MIN_SCORE}
    docs = stored(steps["language id"](spark, docs, SF), tmp_path, "2")
    assert ids(docs) == texts

    groups = plain_groups({d: plain_fingerprint(t) for d, t in texts.items()})
    docs = stored(steps["simhash near-dedup"](spark, docs, SF), tmp_path, "3")
    texts = {d: t for d, t in texts.items() if groups[d] == d}
    assert ids(docs) == texts and len(texts) < len(groups)

    model = secrets.fit(secrets.labelled_samples(docs))
    found = {r.doc_id: r.s for r in secrets.find(docs, model).select("doc_id", F.col("__k_spans").alias("s")).collect()}
    clean = {}
    for d, text in texts.items():
        spans = [(s.start, s.kind, s.end) for s in found[d]]
        assert [s for s in spans if s[1] < 3] == plain_base(text)
        hidden = {i for s, _, e in spans for i in range(s, e)}
        clean[d] = re.sub("\0+", secrets.PLACEHOLDER, "".join("\0" if i in hidden else c for i, c in enumerate(text)))
    docs = stored(steps["secret scans"](spark, docs, SF), tmp_path, "4")
    assert ids(docs) == clean and clean != texts
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    rows = steps["best-fit packing"](spark, docs, SF).collect()
    n, bound = check_packing(rows, clean)
    assert n <= bound * 1.01 + 1
    whole = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, whole.collect())) == sorted(map(key, rows))


def test_odd_documents(spark, tmp_path):
    good = "The cat of the house and a dog is in it for " + " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)) + "."
    odd = [None, "", " ", good, good, "x" * 50_000, "### $$$ " * 100]
    df = documents(spark, odd).withColumn("__q_words", F.lit(1)).withColumn("id", F.lit("a"))
    rows = corpus_pipeline.run(spark, save(df.union(df), tmp_path)).collect()
    assert {r.doc_id for r in rows} == {3}
    library = tokens.load(public_tokenizers.path("word_bpe_49k.json"))
    assert [r.length for r in rows] == [len(library.encode(good, add_special_tokens=False).ids) + 1]
    assert corpus_pipeline.run(spark, save(df.limit(0), tmp_path)).count() == 0


def test_nothing_is_left_but_the_result(spark):
    before = set(storage.staged_paths())
    result = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert set(storage.staged_paths()) == before
    left = storage.list_paths(spark, f"{storage.shared_folder(spark)}/pipeline-*")
    assert sum("best-fit-packing" in path for path in left) >= 1 and result.count() > 0
    assert storage.list_paths(spark, f"{storage.shared_folder(spark)}/pipeline-simhash-near-dedup-*") == []


def test_a_long_clean_text_stays(spark):
    words = ["the", "of", "and", *(f"word{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(26) for b in range(26) for c in range(26))]
    text = " ".join(words[k % 3] if k % 8 == 0 else words[3 + (k * k * 7 + k // 13) % (len(words) - 3)] for k in range(102_000))
    docs = documents(spark, [text])
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).count() == 1
