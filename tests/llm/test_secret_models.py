"""The added spans against a plain model, identifiers left alone, long texts in little time."""

import base64
import hashlib
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from codegauge.llm import secrets
from tests.llm.common import documents
from tests.llm.test_secrets import as_text, plain_base

SF = "/root/testdata/sf0.01"
NAMES = """src/main/java/com/example/util/StringUtils the_quick_brown_fox_jumps GetUserAccountDetailsFromDatabase
home/user/projects/website/index number_of_active_connections parseConfigurationFromEnvironment
usr/share/doc/packages/readme_first connection_timeout_in_seconds AbstractDocumentBuilderFactory
tests/integration/test_database_access maximum_retry_attempts calculateMonthlyInterestPayment""".split()


@pytest.fixture(scope="module")
def model(spark):
    return secrets.fit(secrets.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))


def plain_spans(text, model):
    """Base spans, and candidate runs that none of them touches and the model takes for random."""
    place = {c: k + 1 for k, c in enumerate(secrets.ALPHABET)}
    base = plain_base(text)
    out = list(base)
    for m in re.finditer(secrets.CANDIDATE, text or ""):
        if any(a < m.end() and m.start() < b for a, _, b in base):
            continue
        pairs = [model.ratios[place[a] * model.size + place[b]] for a, b in zip(m[0], m[0][1:])]
        if sum(pairs) / len(pairs) >= model.threshold:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def found(spark, texts, model):
    rows = secrets.find(documents(spark, texts), model).select("doc_id", secrets.as_text("__k_spans").alias("s")).collect()
    return [s for _, s in sorted((r.doc_id, r.s) for r in rows)]


def test_spans_of_the_plain_model(spark, model):
    texts = [t for (t,) in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()]
    keys = [base64.b64encode(hashlib.sha256(str(k).encode()).digest()).decode()[: 18 + k % 20] for k in range(40)]
    texts += [f"{key}, {name} {key}x token={key} {key[:15]}" for key, name in zip(keys, NAMES * 4)]
    assert found(spark, texts, model) == [as_text(plain_spans(t, model)) for t in texts]


def test_identifiers_are_left_alone_and_keys_are_not(spark, model):
    """Precision and recall on held-out names and keys."""
    assert found(spark, NAMES, model) == [""] * len(NAMES)
    keys = [base64.b64encode(hashlib.sha512(f"key {k}".encode()).digest()).decode()[:20].replace("=", "A") for k in range(300)]
    hits = sum(bool(s) for s in found(spark, keys, model))
    assert hits >= 0.97 * len(keys)


def test_many_candidates_in_one_text(spark, model):
    texts = [" ".join(f"word_of_some_{k:06d}_length" for k in range(20_000)), "deadbeefdeadbeef " * 20_000]
    df = documents(spark, texts).cache()
    df.count()
    begin = time.perf_counter()
    rows = secrets.find(df, model).select("doc_id", F.size("__k_spans").alias("n"), F.size("__k_base").alias("b")).collect()
    assert {r.doc_id: r.b for r in rows} == {0: 0, 1: 20_000}
    assert time.perf_counter() - begin < 30
    begin = time.perf_counter()
    clean = secrets.redact(df, model).where("doc_id = 1").collect()[0].text
    assert clean == "[SECRET] " * 20_000 and time.perf_counter() - begin < 30


def test_characters_beyond_the_basic_plane_stay(spark, model):
    texts = ["😀é token='0123456789abcdef' 😀", "token='0123456789abcdef'", "a 0123456789abcdef0123456789abcdef"]
    clean = sorted((r.doc_id, r.text) for r in secrets.redact(documents(spark, texts), model).collect())
    assert [t for _, t in clean] == ["😀é [SECRET]' 😀", "[SECRET]'", "a [SECRET]"]
