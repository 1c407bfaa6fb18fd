"""License findings against the planted notices, near misses and plain compression."""

import re

import duckdb
import pytest
import zstandard
from pyspark.sql import functions as F

from codegauge.llm import licenses, queries
from tests.llm.common import documents, save

NOTICES = {
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "All rights reserved.": "all-rights-reserved",
}


def plain(text):
    """Findings of texts that hold notices word for word."""
    found = sorted((m.start(), m.end(), name) for notice, name in NOTICES.items() for m in re.finditer(re.escape(notice), text or ""))
    return ",".join(f"{name}:{a}:{b}:0:0" for a, b, name in found)


@pytest.fixture(scope="module")
def scanner():
    return licenses.Scanner(licenses.TEMPLATES)


def test_query(spark):
    texts = dict(duckdb.sql("SELECT doc_id, text FROM '/root/testdata/sf0.1/documents.parquet'").fetchall())
    rows = queries.QUERIES["op10_license_scans"](spark, "/root/testdata/sf0.1").collect()
    assert len(rows) == len(texts)
    want = {d: plain(t) for d, t in texts.items()}
    assert sum(map(bool, want.values())) > 300
    assert {r.doc_id: r.findings for r in rows} == want


@pytest.mark.parametrize("block, name", [
    ("released under the  MIT\tlicense", "MIT"),
    ("This file is licensed under the Apache License, Version 2.0.", "Apache-2.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "BSD-3-Clause"),
    ("either version 3 of the License, or any later version.", "GPL-3.0"),
    ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
    ("This work is licensed under the GNU General Public License, version 4.", None),
    ("Released under the WTF License.", None),
    ("Licensed under CC BY-ND 4.0.", None),
    ("She renewed her driving license before the trip.", None),
    ("Some rights reserved.", None),
])
def test_wording_decides(scanner, block, name):
    found = scanner.classify(licenses.normal(block))
    assert (found and found[0]) == name


def test_ranking_is_conditional_compression(scanner):
    for notice, name in NOTICES.items():
        assert scanner.rank(licenses.normal(notice))[0][1] == name
    block = licenses.normal("Released under the MIT License.").encode()
    raw = zstandard.ZstdCompressionDict(block, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    assert len(zstandard.ZstdCompressor(dict_data=raw).compress(block)) < len(zstandard.ZstdCompressor().compress(block))


def test_edge_rows(spark, tmp_path):
    notice = "Released under the MIT License."
    texts = [None, "", "İ " + notice + " " + notice, notice + "\nAll rights reserved.", "word. " * 100_000 + notice, "licen", notice]
    df = documents(spark, texts).withColumn("found", F.lit(1)).withColumn("license", F.lit("x"))
    rows = queries.QUERIES["op10_license_scans"](spark, save(df.union(df.limit(4)), tmp_path / "a")).collect()
    assert len(rows) == len(texts) + 4
    got = {r.doc_id: r.findings for r in rows}
    assert got == {0: "", 1: "", 2: "MIT:0:65:0:1", 3: "MIT:0:31:0:0,all-rights-reserved:32:52:0:0", 4: "MIT:600000:600031:0:0", 5: "", 6: "MIT:0:31:0:0"}
    assert queries.QUERIES["op10_license_scans"](spark, save(df.limit(0), tmp_path / "b")).count() == 0
