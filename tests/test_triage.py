import pytest
from pyspark.sql import functions as F

from codegauge.fixed_values import LONG_LINE_REASON
from codegauge.functions import scripts as S
from codegauge.operators import triage as T

NESTED = "x = " + "(" * 500 + ")" * 500
# script, parses, modules, reason
CORPUS = [
    ("import json\nimport datetime\nprint(1)", True, ["datetime", "json"], None),
    ("import numpy\nprint(1)", True, ["numpy"], "Unsupported module(s): numpy"),
    ("import os.path, sys", True, ["os", "sys"], None),
    ("import zlib, yaml, json", True, ["json", "yaml", "zlib"], "Unsupported module(s): yaml, zlib"),
    ("from . import x", True, [], None),
    ("from .pkg import x", True, ["pkg"], "Unsupported module(s): pkg"),
    ("from a.b import c", True, ["a"], "Unsupported module(s): a"),
    ("class A: pass", True, [], "Unsupported feature: Class declaration"),
    ("match 1:\n    case 1: pass", True, [], "Unsupported feature: Match declaration"),
    ("x = 1\ndel x", True, [], "Unsupported feature: Delete declaration"),
    ("def f():\n    import numpy\nclass A: pass", True, ["numpy"], "Unsupported feature: Class declaration"),
    ("import json\nclass A:\n    import numpy", True, ["json", "numpy"], "Unsupported feature: Class declaration"),
    ("def f(:", False, [], None),
    ('s = "' + "a" * 70_000 + '"', True, [], LONG_LINE_REASON),
    ("async def f(): pass", True, [], None),
    ("x = 1\0", False, [], None),
    (NESTED, False, [], None),
    ("", True, [], None),
    ("x = '\\d'", True, [], None),
]


@pytest.fixture(scope="module")
def triaged(spark):
    df = spark.createDataFrame([(i, row[0]) for i, row in enumerate(CORPUS)], "i int, code string")
    return sorted(T.triage(df, "code").collect(), key=lambda r: r.i)


def test_verdicts(triaged):
    for row, (code, parses, modules, reason) in zip(triaged, CORPUS):
        assert (row.parse_ok, row.modules, row.reason) == (parses, modules, reason), code[:60]
        assert row.is_compatible == (reason is None)


def test_features(triaged):
    flags = {CORPUS[r.i][0]: (r.has_class, r.has_match, r.has_del) for r in triaged}
    assert flags["class A: pass"] == (True, False, False)
    assert flags["x = 1\ndel x"] == (False, False, True)


def test_a_worker_takes_few_bytes_at_once(spark, monkeypatch):
    @F.arrow_udf(T.ANALYSIS)
    def size_of_batch(code):
        import pyarrow as pa

        found = {"parse_ok": True, "nodes": [{"kind": "import", "modules": [str(code.nbytes)]}]}
        return pa.array([found] * len(code))

    monkeypatch.setattr(T, "analyse_code", size_of_batch)
    df = spark.range(0, 2000, 1, 1).select(F.repeat(F.lit("x"), 5000).alias("code"))
    sizes = [int(r.modules[0]) for r in T.triage(df, "code").collect()]
    assert len(sizes) == 2000 and max(sizes) < 1.1 * (1 << 20)


def test_other_allowed_modules(spark):
    df = spark.createDataFrame([("import numpy",)], "code string")
    assert T.triage(df, "code", allowed=["numpy"]).first().is_compatible


def test_dependencies(spark):
    """Repeated modules mean the first package; rows with a null mean nothing."""
    pairs = [("cv2", "opencv-python"), ("cv2", "opencv-x"), ("PIL", "Pillow"), (None, "none"), ("numpy", None)]
    module_map = spark.createDataFrame(pairs, "module string, package string")
    rows = [(1, ["PIL", "cv2", "json", "numpy", "os"]), (2, ["json"]), (3, [])]
    df = spark.createDataFrame(rows, "id int, modules array<string>")
    got = {r.id: r.dependencies for r in T.resolve_dependencies(df, "id", module_map).collect()}
    assert got == {1: ["Pillow", "numpy", "opencv-python"], 2: [], 3: []}


def test_dependency_header(spark):
    df = spark.createDataFrame([("x", ["a", "b"]), ("y", [])], "s string, d array<string>")
    rows = [r[0] for r in df.select(S.dependency_header(F.col("s"), F.col("d"))).collect()]
    assert rows == ['# /// script\n# dependencies = [\n#   "a",\n#   "b",\n# ]\n# ///\n\nx', "y"]


@pytest.mark.parametrize("script,want", [
    ("async def f(): pass", True), ("\n  \t async def f(): pass", True), ("x = await f()", True),
    ("# await f()", False), ("x = 'await'", False), ("x = 1\ny = 2", False), ("'''\nawait'''", True),
    ("a\nb = \"s\"\nc\nawait x", True),
])
def test_async_scan(spark, script, want):
    import re

    df = spark.createDataFrame([(script,)], "s string")
    assert df.select(S.requires_async(F.col("s"))).first()[0] is want
    assert bool(re.search(r"^\s*async def|^[^#\"']*await", script, re.M)) is want
