import random

import pytest
from pyspark.sql import functions as F

from codegauge.functions.extract import extract_code
from codegauge.functions.text import completion_text, strip

FENCE = "`" * 3


def scan(text, opening):
    """Blocks between an opening and the next fence, found by searching."""
    found, position = [], 0
    while (start := text.find(opening, position)) >= 0:
        body = start + len(opening)
        end = text.find(FENCE, body)
        if end < 0:
            break
        found.append(text[body:end].strip())
        position = end + len(FENCE)
    return found


def expected(text):
    tagged, closed = scan(text, FENCE + "python"), scan(text, FENCE)
    if tagged or closed:
        blocks = tagged or closed
    elif FENCE in text:
        rest = text[text.index(FENCE) + 3:]
        tag = len(rest) - len(rest.lstrip("".join({c for c in rest if c.isalnum() or c == "_"}) or "\0"))
        blocks = [rest[tag:].lstrip()]
    else:
        blocks = []
    defining = [b for b in blocks if "def " in b or "class " in b]
    last = (defining or blocks or [None])[-1]
    return last if last is None else last.strip(), bool(tagged), "\n\n".join(blocks)


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    c = F.col("c")
    rows = df.select("i", extract_code(c).alias("a"), extract_code(c, "all").alias("b")).collect()
    return [(r.a.code, r.a.correct_format, r.b.code) for r in sorted(rows, key=lambda r: r.i)]


GOLDEN = [
    (f"Here:\n{FENCE}python\ndef add(a, b):\n    return a + b\n{FENCE}", "def add(a, b):\n    return a + b", True),
    (f"First:\n{FENCE}python\nold()\n{FENCE}\nSecond:\n{FENCE}python\nnew()\n{FENCE}", "new()", True),
    (f"{FENCE}\nprint('hello')\n{FENCE}", "print('hello')", False),
    (f"Reasoning... {FENCE}python\ndef incomplete():", "def incomplete():", False),
    ("No code here.", None, False),
    (f"{FENCE}python\n{FENCE}", "", True),
    (f"{FENCE}python3\nx\n{FENCE}", "3\nx", True),
    (f"{FENCE}js\nx\n{FENCE}", "js\nx", False),
    (f"{FENCE}python\ndef f(): 1\n{FENCE} use {FENCE}python\nf()\n{FENCE}", "def f(): 1", True),
]


def test_golden_rows(spark):
    got = run(spark, [text for text, *_ in GOLDEN])
    assert [(code, ok) for code, ok, _ in got] == [(code, ok) for _, code, ok in GOLDEN]


def test_all_blocks_are_joined(spark):
    text = f"First:\n{FENCE}python\nold()\n{FENCE}\nSecond:\n{FENCE}python\nnew()\n{FENCE}"
    assert [all_code for *_, all_code in run(spark, [text, "none"])] == ["old()\n\nnew()", ""]


def test_random_texts_follow_the_rule(spark):
    rng = random.Random(5)
    pieces = [FENCE, FENCE + "python", "`", "``", " ", "\n", "\t", "\x1c", " ", "\xa0", "def ", "class ",
              "x = 1", "def", "python", "Python", "é", "3", "²", "_", "😀", "\r\n", "​"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(4000)]
    for text, (code, ok, all_code) in zip(texts, run(spark, texts)):
        assert (code, ok, all_code) == expected(text), text


def test_long_runs_of_blanks_stay_linear(spark):
    text = f"{FENCE}python\n" + " " * 300_000 + "x" + " \n" * 150_000 + FENCE
    assert run(spark, [text])[0][0] == "x"


def test_strip_is_pythons(spark):
    texts = [f"{chr(c)}a{chr(c)}" for c in [*range(1, 0x3001), 0xFEFF]if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, c string")
    for row in df.select("i", strip(F.col("c")).alias("s")).collect():
        assert row.s == texts[row.i].strip()


def test_completion_text(spark):
    df = spark.createDataFrame(
        [([("user", "a"), ("assistant", "b")],), ([],)], "m array<struct<role:string,content:string>>"
    )
    rows = df.select(completion_text(F.col("m"), is_message_list=True).alias("t")).collect()
    assert [r.t for r in rows] == ["b", ""]


def test_unknown_strategy_is_refused():
    with pytest.raises(ValueError):
        extract_code("c", "first")
