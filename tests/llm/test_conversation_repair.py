"""Repairs against a plain shortest-path search over whole conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from codegauge.llm import conversation_repair as cr
from codegauge.llm import queries
from tests.llm.common import save

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string"
FULL = re.compile(r"(s?(ua)+)?\Z")


def spoil(rows):
    out = []
    for conv, turn, role, text in rows:
        blank = lambda v: " " if v is None else v
        role, text = blank(role), blank(text)
        code = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        told = text.strip(" \t\n\v\f\r")
        out.append("blank" if not told else "duplicate" if (role, text) in seen else "truncated" if told[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def step(state, letter):
    """Grammar by prefixes: what has been kept is a prefix of ``s?(ua)*``."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, letter))


def cheapest(rows, found):
    """(cost, audit, lines): least cost, then least audit, over all edits."""
    n, queue, done = len(rows), [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, at, state, lines = heapq.heappop(queue)
        if at == n and state in ("", "a"):
            return cost, audit, list(lines)
        if (at, state) in done:
            continue
        done.add((at, state))
        for name in ("user", "assistant"):
            if step(state, name[0]):
                heapq.heappush(queue, (cost + 3, audit + "I", at, step(state, name[0]), (*lines, f"{name}:")))
        if at == n:
            continue
        heapq.heappush(queue, (cost + 4, audit + "D", at + 1, state, lines))
        if found[at] in ("blank", "duplicate"):
            continue
        (role, text), more = rows[at], 3 if found[at] == "truncated" else 0
        if step(state, role[:1]):
            heapq.heappush(queue, (cost + more, audit + "K", at + 1, step(state, role[:1]), (*lines, f"{role}:{text}")))
        for name in ("user", "assistant"):
            if step(state, name[0]):
                heapq.heappush(queue, (cost + more + 3, audit + "R", at + 1, step(state, name[0]), (*lines, f"{name}:{text}")))


def plain(given):
    convs = defaultdict(list)
    for row in spoil(given):
        convs[row[0]].append(row[1:])
    out = {}
    for conv in {row[0] for row in given}:
        rows = sorted(convs[conv], key=lambda r: ((r[0] is not None, r[0] or 0), r[1], r[2]))
        pairs = [(role, text) for _, role, text in rows]
        turns = [t for t, _, _ in rows if t is not None]
        found = faults(pairs)
        cost, audit, lines = cheapest(pairs, found) if rows else (0, "", [])
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def answers(spark, folder):
    return {tuple(r)[0]: tuple(r)[1:] for r in queries.QUERIES["op12_conversation_repair"](spark, folder).collect()}


def test_query(spark):
    given = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    want = plain(given)
    assert answers(spark, SF) == want
    assert sum(w[5] > 0 for w in want.values()) > 50


def test_odd_conversations(spark, tmp_path):
    rng = random.Random(4)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "umpire"], [None, "", " ", "Yes.", "No", "Why? \n", "é!", "　"]
    rows = [(conv, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for conv in range(60) for _ in range(rng.randrange(1, 9))]
    rows += [(None, k, "user", f"Said {k}.") for k in range(5)] + [(99, None, None, None)] + [(98, 1, "user", "One.")] * 3
    rows += [(97, t, "user", "x.") for t in range(40) if zlib.crc32(f"97:{t}".encode()) % 20 == 0]  # all dropped
    # a row of empty role has no initial: it is kept nowhere, though the pattern would not mind
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit(1)).withColumn("conv", F.lit("c"))
    want = plain(rows)
    assert answers(spark, save(df, tmp_path / "a", "conversations")) == want
    assert want[97][5:7] == (0, "") and None in want
    assert answers(spark, save(df.limit(0), tmp_path / "b", "conversations")) == {}


def test_long_conversation(spark, tmp_path):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Text {t}.") for t in range(3000)] + [(2, t, "user", f"Text {t}") for t in range(1500)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = answers(spark, save(df, tmp_path, "conversations"))
    want = plain(rows)
    assert {c: g[:6] + g[7:] for c, g in got.items()} == {c: w[:6] + w[7:] for c, w in want.items()} and got == want


@pytest.mark.parametrize("seed", range(5))
def test_automaton_equals_search_on_random_words(seed):
    rng = random.Random(seed)
    words = sorted({"".join(rng.choice("suaoSUAOx") for _ in range(rng.randrange(1, 8))) for _ in range(300)})
    automaton = cr.Automaton()
    for word in sorted(w[::-1] for w in words):
        automaton.take(word)
        cost, audit, script = automaton.answer()
        letters = word[::-1]
        found = ["blank" if x == "x" else "truncated" if x.isupper() else None for x in letters]
        rows = [({"s": "system", "u": "user", "a": "assistant"}.get(x.lower(), "other"), f"{k}") for k, x in enumerate(letters)]
        want = cheapest(rows, found)
        assert (cost, audit) == want[:2]
        lines = []
        for entry, row in zip(script, [*rows, None]):
            for x in entry:
                lines += {"K": lambda: [f"{row[0]}:{row[1]}"], "D": list, "u": lambda: ["user:"], "a": lambda: ["assistant:"], "U": lambda: [f"user:{row[1]}"], "A": lambda: [f"assistant:{row[1]}"]}[x]()
        assert lines == want[2] and FULL.match("".join(line[0] for line in lines))


def test_shared_endings_are_computed_once():
    words = sorted(w[::-1] for w in ("uaua", "xuaua", "suaua", "uaUa", "uaxa"))
    automaton = cr.Automaton()
    for word in words:
        automaton.take(word)
    endings = {w[:k] for w in words for k in range(len(w) + 1)}
    assert automaton.built == len(endings)
