"""Repair of the turn structure of conversations over a suffix-shared automaton.

A row's signature is one letter: the initial of its role (``s``, ``u``, ``a``, or ``o``
for any other), in upper case if its text breaks off, or ``x`` if it must go (blank, or
role and text stood earlier).  A conversation is the word of its signatures, and what is
left must read ``(s?(ua)+)?`` in initials of roles.

Words are taken from their ends: conversations that end alike share the automaton's nodes
(a node is a suffix; its arc a letter and the node after it).  Each node knows, for each of
the grammar's four states, the least cost to the end and the edit that begins the best
audit.  Different words are solved once, whatever the number of conversations, in the
order of their reversed letters: a word keeps the nodes it shares with the one before it
and replaces the rest, so every node is computed once and a task holds one word's nodes.

Edits: Keep 0; Rerole to user or assistant 3; Delete 4; Insert an empty user or assistant
row 3; a row that breaks off and is not deleted adds 3.  From one node and state the
possible edits have different initials, so the ASCII-least audit among the cheapest takes
the least initial at each step.

Order: by turn (nulls first), then role, then text.  Defined results: a null role or text
counts as one blank; an empty role, like any unknown one, can be deleted or reroled only;
a null conversation id is a conversation; equal rows repeated are duplicates; an empty
table gives an empty table.  A conversation's letters and audit are one value; its texts
are never put together, its digest is taken row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codegauge.operators.joins import skew_join
from codegauge.storage import stage

BLANKS = " \t\n\v\f\r"
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Grammar: what may follow in each state, and where it leads.  0 begin, 1 after s, 2 after u, 3 after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The role that may be put in at each state.
WANTED = ("u", "u", "a", "u")
ACCEPTS = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
_MANY = 1 << 60


def damage(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows spoilt by a hash of their place, to be repaired: one in 20 each is dropped,
    emptied, robbed of its sentence ends, repeated, or given to the user."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text(id_col), F.lit(":"), text(turn_col))) % 20
    rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"), code.alias("code"))
    rows = rows.where("code <> 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("code") == 3, 2).otherwise(1))))
    spoilt = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), spoilt.alias("text"))


def with_faults(df: DataFrame, id_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Rows (conv, place, turn, role, text, fault, letter, illegal, new_turn) in order."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = df.select(F.col(id_col).alias("conv"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.select(
        "*", F.row_number().over(order).alias("place"),
        F.concat(F.lag(initial).over(order), initial).alias("pair"), F.lag("turn").over(order).alias("turn_before"),
    )
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv", "role", "text").orderBy("place")) > 1)
    told = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(told == "", "blank").when(F.col("again"), "duplicate").when(~F.right(told, F.lit(1)).isin(".", "!", "?"), "truncated")
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(known)).otherwise(known)
    rows = rows.withColumn("fault", fault)
    return rows.select(
        "conv", "place", "turn", "role", "text", "fault", letter.alias("letter"),
        F.coalesce(~F.col("pair").isin("su", "ua", "au"), F.lit(False)).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


class Automaton:
    """Nodes of the suffixes of one word; the next word reuses those it shares."""

    def __init__(self):
        self.letters: list[str] = []  # from the end
        # of each node and state: (cost, edit, state after it, whether the row is used up)
        self.nodes: list[list[tuple[int, str, int, bool]]] = [self._closed([(0, "", q, True) if q in ACCEPTS else (_MANY, "", q, True) for q in range(4)])]
        self.built = 1

    @staticmethod
    def _closed(best: list[tuple[int, str, int, bool]]) -> list[tuple[int, str, int, bool]]:
        """With insertions, which stay at their node; two in a row reach every state."""
        for _ in range(3):
            for q, letter in enumerate(WANTED):
                to = NEXT[q][letter]
                best[q] = min(best[q], (best[to][0] + INSERT, "I", to, False), key=lambda x: x[:2])
        return best

    def _node(self, letter: str) -> list[tuple[int, str, int, bool]]:
        after, kind = self.nodes[-1], letter.lower()
        best = []
        for q in range(4):
            choices = [(after[q][0] + DELETE, "D", q, True)]
            if letter != "x":
                more = TRUNCATED if letter.isupper() else 0
                if kind in NEXT[q]:
                    to = NEXT[q][kind]
                    choices.append((after[to][0] + more, "K", to, True))
                to = NEXT[q][WANTED[q]]
                choices.append((after[to][0] + more + REROLE, "R", to, True))
            best.append(min(choices, key=lambda x: x[:2]))
        self.built += 1
        return self._closed(best)

    def take(self, reversed_word: str) -> None:
        """Keep the nodes shared with the word before, add the others."""
        shared = 0
        for a, b in zip(self.letters, reversed_word):
            if a != b:
                break
            shared += 1
        del self.letters[shared:], self.nodes[shared + 1 :]
        for letter in reversed_word[shared:]:
            self.nodes.append(self._node(letter))
            self.letters.append(letter)

    def answer(self) -> tuple[int, str, list[str]]:
        """(cost, audit, script) of the word.  The script has an entry for each row and one
        for the end: letters of inserted roles, then K, D, or the new role's upper letter."""
        state, at, audit, script, entry = 0, len(self.nodes) - 1, [], [], ""
        while True:
            _, edit, to, used = self.nodes[at][state]
            if not edit:
                return self.nodes[-1][0][0], "".join(audit), [*script, entry]
            audit.append(edit)
            if edit == "I":
                entry += WANTED[state]
            else:
                script.append(entry + (WANTED[state].upper() if edit == "R" else edit))
                entry = ""
            state, at = to, at - used


def solve(words: DataFrame) -> DataFrame:
    """(word, cost, audit, script) of the different words of a column ``word``."""

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        for batch in batches:
            out = []
            for reversed_word in batch.column(0).to_pylist():
                automaton.take(reversed_word)
                out.append((reversed_word[::-1], *automaton.answer()))
            columns = zip(*out) if out else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["word", "cost", "audit", "script"])

    different = words.select(F.reverse("word").alias("r")).distinct()
    return different.repartitionByRange("r").sortWithinPartitions("r").mapInArrow(answers, "word string, cost long, audit string, script array<string>")


def report(rows: DataFrame) -> DataFrame:
    """Counts, cost, audit and script of every conversation of stored rows with faults."""
    count = lambda c: F.sum(c.cast("long"))
    word = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "letter"))), lambda x: x["letter"]), "")
    span = F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn"))
    told = rows.groupBy("conv").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(F.col("fault") == k).alias(k) for k in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"), word.alias("word"),
    )
    told = stage(told, "repair-words")
    return skew_join(told, solve(told), ["word"], "inner", ["conv"])


def repaired_rows(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv, place, part, role, text) of the repaired conversations; ``place`` and
    ``part`` order them."""
    entries = told.select("conv", F.posexplode("script").alias("at", "entry")).where("entry NOT IN ('', 'D')")
    entries = entries.select(F.col("conv").alias("c"), (F.col("at") + 1).alias("p"), "entry")
    both = entries.join(rows.select("conv", "place", "role", "text"), F.col("c").eqNullSafe(F.col("conv")) & (F.col("p") == F.col("place")), "left")
    parts = both.select(F.col("c").alias("conv"), F.col("p").alias("place"), "role", "text", F.posexplode(F.split("entry", "")).alias("part", "edit"))
    new = F.lower("edit")
    role = F.when(new == "u", ROLES["u"]).when(new == "a", ROLES["a"]).otherwise(F.col("role"))
    return parts.where("edit <> 'D'").select("conv", "place", "part", role.alias("role"), F.when(F.col("edit").isin("u", "a"), "").otherwise(F.col("text")).alias("text"))


def digests(parts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of ordered rows; a task holds one batch of them."""
    conv_type = parts.schema["conv"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        kind = None

        def out(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"])

        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                line = line.encode("utf-8", "surrogatepass")
                if state is not None and own == conv:
                    state.update(b"\n" + line)
                    continue
                if state is not None:
                    done.append((conv, state.hexdigest()))
                conv, state = own, hashlib.sha256(line)
            yield out(done)
        if state is not None:
            yield out([(conv, state.hexdigest())])

    lines = parts.repartition("conv").sortWithinPartitions("conv", "place", "part")
    return lines.select("conv", F.concat("role", F.lit(":"), "text").alias("line")).mapInArrow(hashed, f"conv {conv_type}, repaired_sha256 string")


def repair(df: DataFrame, id_col: str = "conv", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The report (conv, counts, cost, audit, script) and the repaired rows."""
    rows = stage(with_faults(df, id_col, turn_col, role_col, text_col), "repair-rows")
    told = stage(report(rows), "repair-report")
    return told, repaired_rows(rows, told)
