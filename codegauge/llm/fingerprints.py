"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, cut every ``PARAGRAPH_CHARS`` characters; their
digests are a set.  A sketch has cells in three rows; a digest goes to one cell of each
row, which counts it and takes it and its check hash in by XOR.  Subtracting two
sketches leaves the digests that differ.  Peeling recovers them: a cell that holds one
digest gives it away, it is taken out of its other cells, and so on.  If cells are left
over, the pair is sketched again twice as large; what is left after ``MAX_TRIES`` is
compared digest by digest.  Likeness = shared / all digests, from the exact number of
differing ones.

The fingerprint is the small sketch of ``FINGERPRINT_CELLS`` cells in hex: equal sets of
paragraphs have equal fingerprints.  Sketches that are compared are large enough for all
digests of both texts, so a retry is rare.

All steps are built-in expressions.  Peeling is grouped by row id, by which the digests
are dealt once: its rounds exchange nothing.

Defined results: a null text counts as empty; texts without paragraphs have a zero
fingerprint and likeness 1 to each other; rows are ordered by (id descending, nulls last,
text), each row is a document of its own, and the one after the last is the first; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.storage import stage

PARAGRAPH_CHARS = 150
FINGERPRINT_CELLS = 9
ROWS = 3
#: Cells per digest of both texts at the first try, peeling rounds of a try, and tries.
CELLS_PER_DIGEST = 1.6
ROUNDS = 6
MAX_TRIES = 5
#: Ranges of ids within which the next document is looked for.
MAX_RANGES = 4096


def digests(text: Column) -> Column:
    """Set of paragraph digests (array<bigint>) of a text."""
    paragraphs = F.regexp_extract_all(text, F.lit(rf"[^\n]{{1,{PARAGRAPH_CHARS}}}"), F.lit(0))
    return F.array_distinct(F.transform(paragraphs, lambda p: F.xxhash64(p)))


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _cell(key: Column, row: int, width: Column) -> Column:
    """Cell of a digest in one of the rows; rows follow each other."""
    return F.pmod(F.xxhash64(key, F.lit(row)), width) + row * width


def fingerprint(keys: str) -> Column:
    """Small sketch of a digest array, as hex: count, XOR of digests, XOR of checks per cell."""
    width = FINGERPRINT_CELLS // ROWS
    xor = lambda values: F.aggregate(values, F.lit(0).cast("long"), lambda acc, x: acc.bitwiseXOR(x))
    wide = lambda c, n: F.lpad(F.hex(c), n, "0")
    in_cell = lambda c: lambda k: _cell(k, c // width, F.lit(width)) == c
    cells = []
    for cell in range(FINGERPRINT_CELLS):
        own = F.filter(keys, in_cell(cell))
        cells += [wide(F.size(own).cast("long"), 8), wide(xor(own), 16), wide(xor(F.transform(own, _check)), 16)]
    return F.lower(F.concat(*cells))


def _empty_cell() -> Column:
    return (F.col("tag") == 0) & (F.col("n") == 0) & (F.col("key") == 0) & (F.col("chk") == 0)


def _entry(tag: int, place: Column, n: Column, key: Column) -> Column:
    return F.struct(F.lit(tag).alias("tag"), place.alias("place"), n.cast("long").alias("n"), key.alias("key"), _check(key).alias("chk"))


_STATE = ["row", "pair", "width"]
_PLACE = [*_STATE, "tag", "place"]


def peel(pairs: DataFrame) -> DataFrame:
    """(row, pair, recovered, left) for rows (row, pair, width, a, b) of digest arrays.

    Tags: 0 a cell, 1 a recovered digest, 2 one found in this round.  Pairs whose
    digests all cancel have no row in the result.
    """
    width = F.col("width")
    signed = F.concat(F.transform("a", lambda k: F.struct(k.alias("key"), F.lit(1).alias("n"))), F.transform("b", lambda k: F.struct(k.alias("key"), F.lit(-1).alias("n"))))
    keys = pairs.repartition("row").select(*_STATE, F.explode(signed).alias("s"))
    cells = keys.select(*_STATE, F.explode(F.array(*[_entry(0, _cell(F.col("s.key"), r, width), F.col("s.n"), F.col("s.key")) for r in range(ROWS)])).alias("e")).select(*_STATE, "e.*")
    summed = [F.sum("n").alias("n"), F.bit_xor("key").alias("key"), F.bit_xor("chk").alias("chk")]
    state = cells.groupBy(*_PLACE).agg(*summed).where(~_empty_cell())
    itself = F.struct("tag", "place", "n", "key", "chk")
    for _ in range(ROUNDS):
        pure = (F.col("tag") == 0) & F.col("n").isin(1, -1) & (F.col("chk") == _check(F.col("key")))
        found = F.when(pure, F.array(itself, _entry(2, F.col("key"), F.col("n"), F.col("key")))).otherwise(F.array(itself))
        state = state.select(*_STATE, F.explode(found).alias("e")).select(*_STATE, "e.*")
        # a digest may be alone in up to three of its cells: it counts once
        state = state.groupBy(*_PLACE).agg(F.max("n").alias("n"), F.max("key").alias("key"), F.max("chk").alias("chk"))
        taken = F.array(_entry(1, F.col("key"), F.col("n"), F.col("key")), *[_entry(0, _cell(F.col("key"), r, width), -F.col("n"), F.col("key")) for r in range(ROWS)])
        state = state.select(*_STATE, F.explode(F.when(F.col("tag") == 2, taken).otherwise(F.array(itself))).alias("e")).select(*_STATE, "e.*")
        state = state.groupBy(*_PLACE).agg(*summed).where(~_empty_cell())
    return state.groupBy("row", "pair").agg(F.sum((F.col("tag") == 1).cast("long")).alias("recovered"), F.sum((F.col("tag") == 0).cast("long")).alias("left"))


def differences(pairs: DataFrame) -> DataFrame:
    """(row, pair, differing): exact number of digests in one of ``a`` and ``b`` only.

    ``pairs`` (row, pair, a, b) is a stored table with one row per (row, pair).  Pairs
    that do not differ are left out.
    """
    spark = pairs.sparkSession
    total = F.size("a") + F.size("b")
    todo, done = pairs, []
    for attempt in range(MAX_TRIES):
        width = F.ceil(total * (CELLS_PER_DIGEST * 2**attempt / ROWS)).cast("long") + 2
        found = stage(peel(todo.withColumn("width", width)), "fingerprint-differences")
        done.append(found.where("left = 0").select("row", "pair", F.col("recovered").alias("differing")))
        failed = found.where("left > 0").select("row", "pair")
        if failed.isEmpty():
            break
        todo = pairs.join(failed, ["row", "pair"], "left_semi")
    else:
        exact = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
        done.append(todo.select("row", "pair", exact.cast("long").alias("differing")))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def likeness(n_a: Column, n_b: Column, differing: Column) -> Column:
    all_twice = n_a + n_b + differing
    return F.when(all_twice == 0, F.lit(1.0)).otherwise((n_a + n_b - differing) / all_twice)


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, next_text): the next row by descending id, after the last the first.

    Ids are cut into ranges of about equal numbers of rows.  Each range also gets the
    first row of the range after it, so the next row is always in reach and texts move
    once.  The ranges' first ids are at most ``MAX_RANGES`` rows.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce("id", F.lit(-(1 << 63)))
    ranges = min(MAX_RANGES, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.select(order.alias("o")).agg(F.percentile_approx("o", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    bounds = F.lit(cuts).cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("o", order)
    rows = rows.withColumn("range", F.size(F.filter(bounds, lambda c: c < F.col("o"))))
    firsts = rows.groupBy("range").agg(F.max("o").alias("o"))
    after = Window.orderBy(F.col("range").desc())
    # the range above gets the first row; the lowest range gets the first row of all
    wrap = F.first("o").over(after.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = firsts.select(F.col("range").alias("to"), F.coalesce(F.lead("o").over(after), wrap).alias("o"))
    guests = rows.drop("range").join(F.broadcast(guests), "o").select("id", "text", "o", F.col("to").alias("range"), F.lit(True).alias("guest"))
    both = rows.select("id", "text", "o", "range", F.lit(False).alias("guest")).unionByName(guests)
    place = Window.partitionBy("range").orderBy("guest", F.col("o").desc(), "text")
    return both.withColumn("next_text", F.lead("text").over(place)).where("NOT guest").select("id", "text", "next_text")


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the text replaced by as much of the next one's start."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare_versions(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited version, and likeness to it and to the next text."""
    rows = with_next(df, id_col, text_col)
    rows = rows.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("new"), digests(F.col("next_text")).alias("next"),
    )
    rows = rows.withColumns({"fingerprint": fingerprint("own"), "edited_fingerprint": fingerprint("new")})
    base = stage(rows, "fingerprints").withColumn("row", F.monotonically_increasing_id())  # files and their rows stay as they are
    pairs = base.select("row", F.explode(F.array(F.struct(F.lit(0).alias("pair"), F.col("own").alias("a"), F.col("new").alias("b")), F.struct(F.lit(1).alias("pair"), F.col("own").alias("a"), F.col("next").alias("b")))).alias("p")).select("row", "p.*")
    found = differences(pairs)
    found = found.groupBy("row").agg(*[F.coalesce(F.sum(F.when(F.col("pair") == k, F.col("differing"))), F.lit(0)).alias(f"d{k}") for k in (0, 1)])
    sizes = base.select("row", "id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *[F.size(c).alias(f"n_{c}") for c in ("own", "new", "next")])
    near = lambda other, k: likeness(F.col("n_own"), F.col(f"n_{other}"), F.coalesce(f"d{k}", F.lit(0)))
    return sizes.join(found, "row", "left").select("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", near("new", 0).alias("near_edited"), near("next", 1).alias("near_next"))
