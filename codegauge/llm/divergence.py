"""How far the sources of a language lie apart, term by term and pair by pair.

Counting is single-pass in-memory indexing: a task counts terms in a block of postings;
when the block is full it is passed on as a run sorted by term, and an empty one begins.
Runs are dealt to shards by the hash of (language, term, source), where Spark's external
sort heap-merges them, and neighbours are summed as they stream by.  Postings carry the
occurrences and the documents of a term in a group.

With V kept terms of a language (in ``MIN_DOCUMENTS`` of its documents or more) and N
their occurrences in a group, a count c has the weight
p(c) = 1 + floor(10^9 (c + 2) / (N + 2 V)); two weights differ by
f(p, q) = floor((p - q)^2 / (p + q)).  The sum of f over all V terms of a pair of groups
is not made of V terms each.  Groups are sparse: were no term in both groups, terms
counted c times in one of them would all give f(p(c), q(0)), so the counts' histograms
are enough; each term that is in both corrects that sum, and these corrections are
streamed, summed in the task, per pair of sources.  All numbers are integers and exact
for counts up to 10^14.

Defined results: a null text, language or source counts as the empty string; a group
without kept terms is compared like any other; languages without kept terms have value 0
for each pair and no terms; repeated rows are documents each; an empty table gives an
empty table; only the three columns are read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codegauge.operators.joins import skew_join
from codegauge.storage import stage

MIN_DOCUMENTS = 10
SCALE = 1_000_000_000
TOP_TERMS = 10
#: Postings of a block; bytes of a text that are cut into words at once; pairs corrected at once.
BLOCK = 500_000
PIECE = 1 << 22
PAIRS = 1 << 19

# letters a-z and all bytes of other alphabets stay, A-Z become small, the rest are blanks
_LETTERS = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str) -> Iterator[list[bytes]]:
    """Terms of a text in UTF-8, some at a time."""
    data = text.encode("utf-8", "surrogatepass").translate(_LETTERS)
    first = 0
    while len(data) - first > PIECE:
        last = data.rfind(b" ", first, first + PIECE)
        if last < first:  # one term longer than a piece
            last = data.find(b" ", first)
            if last < 0:
                break
        yield data[first:last].split()
        first = last + 1
    yield data[first:].split()


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, text) -> term-sorted runs (lang, term, source, n, docs)."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        holds: dict[tuple[str, str], Counter[bytes]] = defaultdict(Counter)
        size = 0

        def run() -> pa.RecordBatch:
            groups = list(counts)
            lengths = [len(counts[g]) for g in groups]
            column = lambda k: pa.array([g[k] for g in groups], pa.string()).take(pa.array(np.repeat(np.arange(len(groups)), lengths)))
            terms = pa.array([t for g in groups for t in counts[g]], pa.binary()).cast(pa.string())
            n = np.fromiter((n for g in groups for n in counts[g].values()), np.int64, sum(lengths))
            held = np.fromiter((k for g in groups for k in map(holds[g].__getitem__, counts[g])), np.int64, sum(lengths))
            counts.clear()
            holds.clear()
            rows = pa.table([column(0), terms, column(1), pa.array(n), pa.array(held)], ["lang", "term", "source", "n", "docs"])
            order = pc.sort_indices(rows, [("lang", "ascending"), ("term", "ascending")])
            return rows.take(order).combine_chunks().to_batches(max_chunksize=max(1, len(order)))[0] if len(order) else pa.RecordBatch.from_pylist([], rows.schema)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                seen: set[bytes] = set()
                own = counts[lang, source]
                size -= len(own)
                for words in words_of(text):
                    own.update(words)
                    seen.update(words)
                holds[lang, source].update(seen)
                size += len(own)
                if size > BLOCK:
                    yield run()
                    size = 0
        yield run()

    return docs.select("lang", "source", "text").mapInArrow(blocks, "lang string, term string, source string, n long, docs long")


def frequencies(runs: DataFrame) -> DataFrame:
    """Runs -> one row per (lang, term, source): equal neighbours of the merged order are summed."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the row that may go on in the next batch
        for batch in batches:
            rows = pa.Table.from_batches([*([last] if last is not None else []), batch]).combine_chunks()
            if not rows.num_rows:
                continue
            keys = [rows[c].combine_chunks().dictionary_encode().indices.to_numpy() for c in ("lang", "term", "source")]
            change = np.r_[True, np.any([k[1:] != k[:-1] for k in keys], axis=0)]
            begins = np.flatnonzero(change)
            found = rows.select(["lang", "term", "source"]).take(pa.array(begins))
            for name in ("n", "docs"):
                found = found.append_column(name, pa.array(np.add.reduceat(rows[name].to_numpy(), begins)))
            whole = found.combine_chunks().to_batches()[0]
            yield whole.slice(0, whole.num_rows - 1)
            last = whole.slice(whole.num_rows - 1)
        if last is not None:
            yield last

    keys = ["lang", "term", "source"]
    return runs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(summed, "lang string, term string, source string, n long, docs long")


def weight(count: Column, total: Column, kept: Column) -> Column:
    """p of a count; 10^9 is multiplied in two steps that stay within 64 bits."""
    below = F.greatest(total + 2 * kept, F.lit(1))
    high = (count + 2) * (SCALE // 32_000)
    return F.call_function("div", high, below) * 32_000 + F.call_function("div", (high % below) * 32_000, below) + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, source, p, zero) sorted by (lang, term) -> (lang, a, b, more) with a < b:
    what each term of both sources changes, summed over the terms seen together."""

    def summed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        names = [rows[c].combine_chunks().dictionary_encode() for c in ("lang", "source")]
        lang, source = (n.indices.to_numpy() for n in names)
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        p, zero = rows["p"].to_numpy(), rows["zero"].to_numpy()
        edge = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]), True])
        last = np.repeat(edge[1:], np.diff(edge))
        partners = last - np.arange(len(term)) - 1  # rows of the term behind each row
        stops = np.r_[0, np.cumsum(partners)]
        first = 0
        while first < len(term):
            stop = max(first + 1, int(np.searchsorted(stops, stops[first] + PAIRS, "right")) - 1)
            own = partners[first:stop]
            a = np.repeat(np.arange(first, stop), own)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(own) - own, own)
            first = stop
            if not len(a):
                continue
            f = lambda x, y: (x - y) * (x - y) // (x + y)
            more = f(p[a], p[b]) - f(p[a], zero[b]) - f(zero[a], p[b]) + f(zero[a], zero[b])
            wide = len(names[1].dictionary)
            pair = (lang[a].astype(np.int64) * wide + source[a]) * wide + source[b]
            pairs, at = np.unique(pair, return_inverse=True)
            sums = np.zeros(len(pairs), np.int64)
            np.add.at(sums, at, more)
            columns = [names[0].dictionary.take(pa.array(pairs // (wide * wide))), names[1].dictionary.take(pa.array(pairs // wide % wide)), names[1].dictionary.take(pa.array(pairs % wide)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "a", "b", "more"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # the last term may go on in the next batch
        rows = pa.Table.from_batches([*held, batch]).combine_chunks()
        terms, langs = rows["term"], rows["lang"]
        same = pc.and_(pc.equal(terms, terms[-1]), pc.equal(langs, langs[-1])).to_numpy()
        last = int(np.argmax(same))
        if last:
            yield from summed(rows.slice(0, last))
        held = rows.slice(last).combine_chunks().to_batches()
    if held:
        yield from summed(pa.Table.from_batches(held))


def audit(df: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) for the pairs of sources and the terms of each group."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = df.select(empty(lang_col).alias("lang"), empty(source_col).alias("source"), empty(text_col).alias("text"))
    found = stage(frequencies(postings(docs)), "divergence-frequencies")
    kept = found.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    kept = stage(kept.select("lang", "term"), "divergence-terms")
    counts = stage(found.join(kept, ["lang", "term"], "left_semi").select("lang", "term", "source", "n"), "divergence-counts")

    # one row per group, those without kept terms too: as many rows as the table has groups
    vocabulary = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "own", "v")])
    groups = stage(groups.withColumn("zero", weight(F.lit(0).cast("long"), F.col("total"), F.col("v"))), "divergence-groups")

    totals = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    weighed = counts.join(groups.select("lang", "source", "total", "v", "zero").join(totals, "lang"), ["lang", "source"])
    weighed = weighed.withColumn("p", weight(F.col("n"), F.col("total"), F.col("v")))
    result = pairs(weighed, groups).unionByName(terms(weighed, top_terms))
    return result.select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))


def pairs(weighed: DataFrame, groups: DataFrame) -> DataFrame:
    """Part ``pair``: every other source of the language, by the sum of differences."""
    streamed = weighed.select("lang", "term", "source", "p", "zero").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = streamed.mapInArrow(_corrections, "lang string, a string, b string, more long")
    both = both.groupBy("lang", "a", "b").agg(F.sum("more").alias("more"))
    # either way round
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("w"), "more").select("lang", "w.*", "more")

    # the histogram of a group's weights against the zero weight of every other group
    bars = weighed.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    others = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"))
    alone = skew_join(bars, others, ["lang"], "inner", ["source", "p"]).where("source <> item").groupBy("lang", "source", "item").agg(F.sum(F.col("terms") * difference(F.col("p"), F.col("other"))).alias("alone"))

    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other"), F.col("own").alias("other_own"))
    rows = skew_join(groups, other, ["lang"], "inner", ["source"]).where("source <> item")
    rows = rows.join(both, ["lang", "source", "item"], "left").join(alone, ["lang", "source", "item"], "left")
    back = alone.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("alone").alias("alone_back"))
    rows = rows.join(back, ["lang", "source", "item"], "left")
    none = (F.col("v") - F.col("own") - F.col("other_own")) * difference(F.col("zero"), F.col("other"))
    value = none + sum(F.coalesce(c, F.lit(0)) for c in ("alone", "alone_back", "more"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.select("lang", "source", F.lit("pair").alias("part"), "item", value.alias("value")).withColumn("rank", rank)


def terms(weighed: DataFrame, top: int = TOP_TERMS) -> DataFrame:
    """Part ``term``: the terms that a group favours most against its language."""
    whole = weighed.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"))
    rows = weighed.join(whole, ["lang", "term"])
    rows = rows.withColumn("q", weight(F.col("lang_n"), F.col("lang_total"), F.col("v"))).where("p > q")
    rows = rows.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), difference(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top)
