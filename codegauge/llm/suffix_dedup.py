"""Removal of passages that stand in an earlier document, by hash-compared suffix sorting.

Every 50-byte string (window) that also starts in a document with a smaller id goes.

1. *Texts.*  Equal texts are one node with their smallest id: a later copy goes whole.
   Texts are dealt to chunks of some megabytes by their hash.
2. *Anchors.*  A window's anchor is the least hash among its 20-byte strings, so equal
   windows have equal anchors and neighbours mostly share one: a run of windows.  Only
   runs whose anchor stands in two texts or more can hold a repeated window.  Chunks send
   their anchors as sorted lists, and get back those that others have too.
3. *Suffix sort.*  The bytes of such runs meet by anchor.  There the suffixes that start
   at their windows are sorted, by their first eight bytes and, where those agree, by a
   mergesort that compares two suffixes through their longest common extension: prefix
   polynomial hashes tell whether two stretches are equal, a binary search finds how far.
   Neighbours in the order are then compared byte by byte; an order that a collision
   of hashes has spoilt is made again from the bytes.
4. *Spans.*  Neighbours that agree on 50 bytes are one string; whoever is not its
   smallest id loses the bytes.  Spans go back to their chunks, where texts are cut.

Texts are shuffled once (one exchange serves three steps).  Equal runs of a chunk are sent
once, and an anchor in over ``HOT`` chunks is dealt by its windows and not by itself, so
no common line collects its contexts in one task; so is a window that holds its anchor
twice, as in texts that repeat a few words, and equal runs of a text are one row.

Defined results: a null text counts as empty; texts under 50 bytes keep all; a null id
counts as larger than any other; rows of one id never remove bytes of each other; repeated
rows get equal results; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codegauge.operators.joins import skew_join
from codegauge.storage import stage

#: Bytes of a string that is judged, and of the strings among which its anchor is chosen.
WINDOW = 50
GRAM = 20
#: Chunks with an anchor from which on it is dealt by its windows.
HOT = 1024
#: Bytes of a chunk and of a shard of anchors (one anchor per 16 bytes or so).
CHUNK = 1 << 22
SHARD = 1 << 25
#: Bytes hashed at once, bytes of texts taken together, bytes of runs sorted at once (an
#: anchor's runs are never split).
BLOCK = 1 << 19
SLICE = 1 << 22
SORTED = 1 << 20
ROWS_OUT = 1 << 16
#: Bits of an anchor: few enough to be told in short steps, a collision only costs work.
BITS = 44

_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


class Hasher:
    """Prefix polynomial hashes modulo 2^64 of byte arrays of up to ``size`` bytes."""

    def __init__(self, size: int):
        self.letter = np.random.default_rng(11).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
        self._grow(size)

    def _grow(self, size: int) -> None:
        base, inverse = np.full(size + 1, _U(_BASE)), np.full(size + 1, _U(pow(_BASE, -1, 1 << 64)))
        base[0] = inverse[0] = 1
        self.power, self.inverse = np.cumprod(base, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        """``p`` with p[k] the hash of the first k bytes."""
        if len(data) >= len(self.power):
            self._grow(2 * len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letter[data] * self.power[: len(data)], out=out[1:])
        return out

    def stretch(self, prefix: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """Hashes of stretches, comparable wherever they start."""
        return (prefix[start + length] - prefix[start]) * self.inverse[start]

    def windows(self, prefix: np.ndarray, length: int) -> np.ndarray:
        """Hashes of all stretches of one length."""
        n = len(prefix) - length
        return (prefix[length:] - prefix[:n]) * self.inverse[:n]


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> _U(29))) * _U(0xBF58476D1CE4E5B9)
    return values ^ (values >> _U(32))


def _sliding_least(values: np.ndarray, reach: int) -> np.ndarray:
    size = 1
    while 2 * size <= reach:
        values, size = np.minimum(values[:-size], values[size:]), 2 * size
    return np.minimum(values[: size - reach], values[reach - size :]) if size < reach else values


def anchor_runs(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(anchor, text, start, windows, again) of the runs of texts ``data[offsets[k]:offsets[k+1]]``.

    Anchors have ``BITS`` bits and are even; ``again`` says that the windows hold their
    anchor's string more than once, as in texts that repeat a few words.  Texts are hashed
    block by block, so long ones cost no memory; a run ends where a block does.
    """
    found = []
    low = _U((1 << 64 - BITS) - 1)
    for first in range(0, max(0, len(data) - WINDOW + 1), BLOCK):
        last = min(first + BLOCK, len(data) - WINDOW + 1)  # windows of this block
        grams = _mixed(hasher.windows(hasher.prefixes(data[first : last + WINDOW - 1]), GRAM)) & ~low
        at = np.arange(len(grams), dtype=np.uint64)
        least = _sliding_least(grams | at, WINDOW - GRAM + 1)  # and its first place
        again = (least & low) != low - (_sliding_least(grams | (low - at), WINDOW - GRAM + 1) & low)
        least = least >> _U(64 - BITS) & ~_U(1)
        place = np.arange(first, last)
        here = np.arange(*np.searchsorted(offsets, [first, last - 1], "right") + [-1, 0])  # texts of the block
        text = np.repeat(here, np.diff(np.clip(offsets[here[0] : here[-1] + 2], first, last)))
        whole = np.flatnonzero(place + WINDOW <= offsets[text + 1])
        if not len(whole):
            continue
        least, text, place, again = least[whole], text[whole], place[whole], again[whole]
        begins = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (again[1:] != again[:-1])])
        found.append((least[begins], text[begins], place[begins], np.diff(np.r_[begins, len(least)]), again[begins]))
    if not found:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, bool)
    return tuple(np.concatenate(part) for part in zip(*found))


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch with the bytes and offsets of their texts; a part has ``SLICE`` bytes or one text."""
    if not batch.num_rows:
        return
    texts = batch.column(column).cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1)
        last = min(last, len(texts))
        part = offsets[first : last + 1]
        yield batch.slice(first, last - first), data[part[0] : part[-1]], part - part[0]
        first = last


def _anchors(batches: Iterator[pa.RecordBatch], shards: int) -> Iterator[pa.RecordBatch]:
    """(c, h, id, text) -> (shard, c, first, steps): sorted anchors of a chunk's texts as a
    first one and the steps between them; odd ones stand in several of the texts."""
    hasher, held, size = Hasher(BLOCK), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        if not held:
            return
        anchor, h, chunk = (np.concatenate(part) for part in zip(*held))
        order = np.lexsort((h, anchor, chunk))
        anchor, h, chunk = anchor[order], h[order], chunk[order]
        fresh = np.r_[True, (anchor[1:] != anchor[:-1]) | (chunk[1:] != chunk[:-1])]
        other = np.r_[False, ~fresh[1:] & (h[1:] != h[:-1])]  # the same anchor in another text
        at = np.flatnonzero(fresh)
        anchor, chunk = anchor[at] | np.maximum.reduceat(other, at).astype(np.uint64), chunk[at]
        shard = (anchor >> _U(1)) % _U(shards)
        order = np.lexsort((anchor, shard, chunk))
        anchor, chunk, shard = anchor[order], chunk[order], shard[order]
        begins = np.flatnonzero(np.r_[True, (chunk[1:] != chunk[:-1]) | (shard[1:] != shard[:-1]), True])
        steps = np.diff(anchor, prepend=anchor[:1])
        parts = []
        for a, b in zip(begins, begins[1:]):
            short = steps[a + 1 : b]
            parts.append(short.astype("<u4").tobytes() if not len(short) or short.max() < 1 << 32 else b"\0" + short.astype("<u8").tobytes())
        first = begins[:-1]
        columns = [pa.array(shard[first].astype(np.int32)), pa.array(chunk[first]), pa.array(anchor[first].astype(np.int64)), pa.array(parts, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "c", "first", "steps"])

    for batch in batches:
        for rows, data, offsets in _slices(batch, 3):
            anchor, text, _, _, _ = anchor_runs(data, offsets, hasher)
            if len(anchor):
                held.append((anchor, rows.column(1).to_numpy()[text], rows.column(0).to_numpy()[text]))
            size += len(data)
            if size >= 8 * CHUNK:
                yield from flush()
                held, size = [], 0
    yield from flush()


def _steps(first: int, steps: bytes) -> np.ndarray:
    """Anchors of a list."""
    wide = len(steps) % 4
    short = np.frombuffer(steps, "<u8" if wide else "<u4", offset=wide)
    return np.cumsum(np.r_[_U(first), short.astype(np.uint64)], dtype=np.uint64)


def _shared(rows: pa.Table) -> pa.Table:
    """Lists of a shard -> (c, anchors): of each chunk those that two texts have; odd ones are hot."""
    lists = [_steps(f, x) for f, x in zip(rows["first"].to_pylist(), rows["steps"].to_pylist())]
    chunk = np.repeat(rows["c"].to_numpy(), [len(x) for x in lists])
    anchor = np.concatenate(lists)
    several, anchor = anchor & _U(1), anchor & ~_U(1)
    order = np.argsort(anchor, kind="stable")
    anchor, chunk, several = anchor[order], chunk[order], several[order]
    at = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    count = np.diff(np.r_[at, len(anchor)])
    hot = np.repeat(count > HOT, count)
    keep = np.repeat((count > 1) | (np.maximum.reduceat(several, at) > 0), count)
    anchor, chunk = (anchor | hot.astype(np.uint64))[keep], chunk[keep]
    order = np.lexsort((anchor, chunk))
    anchor, chunk = anchor[order], chunk[order]
    at = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]]) if len(chunk) else np.zeros(0, np.int64)
    parts = pa.ListArray.from_arrays(pa.array(np.r_[at, len(anchor)], pa.int32()), pa.array(anchor.astype(np.int64)))
    return pa.table([pa.array(chunk[at]), parts], ["c", "anchors"])


def _cut(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Binary array of stretches."""
    ends = np.cumsum(length)
    at = np.repeat(start - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
    offsets = np.r_[0, ends].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _rank(ids: pa.Array) -> np.ndarray:
    """Order of ids as integers, null last; equal ids are equal."""
    if not ids.null_count and pa.types.is_integer(ids.type):
        return np.unique(ids.to_numpy(), return_inverse=True)[1]
    values = ids.to_pylist()
    order = {v: k for k, v in enumerate(sorted({v for v in values if v is not None}))}
    return np.array([len(order) if v is None else order[v] for v in values], np.int64)


def _runs(texts: pa.Table, lists: pa.Table) -> pa.Table:
    """A chunk's (c, h, id, text) and shared anchors -> (key, c, h, id, start, windows, bytes,
    more) of the runs of those anchors, with their further places in the same text.  Of equal runs only the smallest id's are sent; the bytes
    of the others are null, which says that all their windows go."""
    hasher, out = Hasher(BLOCK), []
    found = [x.flatten().to_numpy() for x in lists["anchors"].chunks]
    shared = np.unique(np.concatenate([np.zeros(0, np.int64), *found])).view(np.uint64)
    for batch in texts.to_batches() if len(shared) else []:
        for rows, data, offsets in _slices(batch, 3):
            anchor, text, start, windows, again = anchor_runs(data, offsets, hasher)
            place = np.minimum(np.searchsorted(shared, anchor), len(shared) - 1)
            hit = np.flatnonzero(shared[place] & ~_U(1) == anchor)
            if not len(hit):
                continue
            hot = again[hit] | ((shared[place[hit]] & _U(1)) == 1)
            key, text, start, windows = anchor[hit], text[hit], start[hit], windows[hit]
            rank = _rank(rows.column(2))
            sizes = np.cumsum(np.where(hot, windows * WINDOW, windows + WINDOW - 1))
            for part in np.split(np.arange(len(hit)), np.searchsorted(sizes, np.arange(4 * SLICE, sizes[-1], 4 * SLICE))):
                if len(part):
                    out += _sent(rows, data, offsets, rank, hasher, key[part], text[part], start[part], windows[part], hot[part])
    return pa.Table.from_batches(out, schema=_run_schema(texts.schema.field("id").type))


def _run_schema(id_type: pa.DataType) -> pa.Schema:
    whole = pa.int64()
    return pa.schema([("key", whole), ("c", pa.int32()), ("h", whole), ("id", id_type), ("start", whole), ("windows", whole), ("bytes", pa.binary()), ("more", pa.list_(pa.int64()))])


def _sent(rows, data, offsets, rank, hasher, key, text, start, windows, hot) -> Iterator[pa.RecordBatch]:
    """Some runs as rows, equal ones once."""
    if hot.any():
        # a run for each window, keyed by the window itself
        each = np.where(hot, windows, 1)
        key, text, start, windows, hot = (np.repeat(c, each) for c in (key, text, start, np.where(hot, 1, windows), hot))
        ends = np.cumsum(each)
        start = start + np.arange(len(start)) - np.repeat(ends - each, each)
        spots = np.flatnonzero(hot)
        for first in range(0, len(spots), 1 << 14):
            some = spots[first : first + (1 << 14)]
            words = data[start[some][:, None] + np.arange(WINDOW)]
            key[some] = _mixed((hasher.letter[words] * hasher.power[:WINDOW]).sum(axis=1, dtype=np.uint64))
    cut = _cut(data, start, windows + WINDOW - 1)
    code = cut.dictionary_encode().indices.to_numpy()
    rank = rank[text]
    order = np.lexsort((start, text, rank, code, key))
    fresh = np.r_[True, (key[order][1:] != key[order][:-1]) | (code[order][1:] != code[order][:-1])]
    least = rank[order][np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
    later = np.zeros(len(key), bool)
    later[order] = rank[order] > least
    rows = rows.select(["c", "h", "id"])
    schema = _run_schema(rows.schema.field("id").type)

    def batch(key, text, start, windows, runs, more):
        c, h, ids = (column.take(pa.array(text)) for column in rows.columns)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), c, h, ids, pa.array(start - offsets[text]), pa.array(windows), runs, more], schema=schema)

    # equal runs of one text are one row with further places
    same = ~fresh & np.r_[False, text[order][1:] == text[order][:-1]]
    sent, same = order[~later[order]], same[~later[order]]
    begins = np.flatnonzero(~same)
    some = sent[begins]
    further = np.r_[0, np.cumsum(np.diff(np.r_[begins, len(sent)]) - 1)]
    places = (start - offsets[text])[sent[same]]
    yield batch(key[some], text[some], start[some], windows[some], cut.take(pa.array(some)), pa.ListArray.from_arrays(pa.array(further, pa.int32()), pa.array(places)))
    # neighbouring runs that go whole are one span
    some = np.flatnonzero(later)
    some = some[np.lexsort((start[some], text[some]))]
    text, start, end = text[some], start[some], start[some] + windows[some]
    begins = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] != end[:-1])]) if len(some) else some
    windows = end[np.r_[begins[1:] - 1, len(some) - 1]] - start[begins] if len(some) else end
    text, start = text[begins], start[begins]
    yield batch(_mixed(start.astype(np.uint64)), text, start, windows, pa.nulls(len(begins), pa.binary()), pa.nulls(len(begins), pa.list_(pa.int64())))


class SuffixOrder:
    """Sorted windows of runs: ``order`` lists window numbers, ``same`` tells whether a
    window of the order equals the one before it (and has its group)."""

    def __init__(self, data: np.ndarray, start: np.ndarray, group: np.ndarray, hasher: Hasher):
        self.data, self.start, self.hasher = np.r_[data, np.zeros(8, np.uint8)], start, hasher
        self.prefix = hasher.prefixes(data)
        self.hash = hasher.stretch(self.prefix, start, WINDOW)
        self.group = group
        head = self._word(start)
        order = np.lexsort((head, group))
        tied = (head[order][1:] == head[order][:-1]) & (group[order][1:] == group[order][:-1])
        self.order = self._mergesort(order, np.r_[False, tied])
        before, after = self.order[:-1], self.order[1:]
        equal, wrong = self._verify(before, after)
        if wrong:  # a collision of hashes: sort by the bytes themselves
            raw = self.data.tobytes()
            self.order = np.array(sorted(range(len(start)), key=lambda k: (group[k], raw[start[k] : start[k] + WINDOW])), np.int64)
            equal, _ = self._verify(self.order[:-1], self.order[1:])
        self.same = np.r_[False, equal] if len(start) else np.zeros(0, bool)

    def _word(self, at: np.ndarray) -> np.ndarray:
        """Eight bytes from a place on as a number that orders like them."""
        view = np.ndarray(len(self.data) - 7, ">u8", self.data, strides=(1,))
        return view[at].astype(np.uint64)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of windows that differ, by binary search on hashes."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), WINDOW - 1)
        while (low < high).any():
            middle = (low + high + 1) // 2
            equal = self.hasher.stretch(self.prefix, self.start[a], middle) == self.hasher.stretch(self.prefix, self.start[b], middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """Whether window a comes before window b; ``ties`` says what equal ones give."""
        out = ties.copy()
        differ = np.flatnonzero(self.hash[a] != self.hash[b])
        if len(differ):
            x, y = a[differ], b[differ]
            far = self.common(x, y)
            out[differ] = self.data[self.start[x] + far] < self.data[self.start[y] + far]
        return out

    def _mergesort(self, order: np.ndarray, tied: np.ndarray) -> np.ndarray:
        """Sort the stretches of ``order`` that are tied so far, all of them side by side.

        Sorted pieces of one width are merged in pairs: an element's place is its own
        rank plus the number of elements of the sister piece that come before it, which
        a binary search finds.
        """
        n = len(order)
        first = np.maximum.accumulate(np.where(tied, 0, np.arange(n)))  # begin of each stretch
        begins = np.flatnonzero(~tied)
        end = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n])) if n else first
        active = np.flatnonzero(end - first > 1)
        first, end = first[active], end[active]
        width = 1
        while len(active) and width < (end - first).max():
            rank = active - first
            piece = rank // width
            left = piece % 2 == 0
            own = first + piece * width
            low = np.minimum(np.where(left, own + width, own - width), end)
            high = np.minimum(low + width, end)
            sister = low.copy()
            items = order[active]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                # of equal ones those of the left piece come first
                ahead = self.before(order[middle], items[open_], ~left[open_])
                low[open_] = np.where(ahead, middle + 1, low[open_])
                high[open_] = np.where(ahead, high[open_], middle)
            base = np.where(left, own, own - width)
            order[base + (active - own) + (low - sister)] = items
            width *= 2
        return order

    def _verify(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
        """Which neighbours are equal, and whether any pair is out of order, byte by byte."""
        together = self.group[a] == self.group[b]
        undecided, wrong = together.copy(), False
        for at in [*range(0, WINDOW - 7, 8), WINDOW - 8]:
            rows = np.flatnonzero(undecided)
            x, y = self._word(self.start[a[rows]] + at), self._word(self.start[b[rows]] + at)
            wrong |= bool((x > y).any())
            undecided[rows] = x == y
        return undecided, wrong


def covered_spans(key: np.ndarray, rank: np.ndarray, windows: np.ndarray, runs: pa.Array, hasher: Hasher) -> tuple[np.ndarray, ...]:
    """(run, first window, end) of the stretches of windows that a smaller rank has too."""
    data = np.frombuffer(runs.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(runs.buffers()[1], np.int32)[runs.offset : runs.offset + len(runs) + 1].astype(np.int64)
    data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
    run = np.repeat(np.arange(len(windows)), windows)
    place = np.arange(len(run)) - np.repeat(np.cumsum(windows) - windows, windows)
    sorted_ = SuffixOrder(data, offsets[run] + place, key[run], hasher)
    begins = np.flatnonzero(~sorted_.same)
    ranks = rank[run][sorted_.order]
    least = np.repeat(np.minimum.reduceat(ranks, begins), np.diff(np.r_[begins, len(ranks)])) if len(ranks) else ranks
    gone = np.zeros(len(run) + 1, bool)
    gone[sorted_.order] = ranks > least
    gone, edge = gone[:-1], np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, bool)
    opens = np.flatnonzero(gone & (edge | ~np.r_[False, gone[:-1]]))
    closes = np.flatnonzero(gone & np.r_[edge[1:] | ~gone[1:], True]) if len(run) else opens
    return run[opens], place[opens], place[closes] + 1


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs in order of their keys -> (c, h, id, start, end) of bytes that go."""
    hasher = Hasher(1 << 16)
    names = ["c", "h", "id", "start", "end"]
    held: list[pa.RecordBatch] = []
    size = 0

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        key, windows = rows["key"].to_numpy(), rows["windows"].to_numpy()
        counts = np.diff(np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]))
        many = np.repeat(counts > 1, counts)  # a key's only run meets nobody
        rows = rows.filter(pa.array(many))
        if not rows.num_rows:
            return
        ids = rows["id"].combine_chunks()
        runs = rows["bytes"].combine_chunks()
        run, a, b = covered_spans(rows["key"].to_numpy(), _rank(ids), rows["windows"].to_numpy(), runs, hasher)
        start = rows["start"].to_numpy()[run]
        further = rows["more"].combine_chunks()
        count = further.value_lengths().to_numpy()[run]
        if count.any():  # the same spans at the run's other places
            begin = (further.offsets.to_numpy()[:-1] - further.offsets[0].as_py())[run]
            at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
            start = np.r_[start, further.flatten().to_numpy()[at]]
            run, a, b = (np.r_[x, np.repeat(x, count)] for x in (run, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(rows["c"].to_numpy()[run]), pa.array(rows["h"].to_numpy()[run]), ids.take(pa.array(run)), pa.array(start + a), pa.array(start + b + WINDOW - 1)], names)

    for batch in batches:
        whole = pc.is_null(batch.column("bytes"))
        known = batch.filter(whole)
        if known.num_rows:
            start = known.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([known.column("c"), known.column("h"), known.column("id"), known.column("start"), pa.array(start + known.column("windows").to_numpy() + WINDOW - 1)], names)
        batch = batch.filter(pc.invert(whole))
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.column("bytes").nbytes
        if size >= SORTED:
            rows = pa.Table.from_batches(held)
            key = rows["key"].to_numpy()
            last = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
            if last:
                yield from done(rows.slice(0, last))
            rest = rows.slice(last)
            held = rest.combine_chunks().to_batches()
            size = 0 if last else size
    if held:
        yield from done(pa.Table.from_batches(held))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes under spans; spans that touch are one run."""
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > ends[:-1]]
    begins = np.flatnonzero(fresh)
    return starts[begins], ends[np.r_[begins[1:] - 1, len(ends) - 1]]


def _results(texts: pa.Table, spans: pa.Table, with_kept: bool) -> pa.Table:
    """A chunk's (c, h, id, text) and (c, h, id, start, end) -> what is left of each text."""
    schema = pa.schema([("sha", pa.string()), ("first", texts.schema.field("id").type), *[(n, pa.int64()) for n in ("n_bytes", "n_removed", "n_spans")], ("kept_sha256", pa.string()), *[("kept", pa.binary())] * with_kept])
    h, start, end = (spans[c].to_numpy() for c in ("h", "start", "end"))
    order = np.argsort(h, kind="stable")
    h, start, end, ids = h[order], start[order], end[order], np.array(spans["id"].to_pylist(), object)[order]
    out = []
    for batch in texts.to_batches():
        for rows, data, offsets in _slices(batch, 3):
            own, first = rows.column(1).to_numpy(), rows.column(2).to_pylist()
            begin, stop = np.searchsorted(h, own), np.searchsorted(h, own, "right")
            for k in range(rows.num_rows):
                text = data[offsets[k] : offsets[k + 1]]
                mine = [j for j in range(begin[k], stop[k]) if ids[j] == first[k]]
                sha = kept_sha = hashlib.sha256(text).hexdigest()
                runs, kept = 0, text
                if mine:
                    a, b = merged(start[mine], end[mine])
                    keep = np.ones(len(text), bool)
                    for x, y in zip(a.tolist(), b.tolist()):
                        keep[x:y] = False
                    runs, kept = len(a), text[keep]
                    kept_sha = hashlib.sha256(kept).hexdigest()
                out.append((sha, first[k], len(text), len(text) - len(kept), runs, kept_sha, *[kept.tobytes()] * with_kept))
    columns = zip(*out) if out else [[]] * len(schema)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    docs = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = docs.withColumn("sha", F.sha2("text", 256))
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    copies = marked.groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max(F.octet_length("text")).cast("long").alias("size"))
    copies = stage(copies, "suffix-copies")
    size, rows = copies.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    chunks, shards = max(4 * partitions, size // CHUNK), max(partitions, size // SHARD)
    # texts with more copies than an average partition has rows: fewer than there are partitions
    often = copies.where(F.col("n") * partitions > F.lit(rows)).select("sha", "least", F.lit(True).alias("often"))
    spared = marked.join(F.broadcast(often), "sha", "left").where(F.col("often").isNull() | F.col("id").eqNullSafe(F.col("least")))
    h = F.xxhash64("text")
    moved = spared.select(F.pmod(h, F.lit(chunks)).cast("int").alias("c"), h.alias("h"), "id", "text").repartition("c")
    # all columns wherever it is used: then the exchange is one and the same
    texts = moved.groupBy("c", "h", "text").agg(F.min("id").alias("id")).select("c", "h", "id", "text")

    lists = texts.mapInArrow(lambda batches: _anchors(batches, shards), "shard int, c int, first long, steps binary")
    shared = lists.groupBy("shard").applyInArrow(_shared, "c int, anchors array<long>")
    runs = texts.groupBy("c").cogroup(shared.groupBy("c")).applyInArrow(_runs, f"key long, c int, h long, id {id_type}, start long, windows long, bytes binary, more array<long>")
    spans = runs.repartition("key").sortWithinPartitions("key").mapInArrow(_spans, f"c int, h long, id {id_type}, start long, end long")
    kept = ", kept binary" if with_kept else ""
    cut = lambda a, b: _results(a, b, with_kept)
    results = texts.groupBy("c").cogroup(spans.groupBy("c")).applyInArrow(cut, f"sha string, first {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{kept}")

    found = skew_join(marked.select("id", "sha"), results, ["sha"], "inner", ["id"])
    copy = ~F.col("id").eqNullSafe(F.col("first")) & (F.col("n_bytes") >= WINDOW)
    return found.select(
        "id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(copy, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        *[F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] * with_kept,
    )
