"""BPE encoding with a minimal acyclic transducer of frequent words, and decoding.

Texts are cut into the pieces of the tokenizer's pattern (``tokens.cut``).  The words of
the corpus that follow a blank are counted; the most frequent ones, with the ids that exact
merging gives them, are compiled into a minimal acyclic automaton: equal suffixes share
states, and the outputs along a word's arcs add up to its row in the table of id lists.
Packed into one string of bytes it is broadcast.  Pieces that the automaton does not accept
are merged pair by pair, lowest rank first, as the vocabulary's merge list says, many words
side by side.  A task encodes and decodes in one Python worker (``transduce``).  Only chunks between blanks that hold other characters than plain letters,
digits and marks, irregular white space or special tokens go to the tokenizers library.

Defined results: a null text counts as empty and has no ids; null ids decode to null;
bytes that are no UTF-8 decode to U+FFFD; equal texts get equal ids whatever the lexicon
holds; an empty table gives an empty table (and an empty lexicon).
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codegauge.llm.tokens import ROWS, ChunkEncoder, cut, distinct, slices, worker_encoder
from codegauge.storage import stage

#: Most words a lexicon holds, and how often a word must stand in the corpus for it.
LEXICON_WORDS = 1 << 16
MIN_COUNT = 4
#: Words counted by a task before it passes its counts on.
COUNTED = 120_000


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes
    stand for themselves, the others for the letters from 256 on, in order."""
    printable = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Merger:
    """Exact byte-level BPE of a vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.base = [vocab[letter] for letter in letters]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        byte_of = {letter: b for b, letter in enumerate(letters)}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()}
        self.bytes_of.update((i, content.encode()) for content, i in self.special.items())
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.special_cut = re.compile("|".join(f"({re.escape(s)})" for s in self.special) or r"(?!)")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the lowest-ranked pair is merged until none is left."""
        ids = [self.base[b] for b in piece]
        merges = self.merges
        while len(ids) > 1:
            found = [merges.get(pair) for pair in zip(ids, ids[1:])]
            best = min((m for m in found if m), default=None)
            if best is None:
                break
            out, k, last = [], 0, len(ids) - 1
            while k <= last:
                if k < last and found[k] == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids

    def ids(self, text: str) -> list[int]:
        """Ids of any text: special tokens are cut out first, then pre-tokens are merged."""
        out: list[int] = []
        for part in self.special_cut.split(text) if self.special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for piece in self.cut.findall(part):
                    out += self.merge(piece.encode("utf-8", "surrogatepass"))
        return out


class PairTable:
    """Ranks and results of merges, for arrays of pairs: open addressing in two arrays."""

    BITS = 18

    def __init__(self, merger: Merger):
        self.base = np.array(merger.base, np.int64)
        pairs = np.array([(a << 32 | b, rank << 32 | new) for (a, b), (rank, new) in merger.merges.items()], np.int64).reshape(-1, 2)
        size = 1 << self.BITS
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, np.iinfo(np.int64).max)
        todo, slot = np.arange(len(pairs)), self._slot(pairs[:, 0])
        while len(todo):  # of those that want a slot the first takes it, the others go on
            free = self.keys[slot] == -1
            places, winner = np.unique(slot[free], return_index=True)
            won = np.flatnonzero(free)[winner]
            self.keys[places], self.values[places] = pairs[todo[won], 0], pairs[todo[won], 1]
            left = np.ones(len(todo), bool)
            left[won] = False
            todo, slot = todo[left], (slot[left] + 1) % size

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """rank << 32 | result of each pair; the greatest number for pairs without a merge."""
        keys = left << 32 | right
        out, slot = np.full(len(keys), np.iinfo(np.int64).max), self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            at = self.keys[slot]
            hit = at == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (at != -1)
            todo, slot = todo[on], (slot[on] + 1) % len(self.keys)
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, ids) of pre-tokens: in each word the lowest-ranked pair is merged
        wherever it stands, until no word has any."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.base[np.frombuffer(b"".join(pieces), np.uint8)]
        word = np.repeat(np.arange(len(pieces)), lengths)
        done_ids, done_word = [], []
        none = np.iinfo(np.int64).max
        while len(ids):
            found = np.full(len(ids), none)
            pair = np.flatnonzero(word[:-1] == word[1:])
            found[pair] = self.find(ids[pair], ids[pair + 1])
            begins = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[begins, len(ids)])
            least = np.repeat(np.minimum.reduceat(found, begins), size)
            over = least == none
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = (found == least) & ~over
            # of overlapping pairs (aaa) every second one, from the left
            at = np.arange(len(ids))
            start = np.maximum.accumulate(np.where(hit & ~np.r_[False, hit[:-1] & (word[1:] == word[:-1])], at, 0))
            hit &= (at - start) % 2 == 0
            ids = np.where(hit, least & 0xFFFFFFFF, ids)
            stay = ~over & ~np.r_[False, hit[:-1]]
            ids, word = ids[stay], word[stay]
        if not done_ids:
            return np.zeros(len(pieces), np.int64), np.zeros(0, np.int32)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return np.bincount(word, minlength=len(pieces)), ids[order].astype(np.int32)


def word_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n) of the plain words after a blank; a task sums its words before it sends them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            words = pa.array([w[1:] for w in counts], pa.binary()).cast(pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for data, offsets in slices(batch.column(0)):
                bounds, plain, data = cut(data, offsets, True, [])
                codes, pieces, first = distinct(bounds, data)
                n = np.bincount(codes, minlength=len(pieces)).tolist()
                counts.update({p: k for p, k, good in zip(pieces, n, plain[first].tolist()) if good and p[:1] == b" " and len(p) > 1})
            if len(counts) > COUNTED:
                yield flush()
                counts.clear()
        yield flush()

    return df.select(F.col(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(df: DataFrame, text_col: str = "text", most: int = LEXICON_WORDS, min_count: int = MIN_COUNT) -> list[str]:
    """At most ``most`` words, the most frequent ones; of those as frequent as the last
    the first in order.

    Words are binned by the logarithm of their count to find the least count that fits:
    some hundred rows, then at most ``most`` words, reach the driver.
    """
    counts = stage(word_counts(df, text_col).where(F.col("n") >= min_count), "lexicon-words")
    bins = F.floor(F.log2("n") * 16).cast("int")
    sizes = {r["b"]: r["n"] for r in counts.groupBy(bins.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total, words = 0, []
    for b in sorted(sizes, reverse=True):
        if total + sizes[b] > most:
            rest = counts.where(bins == b).orderBy(F.col("n").desc(), "word").limit(most - total)
            words = [r["word"] for r in rest.select("word").collect()]
            break
        total += sizes[b]
    else:
        b = min(sizes, default=0) - 1
    return [r["word"] for r in counts.where(bins > b).select("word").collect()] + words


def compile_words(entries: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal acyclic automaton of ``entries`` and their id lists.

    Words are added in order; states that no further word can pass are merged with an
    equal state, if there is one.  An arc's output is the number of words that come
    before those beyond it, so outputs add up to the word's row.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    finished: list[tuple] = []  # (final, ((byte, state), ...)) of each state

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(finished)
            finished.append(key)
        return register[key]

    open_nodes = [[False, []]]  # along the last word: [final, arcs of closed targets]
    last = b""
    for word in words:
        common = os.path.commonprefix([word, last])
        for depth in range(len(last), len(common), -1):
            state = close(open_nodes.pop())
            open_nodes[-1][1].append((last[depth - 1], state))
        open_nodes += [[False, []] for _ in range(len(common), len(word))]
        open_nodes[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        state = close(open_nodes.pop())
        open_nodes[-1][1].append((last[depth - 1], state))
    root = close(open_nodes.pop())

    size = np.zeros(len(finished), np.int64)  # words beyond a state; targets are closed first
    keys, targets, outs = [], [], []
    for state, (final, arcs) in enumerate(finished):
        size[state] = final
        for byte, target in arcs:
            keys.append(state << 8 | byte)
            targets.append(target)
            outs.append(size[state])
            size[state] += size[target]
    lists = [entries[w] for w in words]
    lengths = np.array([len(x) for x in lists], np.int64)
    return {
        "root": np.array([root], np.int64),
        "final": np.array([f for f, _ in finished], np.int8),
        "keys": np.array(keys, np.int64),
        "targets": np.array(targets, np.int32),
        "outs": np.array(outs, np.int32),
        "begin": np.r_[0, np.cumsum(lengths)].astype(np.int64),
        "ids": np.fromiter(chain.from_iterable(lists), np.int32, int(lengths.sum())),
    }


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """An automaton as bytes: a JSON line that tells where each array lies, then the arrays."""
    at, index = 0, {}
    for name, array in arrays.items():
        index[name] = [array.dtype.str, at, len(array)]
        at += -(-array.nbytes // 8) * 8
    head = json.dumps(index).encode()
    head += b" " * (-(len(head) + 9) % 8) + b"\n"
    return b"".join([len(head).to_bytes(8, "little"), head, *(array.tobytes() + b"\0" * (-array.nbytes % 8) for array in arrays.values())])


def unpacked(whole: np.ndarray) -> dict[str, np.ndarray]:
    """The arrays of a packed automaton, as views of its bytes."""
    head = int(whole[:8].view("<i8")[0])
    index = json.loads(whole[8 : 8 + head].tobytes())
    base = 8 + head
    return {name: whole[base + at : base + at + np.dtype(kind).itemsize * n].view(kind) for name, (kind, at, n) in index.items()}


def save(arrays: dict[str, np.ndarray], path: str) -> None:
    """A packed automaton as a file."""
    with open(path, "wb") as file:
        file.write(packed(arrays))


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a saved automaton, mapped and not read."""
    return unpacked(np.memmap(path, np.uint8, "r"))


def look_up(arrays: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """Row of each word, -1 if it is not in the lexicon; all words walk the arcs together."""
    rows = np.full(len(words), -1, np.int64)
    keys, final = arrays["keys"], arrays["final"]
    if not len(keys) or not words:
        return rows
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    begin = np.cumsum(lengths) - lengths
    alive, at = np.arange(len(words)), 0
    state, row = np.full(len(words), arrays["root"][0]), np.zeros(len(words), np.int64)
    while len(alive):
        ended = lengths[alive] == at
        hit = ended & (final[state] == 1)
        rows[alive[hit]] = row[hit]
        alive, state, row = alive[~ended], state[~ended], row[~ended]
        if not len(alive):
            break
        wanted = state << 8 | text[begin[alive] + at]
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        found = keys[place] == wanted
        alive, place = alive[found], place[found]
        state, row = arrays["targets"][place].astype(np.int64), row[found] + arrays["outs"][place]
        at += 1
    return rows


@dataclass(frozen=True)
class Lexicon:
    """A compiled lexicon, broadcast, and the vocabulary it belongs to."""

    vocabulary: str
    data: Broadcast


def build_lexicon(df: DataFrame, vocabulary: str, text_col: str = "text", most: int = LEXICON_WORDS) -> Lexicon:
    """Count, merge and compile the frequent words of ``df`` and broadcast them."""
    words = [b" " + w.encode() for w in frequent_words(df, text_col, most)]
    lengths, ids = PairTable(Merger(vocabulary)).merge(words)
    ends = np.cumsum(lengths)
    arrays = compile_words({w: ids[e - n : e].tolist() for w, n, e in zip(words, lengths, ends)})
    # some MB at most, whatever the corpus holds
    return Lexicon(vocabulary, df.sparkSession.sparkContext.broadcast(packed(arrays)))


class WordEncoder(ChunkEncoder):
    """Ids of whole texts: lexicon first, exact merging for plain pieces it has not."""

    most = 150_000  # learning is cheap here, memory is not

    def __init__(self, library: ChunkEncoder, arrays: dict[str, np.ndarray], pairs: PairTable):
        self.tokenizer, self.kept, self.special, self.line_feed = library.tokenizer, True, library.special, library.line_feed
        self.arrays, self.pairs = arrays, pairs
        self._forget()

    def ids_of(self, pieces: list[bytes], plain: list[bool]) -> tuple[list[int], np.ndarray, np.ndarray]:
        ours = np.flatnonzero(plain)
        rows = look_up(self.arrays, [pieces[k] for k in ours])
        known, unseen = ours[rows >= 0], ours[rows < 0]
        begin, rows = self.arrays["begin"], rows[rows >= 0]
        lengths = begin[rows + 1] - begin[rows]
        at = np.repeat(begin[rows] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        found = [(known, lengths, self.arrays["ids"][at]), (unseen, *self.pairs.merge([pieces[k] for k in unseen]))]
        others = np.flatnonzero(~np.asarray(plain, bool))
        if len(others):
            order, counts, ids = super().ids_of([pieces[k] for k in others], [False] * len(others))
            found.append((others[order], counts, ids))
        return tuple(np.concatenate(part) for part in zip(*found))


class TokenBytes:
    """The bytes of every token, in one array."""

    def __init__(self, merger: Merger):
        size = max(merger.bytes_of) + 1
        tokens = [merger.bytes_of.get(i) for i in range(size)]
        self.missing = np.array([t is None for t in tokens])
        self.length = np.array([len(t or b"") for t in tokens], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.data = np.frombuffer(b"".join(t or b"" for t in tokens), np.uint8)

    def text(self, ids: pa.ListArray) -> pa.Array:
        """Text of each list: its tokens' bytes, joined and read as UTF-8."""
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        if len(flat) and (flat.min() < 0 or flat.max() >= len(self.length) or self.missing[flat].any()):
            raise KeyError("an id that the vocabulary does not have")
        ends = np.r_[0, np.cumsum(self.length[flat])]
        at = np.repeat(self.begin[flat] - ends[:-1], self.length[flat]) + np.arange(ends[-1])
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = ends[np.r_[0, np.cumsum(counts)]].astype(np.int32)
        joined = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(self.data[at])])
        try:
            texts = joined.cast(pa.string())
        except pa.ArrowInvalid:
            texts = pa.array([x.decode("utf-8", "replace") for x in joined.to_pylist()], pa.string())
        return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string()))


def worker_tables(vocabulary: str) -> tuple[PairTable, TokenBytes]:
    """Merges and token bytes of a vocabulary, read once in a Python worker's life
    (kept where ``tokens.worker_encoder`` keeps its encoder)."""
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_transducer_tables", {})
    if vocabulary not in kept:
        kept.clear()  # one vocabulary at a time
        merger = Merger(vocabulary)
        kept[vocabulary] = PairTable(merger), TokenBytes(merger)
    return kept[vocabulary]


def word_encoder(lexicon: Lexicon) -> WordEncoder:
    """A task's encoder."""
    arrays = unpacked(np.frombuffer(lexicon.data.value, np.uint8))
    return WordEncoder(worker_encoder(lexicon.vocabulary, "kept"), arrays, worker_tables(lexicon.vocabulary)[0])


def id_lists(encoder: WordEncoder, texts: pa.Array) -> pa.ListArray:
    offsets, flat = encoder.encode(texts)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))


def transduce(df: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every row: the ids of its text, and the text these ids stand for.

    Both in one Python worker a task; ``encode`` and ``decode`` in one select are two workers,
    the second fed by the first.
    """
    id_type = df.select(id_col).schema[0].dataType.simpleString()

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, tokens = word_encoder(lexicon), worker_tables(lexicon.vocabulary)[1]
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS):
                batch = whole.slice(first, ROWS)
                ids = id_lists(encoder, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids, tokens.text(ids)], ["id", "ids", "decoded"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(both, f"id {id_type}, ids array<int>, decoded string")


def encode(text: Column, lexicon: Lexicon) -> Column:
    """array<int> of ids of a text column."""

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = word_encoder(lexicon)
        for batch in batches:
            yield pa.concat_arrays([id_lists(encoder, batch.slice(first, ROWS)) for first in range(0, max(1, len(batch)), ROWS)])

    return ids(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """Text of an array<int> column: the tokens' bytes, joined and read as UTF-8."""

    @F.arrow_udf(T.StringType())
    def text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = worker_tables(vocabulary)[1]
        for batch in batches:
            parts = [batch.slice(first, ROWS) for first in range(0, max(1, len(batch)), ROWS)]
            yield pa.concat_arrays([tokens.text(part) for part in parts])

    return text(ids)
