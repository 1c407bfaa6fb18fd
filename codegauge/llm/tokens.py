"""Token ids of whole texts by the tokenizers library, each different piece encoded once.

Texts are cut where no token can span.  Between single blanks lie chunks; a chunk of plain
letters (ASCII and Latin-1), digits and marks is cut again into the pieces the tokenizer's
pattern makes of it, any other chunk is a piece.  All bytes of many texts are classed and
cut at once, pieces are dictionary-encoded, and the ids of the different ones are gathered
for every place they stand at.  A worker remembers pieces until they are too many.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Pieces per call of the library.
JOINED = 512
#: Different pieces a worker remembers before it starts afresh; bounds its memory.
MAX_PIECES = 600_000
#: Bytes of texts taken together, and rows whose ids are handed on at once.
SLICE = 1 << 21
ROWS = 512

# classes of bytes; from _QUOTE on a chunk is not cut further
_LETTER, _DIGIT, _MARK, _BLANK, _FEED, _QUOTE, _OTHER = range(7)
_CLASSES = np.full(256, _OTHER, np.uint8)
_CLASSES[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = _MARK
_CLASSES[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_CLASSES[0x30:0x3A] = _DIGIT
_CLASSES[0x20], _CLASSES[0x0A], _CLASSES[0x27] = _BLANK, _FEED, _QUOTE
#: White space of the tokenizers' patterns that is neither blank nor line feed.
_WHITE = re.compile(rb"[\t\x0b-\r]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def load(path: str):
    """The tokenizer, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives a task one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _byte_letters() -> np.ndarray:
    """The letters that byte-level vocabularies write bytes as; a line feed stays."""
    same = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.zeros(256, "<u4")
    letters[same] = same
    others = np.flatnonzero(letters == 0)
    letters[others] = 256 + np.arange(len(others))
    return letters


_BYTE_LETTERS = _byte_letters()
_FEED_LETTER = chr(_BYTE_LETTERS[0x0A])
_BYTE_LETTERS[0x0A] = 0x0A


def _words_alone(tokenizer):
    """The same model for words that are cut already and written in byte letters, or None.

    The library's own cutting takes almost half of its time.
    """
    from tokenizers import Tokenizer, pre_tokenizers

    cutter = tokenizer.pre_tokenizer
    if tokenizer.normalizer is not None or not isinstance(cutter, pre_tokenizers.ByteLevel) or cutter.add_prefix_space:
        return None
    words = Tokenizer(tokenizer.model)
    words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return words


def _after(mask: np.ndarray) -> np.ndarray:
    """The mask, one place later."""
    return np.r_[False, mask[:-1]]


def cut(data: np.ndarray, offsets: np.ndarray, kept: bool, special: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, plain, bytes): pieces of the texts ``data[offsets[k]:offsets[k+1]]``.

    Pieces lie between neighbouring bounds and cover all bytes; ``plain`` tells which were
    cut by class.  ``kept`` says that a blank belongs to the word after it; else white space
    belongs to no token and letters are made small, as the tokenizer does.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64), np.zeros(0, bool), data
    kind = _CLASSES[data]
    lead = data == 0xC3
    if lead.any():  # letters À-ÿ but × and ÷
        second = _after(lead) & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
        kind[second | np.r_[second[1:], False]] = _LETTER
    begins = np.zeros(n + 1, bool)
    begins[offsets] = True
    ends = begins[1:].copy()  # last bytes of texts
    begins = begins[:-1]
    white = (kind == _BLANK) | (kind == _FEED)
    whole = kind >= _QUOTE
    others = [m.span() for m in _WHITE.finditer(data.tobytes())] if whole.any() else []
    for a, b in others:
        white[a:b] = True
    for word in special:
        for m in re.finditer(re.escape(word), data.tobytes()):
            whole[slice(*m.span())] = True
    before, behind = _after(white) & ~begins, np.r_[white[1:], False] | ends
    blank = kind == _BLANK
    good = blank & ~before & ~behind  # one blank before a word: it goes with the word
    if kept:
        # two blanks, or one beside other white space, belong together with their words
        feed = kind == _FEED
        whole |= (blank & ~good) | (feed & (before | behind | begins))
        chunk = begins | good
    else:
        space = blank | (kind == _FEED)
        chunk = begins | space | _after(space & ~good)
    at = np.flatnonzero(chunk)
    plain = ~np.logical_or.reduceat(whole, at)
    inside = np.repeat(plain, np.diff(np.r_[at, n]))
    edge = np.r_[True, kind[1:] != kind[:-1]]
    if not kept:
        edge |= kind == _DIGIT
        small = inside & (((data >= 0x41) & (data <= 0x5A)) | (_after(lead) & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)))
        data = data + small.astype(np.uint8) * np.uint8(0x20)
    bound = chunk | (edge & inside & ~_after(good))
    bounds = np.flatnonzero(bound)
    return np.r_[bounds, n], inside[bounds], data


class ChunkEncoder:
    """Ids of many texts.

    ``blanks`` says what the tokenizer does with white space: ``"kept"`` (a blank
    belongs to the word after it) or ``"dropped"`` (nothing spans white space).
    """

    most = MAX_PIECES

    def __init__(self, path: str, blanks: str):
        if blanks not in ("kept", "dropped"):
            raise ValueError(f"blanks: {blanks!r}")
        self.tokenizer = load(path)
        self.kept = blanks == "kept"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = None
        if self.kept:
            self.line_feed = self._library(["\n"])[0][0]
            self.words = _words_alone(self.tokenizer)
        else:
            vocabulary = self.tokenizer.get_vocab()
            self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends_word[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._forget()

    def _forget(self) -> None:
        self.place: dict[bytes, int] = {}
        self.begin = np.zeros(1024, np.int64)
        self.length = np.zeros(1024, np.int64)
        self.ids = np.zeros(8192, np.int32)
        self.used = 0

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """(lengths, ids) of plain pieces that are encoded as one text, or None if their
        ends cannot be told apart in its ids.

        With blanks kept a line feed, always a token of its own, goes between pieces.
        With blanks dropped a blank goes between, and a piece's last token ends a word.
        """
        if self.words:
            text = _BYTE_LETTERS[np.frombuffer(b"\n".join(pieces), np.uint8)].tobytes().decode("utf-32-le")
            text = text.replace("\n", f" {_FEED_LETTER} ")
            ids = np.array(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        else:
            ids = np.array(self._library([(b"\n" if self.kept else b" ").join(pieces).decode("utf-8", "surrogatepass")])[0], np.int32)
        if self.kept:
            ends = np.flatnonzero(ids == self.line_feed)
            if len(ends) != len(pieces) - 1:
                return None
            return np.diff(np.r_[-1, ends, len(ids)]) - 1, np.delete(ids, ends)
        ends = np.flatnonzero(self.ends_word[ids])
        if len(ends) != len(pieces) or (len(ends) and ends[-1] != len(ids) - 1):
            return None
        return np.diff(np.r_[-1, ends]), ids

    def ids_of(self, pieces: list[bytes], plain: list[bool]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """(order, lengths, ids) of different pieces, each as a text of its own."""
        white = (b"\n", b" ", b"\n ")
        together = [k for k, p in enumerate(plain) if p and pieces[k] not in white]
        alone = [k for k, p in enumerate(plain) if not p or pieces[k] in white]
        order, lengths, ids = [], [], []
        for first in range(0, len(together), JOINED):
            part = together[first : first + JOINED]
            found = self._joined([pieces[k] for k in part])
            if found is None:
                alone += part
            else:
                order += part
                lengths.append(found[0])
                ids.append(found[1])
        if alone:
            found = self._library([pieces[k].decode("utf-8", "surrogatepass") for k in alone])
            order += alone
            lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
            ids.append(np.array([i for x in found for i in x], np.int32))
        return order, np.concatenate(lengths), np.concatenate(ids)

    def _learn(self, pieces: list[bytes], plain: list[bool]) -> np.ndarray:
        """Remember new pieces; their numbers."""
        order, lengths, flat = self.ids_of(pieces, plain)
        order = np.array(order, np.int64)
        first, last = len(self.place), len(self.place) + len(pieces)
        while last > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.length[first:last] = lengths
        self.begin[first:last] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        numbers = np.empty(len(pieces), np.int64)
        numbers[order] = np.arange(first, last)
        self.place.update(zip(pieces, numbers.tolist()))
        return numbers

    def encode(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): ids of text k are ``ids[offsets[k]:offsets[k + 1]]``."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        parts = [self._encode(*part) for part in slices(texts)]
        counts = np.concatenate([np.zeros(1, np.int64), *(np.diff(offsets) for offsets, _ in parts)])
        return np.cumsum(counts), np.concatenate([ids for _, ids in parts]) if parts else np.zeros(0, np.int32)

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bounds, plain, data = cut(data, offsets, self.kept, self.special)
        codes, pieces, first = distinct(bounds, data)
        if len(self.place) + len(pieces) > self.most:
            self._forget()
        at = np.fromiter(map(self.place.get, pieces, repeat(-1)), np.int64, len(pieces))
        fresh = np.flatnonzero(at < 0)
        if len(fresh):
            at[fresh] = self._learn([pieces[k] for k in fresh.tolist()], plain[first[fresh]].tolist())
        at = at[codes]
        lengths = self.length[at]
        ends = np.r_[0, np.cumsum(lengths)]
        ids = self.ids[np.repeat(self.begin[at] - ends[:-1], lengths) + np.arange(ends[-1])]
        return ends[np.searchsorted(bounds, offsets)], ids


def distinct(bounds: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """(codes, pieces, first): number of each place's piece, the different pieces, and the
    first place of each."""
    array = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    found = array.dictionary_encode()
    # by way of numpy: to_pylist is several times slower
    codes, pieces = found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()
    first = np.zeros(len(pieces), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    return codes, pieces, first


def slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of some texts at a time: ``SLICE`` bytes, or one text.  Null is empty."""
    if not len(texts):
        return
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = min(max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE, "right")) - 1), len(texts))
        part = offsets[first : last + 1]
        yield data[part[0] : part[-1]], part - part[0]
        first = last


def worker_encoder(path: str, blanks: str) -> ChunkEncoder:
    """The encoder of this Python worker, with what earlier tasks made it learn.

    Spark reuses workers for many tasks, but this module may reach each task as a copy of
    its own, so the encoder is kept with the library's module.
    """
    import tokenizers

    kept = tokenizers.__dict__.setdefault("_chunk_encoders", {})
    if (path, blanks) not in kept:
        kept.clear()  # one vocabulary at a time
        kept[path, blanks] = ChunkEncoder(path, blanks)
    return kept[path, blanks]


def encoded(batches: Iterator[pa.RecordBatch], text_at: int, encoder: ChunkEncoder, end_id: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with offsets and ids of their texts, ``end_id`` appended to each."""
    for whole in batches:
        for first in range(0, whole.num_rows, ROWS):
            batch = whole.slice(first, ROWS)
            offsets, ids = encoder.encode(batch.column(text_at))
            if end_id is not None:
                ids = np.insert(ids, offsets[1:], end_id).astype(np.int32)
                offsets = offsets + np.arange(len(offsets))
            yield batch, offsets, ids
