"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1/-1 that follows from its code point.  A trigram's
vector binds (multiplies) the vectors of its letters, permuted (rolled) by their place.
A text's profile bundles (sums) the vectors of its trigrams; a language's prototype
bundles the profiles of its labelled documents.  A text gets the language whose
prototype has the largest cosine with its profile; that cosine, cut at 0, is the score.

Texts are lower-cased runs of letters with single blanks around them; all else is a
blank.  Defined results: a text that is null or holds no letter gets ``und`` and score 0,
as does every text if no labelled document has letters; equal cosines go to the
alphabetically first language; repeated rows get equal answers; an empty table gives an
empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
DIMENSIONS = 1024
SEED = 7
_LETTERS = re.compile(r"[^\W\d_]+")

#: Characters of texts profiled together, and trigram vectors built at once.
BATCH_CHARS = 250_000
BLOCK = 4096


class Profiler:
    """Profiles of texts; keeps the vectors of the letters it has met."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions = dimensions
        self.row: dict[int, int] = {}
        # per place in a trigram: the letters' vectors, rolled by 2, 1 and 0
        self.vectors = np.empty((3, 0, dimensions), np.int8)

    def _rows(self, codes: np.ndarray) -> np.ndarray:
        different, inverse = np.unique(codes, return_inverse=True)
        fresh = [c for c in different.tolist() if c not in self.row]
        if fresh:
            made = np.stack([np.random.default_rng((SEED, c)).integers(0, 2, self.dimensions, np.int8) * 2 - 1 for c in fresh]).astype(np.int8)
            self.row.update(zip(fresh, range(len(self.row), len(self.row) + len(fresh))))
            self.vectors = np.concatenate([self.vectors, np.stack([np.roll(made, 2 - place, axis=1) for place in range(3)])], axis=1)
        return np.array([self.row[c] for c in different.tolist()], np.int64)[inverse]

    def profiles(self, texts: list[str]) -> np.ndarray:
        """(texts, dimensions) sums of trigram vectors; zero rows for texts without letters."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        keys, owner = [], []
        for k, text in enumerate(texts):
            words = _LETTERS.findall(text.lower())
            if not any(c.isalpha() for word in words for c in word):  # such as a lone superscript
                continue
            codes = np.frombuffer(f" {' '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            keys.append(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:])
            owner.append(np.full(len(codes) - 2, k))
        if not keys:
            return out
        different, place = np.unique(np.concatenate(keys), return_inverse=True)
        cells, counts = np.unique(np.concatenate(owner) * len(different) + place, return_counts=True)
        owner_of, gram_of = np.divmod(cells, len(different))
        mask = (1 << 21) - 1
        letters = [self._rows(different >> shift & mask) for shift in (42, 21, 0)]
        order = np.argsort(gram_of, kind="stable")
        owner_of, gram_of, counts = owner_of[order], gram_of[order], counts[order]
        for first in range(0, len(different), BLOCK):
            last = min(first + BLOCK, len(different))
            a, b = np.searchsorted(gram_of, (first, last))
            weight = np.zeros((len(texts), last - first), np.float32)
            weight[owner_of[a:b], gram_of[a:b] - first] = counts[a:b]
            bound = self.vectors[0][letters[0][first:last]] * self.vectors[1][letters[1][first:last]] * self.vectors[2][letters[2][first:last]]
            out += weight @ bound.astype(np.float32)
        return out


def batches_of(texts: list[str]) -> Iterator[slice]:
    """Slices of at most ``BATCH_CHARS`` characters, one text at least."""
    first = chars = 0
    for k, text in enumerate(texts):
        if k > first and chars + len(text) > BATCH_CHARS:
            yield slice(first, k)
            first, chars = k, 0
        chars += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


@dataclass(frozen=True)
class Prototypes:
    """Languages in alphabetical order and their vectors, of length 1."""

    languages: tuple[str, ...]
    vectors: np.ndarray


def fit(df: DataFrame, label_col: str = "lang", text_col: str = "text", dimensions: int = DIMENSIONS) -> Prototypes:
    """Bundle the profiles of all rows with a label.

    Each task sends one vector per language, these are summed element by element, and
    one vector per language comes to the driver.
    """

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(dimensions), {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in batches_of(texts):
                profiles = profiler.profiles(texts[part])
                for label in set(labels[part]):
                    own = [k for k, x in enumerate(labels[part]) if x == label]
                    sums[label] = sums.get(label, 0) + profiles[own].sum(axis=0, dtype=np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["label", "v"])

    rows = df.select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")).where("label IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInArrow(bundle, "label string, v array<double>").select("label", F.posexplode("v").alias("at", "x"))
    sums = parts.groupBy("label", "at").agg(F.sum("x").alias("x")).where("x <> 0").collect()
    languages = tuple(sorted({r["label"] for r in sums}))
    vectors = np.zeros((len(languages), dimensions))
    row = {label: k for k, label in enumerate(languages)}
    for r in sums:
        vectors[row[r["label"]], r["at"]] = r["x"]
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return Prototypes(languages, (vectors / np.where(norms > 0, norms, 1)).astype(np.float32))


def predict(text: Column, prototypes: Prototypes) -> Column:
    """struct<lang string, score double> of a text column."""

    @F.pandas_udf("lang string, score double")
    def identify(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        profiler = Profiler(prototypes.vectors.shape[1])
        for series in batches:
            texts = ["" if t is None else t for t in series.tolist()]
            langs, scores = [], []
            for part in batches_of(texts):
                profiles = profiler.profiles(texts[part])
                norms = np.linalg.norm(profiles, axis=1)
                known = (norms > 0) & (len(prototypes.languages) > 0)
                cosines = profiles @ prototypes.vectors.T / np.where(norms > 0, norms, 1)[:, None] if len(prototypes.languages) else np.zeros((len(norms), 1))
                best = cosines.argmax(axis=1)
                langs += [prototypes.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                scores += np.where(known, cosines[np.arange(len(best)), best].clip(0, 1), 0.0).tolist()
            yield pd.DataFrame({"lang": pd.Series(langs, dtype=object), "score": pd.Series(scores, dtype=float)})

    return identify(text)


#: A profile further than this from every prototype is no text of a known language.
MIN_SCORE = 0.2


def keep_known(df: DataFrame, label_col: str = "lang", text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Rows whose text is close to a language of the labelled rows; the input's columns only."""
    found = df.select(F.struct("*").alias("row"), predict(F.col(text_col), fit(df, label_col, text_col)).alias("found"))
    return found.where((F.col("found.lang") != UNKNOWN) & (F.col("found.score") >= min_score)).select("row.*")
