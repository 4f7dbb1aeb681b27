"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features of a whole text: densities and counts of lexicon words and lexicon stems, their number after letters that stand
in for others are put back (0 for o, @ for a, ...), their nearness to words of the second person, capitals, words in capitals,
punctuation, exclamation marks, words that mix letters with digits or symbols (obfuscation), and length.

The lexicon is mined from labelled rows: words, and stems of 4 to 6 bytes, that toxic texts hold and others hardly do.
All is fitted on one bounded sample (``rows`` and ``most_bytes``, chosen by a hash of the id). A row's features for the trees come from a lexicon that
the other folds gave, so that words which are toxic by chance don't mislead the trees; scores use the whole sample's lexicon. The
calibration's rows are apart from the trees'. Only the text is an input of a score.

Null text counts as empty; a text without words gets the score of an empty text. Without any labels every score is the same,
below 1/2. Null ids stay null and are not held out. Repeated rows are scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import only
from .labelled import MOST_BYTES, sample
from .trees import Boosted, Isotonic, boost, isotonic

STEMS = (4, 5, 6)
FOLDS = 3
NEAR = 5
#: Words of the second person in the corpus's four languages.
SECOND = "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch euer eure tú ti usted ustedes vosotros tus"
#: Characters that stand in for letters.
STANDS_FOR = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
NAMES = ("words", "word_hits", "word_density", "stem_hits", "stem_density", "restored_hits", "near_second", "second", "capitals", "loud_words", "punctuation", "exclamations", "mixed_words")


def _table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    for a, b in STANDS_FOR.items():
        table[ord(a)] = ord(b)
    return table


RESTORE = _table()
LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, dtype=bool)
DIGIT[48:58] = True
INSIDE = LETTER | DIGIT


def runs(data: np.ndarray, offsets: np.ndarray, solid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of some bytes; none crosses a row's end."""
    return words.spans(np.where(solid[data], data | np.uint8(128), np.uint8(32)), offsets)


def hashed(text: str) -> np.ndarray:
    column = pa.array([text])
    return np.unique(words.text_words(column)[3])


class Tokens:
    """Words (runs of letters and digits) of a column of texts, with the hashes that the lexicon is about."""

    def __init__(self, column: pa.Array):
        self.raw, self.offsets = words.buffers(column)
        self.data = words.lower(self.raw)
        self.starts, self.ends = runs(self.data, self.offsets, INSIDE)
        self.first = np.searchsorted(self.starts, self.offsets)
        self.hashes = words.word_hashes(self.data, self.starts, self.ends)

    def stems(self) -> Iterator[np.ndarray]:
        """For each stem length the hash of each word's stem, 0 for words that are not longer."""
        for k in STEMS:
            longer = self.ends - self.starts > k
            out = np.zeros(len(self.starts), dtype=np.uint64)
            out[longer] = words.word_hashes(self.data, self.starts[longer], self.starts[longer] + k) + words.U(k)
            yield out


def isin(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return (upto[first[1:]] - upto[first[:-1]]).astype(np.float64)


@dataclass
class Lexicon:
    words: np.ndarray  # sorted hashes
    stems: np.ndarray

    def dense(self, column: pa.Array) -> np.ndarray:
        """The features of each text, in the order of NAMES."""
        t = Tokens(column)
        n = np.diff(t.first).astype(np.float64)
        some = np.maximum(n, 1)
        word = isin(t.hashes, self.words)
        stem = np.zeros(len(word), dtype=bool)
        for own in t.stems():
            stem |= isin(own, self.stems)
        hit = word | stem
        second = isin(t.hashes, SECOND_HASHES)
        upto = np.concatenate([[0], np.cumsum(second, dtype=np.int64)])
        at = np.flatnonzero(hit)
        text = np.searchsorted(t.first, at, "right") - 1
        lo, hi = np.maximum(at - NEAR, t.first[text]), np.minimum(at + NEAR + 1, t.first[text + 1])
        close = np.bincount(text, upto[hi] > upto[lo], len(n))[: len(n)] if len(at) else np.zeros(len(n))
        restored = RESTORE[t.data]
        s, e = runs(restored, t.offsets, INSIDE)
        odd = np.concatenate([[0], np.cumsum(restored != t.data, dtype=np.int64)])
        changed = odd[e] > odd[s]
        s, e = s[changed], e[changed]
        back = isin(words.word_hashes(restored, s, e), self.words)
        whole_s, whole_e = words.spans(t.data, t.offsets)
        count = lambda table: np.concatenate([[0], np.cumsum(table[t.raw], dtype=np.int64)])
        letters, digits = count(LETTER), count(DIGIT)
        upper_ = np.zeros(256, dtype=bool)
        upper_[65:91] = True
        upper = count(upper_)
        punctuation = np.concatenate([[0], np.cumsum(~INSIDE[t.raw] & (t.raw > 32), dtype=np.int64)])
        bang = np.concatenate([[0], np.cumsum(t.raw == 33, dtype=np.int64)])
        span = lambda sums, a, b: sums[b] - sums[a]
        whole = np.searchsorted(whole_s, t.offsets)
        size = whole_e - whole_s
        loud = (span(upper, whole_s, whole_e) == span(letters, whole_s, whole_e)) & (span(upper, whole_s, whole_e) > 1)
        inner = np.maximum(whole_e - 1, whole_s)
        mixed = (span(letters, whole_s, whole_e) > 0) & ((span(digits, whole_s, whole_e) > 0) | (span(punctuation, whole_s, inner) > 0)) & (size > 1)
        a, b = t.offsets[:-1], t.offsets[1:]
        size = np.maximum(b - a, 1)
        n_whole = np.maximum(np.diff(whole), 1)
        word_hits, stem_hits = per_text(word, t.first), per_text(stem, t.first)
        restored_hits = per_text(back, np.searchsorted(s, t.offsets))
        return np.stack([
            np.log1p(n), np.log1p(word_hits), word_hits / some, np.log1p(stem_hits), stem_hits / some, np.log1p(restored_hits), close / some,
            per_text(second, t.first) / some, span(upper, a, b) / np.maximum(span(letters, a, b), 1), per_text(loud, whole) / n_whole,
            span(punctuation, a, b) / size, span(bang, a, b) / size, per_text(mixed, whole) / n_whole,
        ], axis=1)


SECOND_HASHES = hashed(SECOND)


@dataclass
class Model:
    lexicon: Lexicon
    trees: Boosted
    calibration: Isotonic

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.clip(self.calibration(self.trees.raw(self.lexicon.dense(column))), 0.0, 1.0)


def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct hashes of words and of stems of each text."""
    for batch in batches:
        for b in words.slices(batch, "text"):
            t = Tokens(b.column("text"))
            stems = list(t.stems())
            own = []
            for x, y in zip(t.first[:-1].tolist(), t.first[1:].tolist(), strict=True):
                own.append((np.unique(t.hashes[x:y]).tobytes(), np.unique(np.concatenate([s[x:y] for s in stems])).tobytes()))
            yield pa.RecordBatch.from_arrays([b.column("label"), b.column("draw"), pa.array([o[0] for o in own], pa.binary()), pa.array([o[1] for o in own], pa.binary())], ["label", "draw", "words", "stems"])


def mined(texts: list[bytes], label: np.ndarray, least: int, purity: float) -> np.ndarray:
    """Sorted hashes that at least ``least`` toxic texts hold, with toxic texts among all that hold them as ``purity``."""

    def counted(which: int) -> tuple[np.ndarray, np.ndarray]:
        own = [np.frombuffer(t, "<u8") for t, y in zip(texts, label.tolist(), strict=True) if y == which]
        return np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    bad, n = counted(1)
    bad, n = bad[n >= least], n[n >= least]
    good, m = counted(0)
    at = np.minimum(np.searchsorted(good, bad), max(len(good) - 1, 0))
    other = np.where(good[at] == bad, m[at], 0) if len(good) else np.zeros(len(bad))
    keep = (n / np.maximum(n + other, 1) >= purity) & (bad != 0)
    return bad[keep]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 6000, where: Column | None = None, purity: float = 0.9, most_bytes: int = MOST_BYTES) -> Model:
    """Fit on at most ``rows`` labelled documents, of ``most_bytes`` of text together, for which ``where`` (over the labels' doc_id) holds."""
    chosen = sample(docs, labels, label, rows, where, most_bytes)
    part = chosen.mapInArrow(words.tidy(distinct), "label int, draw double, words binary, stems binary").toArrow()
    y, fold_of = np.asarray(part.column("label").to_pylist(), dtype=np.int64), np.asarray([int(d * FOLDS) for d in part.column("draw").to_pylist()], dtype=np.int64)

    def lexicon(rows: np.ndarray) -> Lexicon:
        bad = int((y[rows] == 1).sum())
        least = max(3 if bad < 100 else 4, int(0.002 * bad))
        which = pa.array(np.flatnonzero(rows))
        return Lexicon(*[mined(part.column(c).take(which).to_pylist(), y[rows], least, purity) for c in ("words", "stems")])

    held_in = [lexicon(fold_of != k) for k in range(FOLDS)]
    whole = lexicon(np.ones(len(y), dtype=bool))
    del part

    def dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.slices(batch, "text"):
                fold_of = (b.column("draw").to_numpy() * FOLDS).astype(int)
                for k in np.unique(fold_of).tolist():
                    own = b.filter(pa.array(fold_of == k))
                    x = held_in[k].dense(own.column("text"))
                    yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("label"), own.column("draw"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "draw", "x"])

    found = chosen.mapInArrow(words.tidy(dense), "doc_id long, label int, draw double, x binary").toArrow().sort_by("doc_id")
    x = np.array([np.frombuffer(v, "<f8") for v in found.column("x").to_pylist()]).reshape(-1, len(NAMES))
    y, draw = np.asarray(found.column("label").to_pylist(), dtype=np.float64), np.asarray(found.column("draw").to_pylist(), dtype=np.float64)
    fitting = (draw * FOLDS) % 1 < 0.75
    trees = boost(x[fitting], y[fitting])
    return Model(whole, trees, isotonic(trees.raw(x[~fitting]), y[~fitting]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score and predicted of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.slices(batch, "text"):
                s = model.scores(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return only(docs, "doc_id", "text").mapInArrow(words.tidy(run), "doc_id long, score double, predicted int")


def fold() -> Column:
    """crc32 of the id as text, modulo 5; 0 is held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
