"""Quality by ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - theta_k): one weight vector for all grades, and ordered thresholds theta_1 <= ... The
features x are hashed, in three families that share the table of weights: words, word shapes (length, capitals,
digits, symbols, last byte) and a word's relation to those before it (the same as one of the last four, or not). Each family
is averaged over all words of the whole text, so length doesn't count by itself. The result holds the expected grade and the
tail probability P(grade >= cut), by which documents are selected.

The model is fitted on a bounded sample of labelled rows (at most ``rows`` of them with at most ``most_bytes`` of text together, chosen by a hash
of the id; ``where`` sets rows aside); scoring reads every text whole. Labelled rows without words tell nothing and aren't fitted on. Null text counts as empty; a text without words has no features and gets the scores of x = 0, and is
rejected: there is nothing to keep. With no labels at all, or one grade only among texts with words, nothing is known and every text that has words is kept.
Null ids stay null; repeated rows are scored one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from . import words
from .common import only
from .labelled import MOST_BYTES, sample

BITS = 18


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Three hashed features of each word, a row for each family, and the first word of each text and the end."""
    raw, offsets = words.buffers(column)
    starts, ends = words.spans(raw, offsets)
    first = np.searchsorted(starts, offsets)
    hashes = words.word_hashes(words.lower(raw), starts, ends)
    mask = words.U((1 << BITS) - 1)
    upto = lambda flags: np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])
    count = lambda sums: np.minimum(sums[ends] - sums[starts], 3).astype(np.uint64)
    upper = upto((raw >= 65) & (raw <= 90))
    digit = upto((raw >= 48) & (raw <= 57))
    symbol = upto(((raw >= 33) & (raw <= 47)) | ((raw >= 58) & (raw <= 64)) | ((raw >= 91) & (raw <= 96)) | ((raw >= 123) & (raw <= 126)))
    last = raw[ends - 1].astype(np.uint64) if len(ends) else np.zeros(0, np.uint64)
    last = np.where((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 127)), last, words.U(1))
    length = np.minimum(np.log2(np.maximum(ends - starts, 1)) * 2, 15).astype(np.uint64)
    shape = words.mix(((((count(upper) * words.U(4) + count(digit)) * words.U(4) + count(symbol)) * words.U(16) + length) * words.U(256) + last) ^ words.U(0xA5A5A5A5))
    again = np.zeros(len(hashes), dtype=np.uint64)
    text = np.searchsorted(first, np.arange(len(hashes)), "right")
    for back in (4, 3, 2, 1):
        if len(hashes) > back:
            same = (hashes[back:] == hashes[:-back]) & (text[back:] == text[:-back])
            again[back:][same] = back
    return np.stack([(words.mix(hashes ^ words.U(0x51)) & mask), shape & mask, words.mix(again + words.U(0x77)) & mask]).astype(np.int64), first


def averaged(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The mean over each text's words; 0 for a text without words."""
    upto = np.concatenate([[0.0], np.cumsum(values)])
    n = first[1:] - first[:-1]
    return (upto[first[1:]] - upto[first[:-1]]) / np.maximum(n, 1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class CumulativeLink:
    weights: np.ndarray
    thresholds: np.ndarray  # theta_k of grades[1:]
    grades: list[int]

    def tails(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """P(grade >= k) for each text and each grade but the lowest, and each text's words."""
        index, first = features(column)
        score = averaged(self.weights[index].sum(axis=0), first)
        return sigmoid(score[:, None] - self.thresholds[None, :]), np.diff(first)

    def level(self, cut: int) -> int:
        """The column of the tails that belongs to the lowest grade of ``cut`` or more."""
        return next((k for k, g in enumerate(self.grades[1:]) if g >= cut), len(self.grades) - 2)

    def kept(self, column: pa.Array, cut: int) -> np.ndarray:
        """Whether a text has words and P(grade >= cut) >= 1/2."""
        tails, n = self.tails(column)
        return (tails[:, self.level(cut)] >= 0.5) & (n > 0)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-6) -> CumulativeLink:
    """``rows``: (the distinct features' indices of one text, their mean numbers per word; its grade). Full-batch Adam on the likelihood."""
    rows = [r for r in rows if len(r[0])]
    grades = sorted({g for *_, g in rows})
    if len(grades) < 2:
        return CumulativeLink(np.zeros(1 << BITS, np.float32), np.full(1, -40.0), [0, 1])
    owner = np.repeat(np.arange(len(rows), dtype=np.int32), [len(r[0]) for r in rows])
    index, value = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    level = np.array([grades.index(g) for *_, g in rows])
    used, index = np.unique(index, return_inverse=True)
    index = index.astype(np.int32)
    k = len(grades) - 1
    target = level[:, None] >= np.arange(1, k + 1)[None, :]
    rare = np.maximum(target.mean(axis=0), 1e-3)
    w = np.zeros(len(used), dtype=np.float32)
    first, gaps = -np.log(rare[0] / (1 - min(rare[0], 0.999))), np.full(k - 1, 1.0)
    state = [np.zeros(len(used) + k) for _ in range(2)]
    for t in range(1, rounds + 1):
        theta = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(owner, weights=value * w[index], minlength=len(rows))
        s = np.concatenate([np.ones((len(rows), 1)), sigmoid(score[:, None] - theta[None, :]), np.zeros((len(rows), 1))], axis=1)
        p = np.maximum(s[np.arange(len(rows)), level] - s[np.arange(len(rows)), level + 1], 1e-9)
        slope = s * (1 - s)
        up, down = slope[np.arange(len(rows)), level] / p, slope[np.arange(len(rows)), level + 1] / p
        g = (up - down) / len(rows)
        by_theta = np.zeros(k)
        np.add.at(by_theta, np.maximum(level - 1, 0), np.where(level > 0, -up, 0) / len(rows))
        np.add.at(by_theta, np.minimum(level, k - 1), np.where(level < k, down, 0) / len(rows))
        tail = np.cumsum(by_theta[::-1])[::-1]
        grad = np.concatenate([np.bincount(index, weights=value * g[owner], minlength=len(used)) - decay * w, [tail[0]], tail[1:] * np.exp(gaps)])
        state[0] = 0.9 * state[0] + 0.1 * grad
        state[1] = 0.99 * state[1] + 0.01 * grad**2
        step = rate * (state[0] / (1 - 0.9**t)) / (np.sqrt(state[1] / (1 - 0.99**t)) + 1e-8)
        w += step[: len(used)]
        first += step[len(used)]
        gaps = gaps + step[len(used) + 1 :]
    weights = np.zeros(1 << BITS, np.float32)
    weights[used] = w
    return CumulativeLink(weights, first + np.concatenate([[0], np.cumsum(np.exp(gaps))]), grades)


def indices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in words.slices(batch, "text"):
            index, first = features(b.column("text"))
            blobs = []
            for x, y in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                i, n = np.unique(index[:, x:y], return_counts=True)
                blobs.append(i.astype("<i4").tobytes() + (n / max(y - x, 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), pa.array(blobs, pa.binary())], ["doc_id", "label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6000, where: Column | None = None, most_bytes: int = MOST_BYTES) -> CumulativeLink:
    """Fit on at most ``rows`` labelled documents of ``docs(doc_id, text)`` and ``labels(doc_id, <label>)``."""
    found = sample(docs, labels, label, rows, where, most_bytes).mapInArrow(words.tidy(indices), "doc_id long, label int, x binary").toArrow().sort_by("doc_id")
    halves = [(np.frombuffer(x, "<i4", len(x) // 8), np.frombuffer(x, "<f4", len(x) // 8, len(x) // 2)) for x in found.column("x").to_pylist()]
    return fit([(*h, g) for h, g in zip(halves, found.column("label").to_pylist(), strict=True)])


def score(docs: DataFrame, model: CumulativeLink, cut: int = 1) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= cut)) and kept (tail >= 1/2) of every row."""
    level = model.level(cut)
    steps = np.diff(model.grades)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.slices(batch, "text"):
                tails, n = model.tails(b.column("text"))
                tail = tails[:, level]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.grades[0] + tails @ steps), pa.array(tail), pa.array((tail >= 0.5) & (n > 0))], ["doc_id", "expected_grade", "tail", "kept"])

    return only(docs, "doc_id", "text").mapInArrow(words.tidy(run), "doc_id long, expected_grade double, tail double, kept boolean")
