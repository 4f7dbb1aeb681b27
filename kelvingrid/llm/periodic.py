"""Periodic runs of words, by Karp-Miller-Rosenberg names of power-of-two stretches.

Words are runs of bytes other than 0x20 and 0x09-0x0D. A *run* is a stretch of words with smallest period q that no neighbouring word extends; it
counts from max(``least``, 4 q) words on.

* Names: level 0 numbers the words, level j + 1 the pairs of names of two neighbouring stretches of 2**j words, by sorting: equal names are equal words, no
  fingerprint decides. A stretch that occurs once in its text needs no name; levels end where no stretch occurs twice.
* Candidates: a run of period q has at least 3 q places i with word i equal to word i + q in a row, so it covers a place of the grid of all multiples of 3 q. For each
  q up to a quarter of the text, the grid's places are extended to both sides by comparing names from the highest level down.
* Of candidates with equal ends the smallest period stays: by the periodicity lemma it divides the others.

Texts of one Arrow batch are named together, about 1 MB of text at a time or one text, whole. Null text has no words; empty texts, texts without words and
texts shorter than ``least`` have no runs. Rows are judged each for itself: null or repeated ids and repeated rows don't matter. Other columns are
ignored. An empty table gives an empty result. A text takes some 60 bytes a word and 4 bytes more for each level, which are as many as the logarithm of its longest repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import only

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
CHUNK = 1 << 20  # grid places looked at together


def named(keys: np.ndarray, at: np.ndarray, n: int) -> np.ndarray | None:
    """Names of the places ``at``: a number from 0 on where the key occurs again, one of its own below 0 elsewhere; None if none does."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    new = np.ones(len(ranked), dtype=bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    again = ~new
    again[:-1] |= ~new[1:]
    if not again.any():
        return None
    names = -1 - np.arange(n + 1, dtype=np.int32)
    names[at[order[again]]] = (np.cumsum(new) - 1)[again]
    return names


def levels(word: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """Names of the stretches of 1, 2, 4, ... words from each place on, as far as any occurs twice in its text; one place more ends the array."""
    n = len(word)
    out: list[np.ndarray] = []
    if n:
        names = named(doc.astype(np.int64) * (int(word.max()) + 1) + word, np.arange(n), n)
        while names is not None:
            out.append(names)
            half = 1 << (len(out) - 1)
            at = np.flatnonzero(names[: max(n - half, 0)] >= 0)
            at = at[names[at + half] >= 0]
            names = named(names[at].astype(np.int64) * (n + 1) + names[at + half], at, n) if len(at) else None
    return out


def forward(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many words from ``a`` on equal those from ``b`` on. A level's stretch matches once at the most: the level above has no match left."""
    out = np.zeros(len(a), dtype=np.int64)
    for j in range(len(names) - 1, -1, -1):
        out += (names[j][a + out] == names[j][b + out]).astype(np.int64) << j
    return out


def backward(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for the words before ``a`` and before ``b``, where a < b."""
    out = np.zeros(len(a), dtype=np.int64)
    for j in range(len(names) - 1, -1, -1):
        at = a - out - (1 << j)
        same = (at >= 0) & (names[j][np.maximum(at, 0)] == names[j][b - out - (1 << j)])
        out += same.astype(np.int64) << j
    return out


def grid(first: np.ndarray, least: int, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period): every multiple of 3 q, counted from a text's first word, for each of its periods q, a chunk at a time."""
    size = np.diff(first)
    doc = np.flatnonzero(size >= max(least, 4))
    most = size[doc] // 4
    upto = np.cumsum(most)
    total = int(upto[-1]) if len(upto) else 0
    for low in range(0, total, chunk):
        pair = np.arange(low, min(low + chunk, total))
        own = np.searchsorted(upto, pair, "right")
        q = pair - (upto[own] - most[own]) + 1
        count = -(-(size[doc[own]] - q) // (3 * q))
        ends = np.cumsum(count)
        at = 0
        while at < len(q):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] - count[at] + chunk, "right")))
            part = slice(at, to)
            step = np.arange(int(count[part].sum())) - np.repeat(ends[part] - count[part] - (ends[at] - count[at]), count[part])
            period = np.repeat(q[part], count[part])
            yield np.repeat(first[doc[own[part]]], count[part]) + 3 * period * step, period
            at = to


def smallest(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (start, end), in order, with the smallest period of each."""
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def runs(word: np.ndarray, first: np.ndarray, least: int = 6, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of all runs of some texts put together; text k has the words from first[k] to first[k + 1]."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    names = levels(word, doc)
    found = tuple(np.zeros(0, dtype=np.int64) for _ in range(3))
    for at, q in grid(first, least, chunk) if names else ():
        hit = np.flatnonzero(names[0][at] == names[0][at + q])
        at, q = at[hit], q[hit]
        after, before = forward(names, at, at + q), backward(names, at, at + q)
        good = after + before + q >= np.maximum(least, 4 * q)
        at, q, after, before = (x[good] for x in (at, q, after, before))
        found = smallest(*(np.concatenate(x) for x in zip(found, (at - before, at + q + after, q), strict=True)))
    return found


def judged(texts: list[bytes], least: int = 6) -> tuple[list[int], pa.Array, list[bytes]]:
    """For each text its number of words, its runs, and the text that is left when each run keeps one period, words joined by one space."""
    split = [t.split() for t in texts]
    count = np.array([len(w) for w in split], dtype=np.int64)
    first = np.concatenate([[0], np.cumsum(count)])
    word = pa.array(chain.from_iterable(split), pa.large_binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start, end, period = runs(word, first, least)
    stay = np.zeros(len(word) + 1, dtype=np.int64)
    np.add.at(stay, start + period, 1)
    np.add.at(stay, end, -1)
    stay = np.cumsum(stay[:-1]) == 0
    whose = np.searchsorted(first, start, "right") - 1
    left = [b" ".join(w) for w in split]
    for k in np.unique(whose).tolist():
        left[k] = b" ".join([w for w, s in zip(split[k], stay[first[k] : first[k + 1]].tolist(), strict=True) if s])
    ends = np.searchsorted(whose, np.arange(len(texts) + 1)).astype(np.int32)
    rows = pa.StructArray.from_arrays([pa.array(start - first[whose]), pa.array(end - start), pa.array(period)], fields=list(RUN))
    return count.tolist(), pa.ListArray.from_arrays(pa.array(ends), rows), left


def detect(docs: DataFrame, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (by start, then period; places are word numbers from 0) and collapsed, the text left, of every row of ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.slices(batch, "text"):
                n, found, left = judged([t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()], least)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), found, pa.array(left, pa.large_binary())], ["doc_id", "n_words", "runs", "collapsed"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = only(docs, "doc_id", "text").mapInArrow(words.tidy(run), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return rows.withColumn("collapsed", F.col("collapsed").cast("string"))


def repeating(key: Column, text: Column) -> Column:
    """The text, which for one id in ten repeats, from a word on, a stretch of its own to its end; words are joined by one space there."""
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10)
    split = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p))), " "))

    # the words are a lambda's variable, so that they are split once
    planted = F.get(F.transform(F.array(split), repeated), 0)
    return F.when((h % 10 == 0) & text.isNotNull(), F.coalesce(planted, text)).otherwise(text)


def summary(rows: DataFrame) -> DataFrame:
    """A row's runs as digests, and the one with the greatest exact ratio of length to period."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    best = F.aggregate("runs", none, lambda m, r: F.when(m.isNull() | (r["length"] * m["period"] > m["length"] * r["period"]), r).otherwise(m))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    rows = rows.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(text, 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def audit(docs: DataFrame) -> DataFrame:
    """``summary`` of ``detect`` over ``repeating`` texts."""
    return summary(detect(docs.select("doc_id", repeating(docs["doc_id"], docs["text"]).alias("text"))))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws,
    [ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')] AS codes
  FROM documents
), h AS (
  SELECT id, doc_id, ws, len(ws) AS n,
    xor(list_reduce(list_prepend(4294967295::BIGINT, codes::BIGINT[]), lambda s, b: list_reduce([xor(s, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, e: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) AS h
  FROM d
), g AS (SELECT *, h // 10 AS g, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM h),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM g),
w AS (
  SELECT id, n, i, CASE WHEN h % 10 = 0 AND i >= a THEN ws[a + (i - a) % p + 1] ELSE ws[i + 1] END AS word
  FROM p, generate_series(0, n - 1) s(i) WHERE n > 0
), pairs AS (
  SELECT x.id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.id = y.id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT id, q, min(i) AS start, max(i) + 1 + q AS stop
  FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS island FROM pairs) GROUP BY id, q, island
), runs AS (
  SELECT id, start, stop, min(q) AS period, stop - start AS length FROM stretches WHERE stop - start >= greatest(6, 4 * q) GROUP BY id, start, stop
), lines AS (
  SELECT id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY id
), ratios AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS place FROM runs),
gone AS (SELECT DISTINCT id, i FROM runs, generate_series(start + period, stop - 1) s(i)),
kept AS (SELECT w.id, string_agg(word, ' ' ORDER BY w.i) AS text FROM w ANTI JOIN gone ON w.id = gone.id AND w.i = gone.i GROUP BY w.id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.start, r.length, r.period, 1000 * r.length // r.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM d LEFT JOIN lines USING (id) LEFT JOIN (SELECT * FROM ratios WHERE place = 1) r USING (id) LEFT JOIN kept k USING (id)
"""
