"""Optimal length buckets: boundaries by dynamic programming over the global histogram of lengths.

Rows are counted for each length over all rows; only that histogram, at most as long as the longest length, comes to the driver, as
Arrow. The dynamic program chooses at most ``buckets`` of the lengths themselves as upper edges so that padding every row to its
bucket's edge costs least: the optimum over the exact lengths. Within a bucket rows are shuffled by a seeded hash, ranked by bucketed
prefix sums, and cut into batches of ``budget // edge`` rows (one row at least, so that texts longer than the
budget are batches of their own, whole). All batches of a bucket but its last have the same number of rows.

``length`` is the column of token counts; by default a token is a byte of the text's UTF-8, and any tokenizer's counts (``token_counts``)
can stand in. Null counts as 0. An empty text has length 0; a bucket of such alone has edge 0 and takes ``budget`` rows a batch. Null ids
and repeated rows are rows like others. An empty table gives an empty result. Other columns are ignored, or carried on request; a carried one that bears the name of one of the
result's own columns, in whatever case, is called ``doc_<name>`` there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import leading, ranked


def boundaries(lengths: np.ndarray, rows: np.ndarray, buckets: int) -> list[int]:
    """At most ``buckets`` of the sorted distinct ``lengths``, the last included, that minimise the padding of all rows.

    best[j]: the least padding of the first j lengths with k buckets. One more bucket of lengths i..j-1 pads its rows to
    lengths[j-1]. The best i never falls as j rises (the cost has the Monge property), so each round halves the j and looks
    only between the best i of its neighbours: all distinct lengths are candidates, in O(buckets * n log n).
    """
    n = len(lengths)
    if not n:
        return []
    e, upto = lengths.astype(np.float64), np.concatenate([[0.0], np.cumsum(rows, dtype=np.float64)])
    best = np.concatenate([[0.0], np.full(n, np.inf)])
    back = []
    for _ in range(min(buckets, n)):
        come = np.zeros(n + 2, dtype=np.int64)
        come[n + 1] = n
        new = np.concatenate([[0.0], np.full(n, np.inf)])
        step = 1 << max(n.bit_length() - 1, 0)
        while step:
            j = np.arange(step, n + 1, 2 * step)  # their neighbours, multiples of twice the step, are done
            lo, hi = come[j - step], np.minimum(np.where(j + step <= n, come[np.minimum(j + step, n + 1)], n), j - 1)
            count = np.maximum(hi - lo + 1, 1)
            at = np.cumsum(count) - count
            i = np.arange(count.sum()) - np.repeat(at - lo, count)
            jj = np.repeat(j, count)
            cost = best[i] + e[jj - 1] * (upto[jj] - upto[i])
            least = np.minimum.reduceat(cost, at)
            hit = np.flatnonzero(cost == np.repeat(least, count))
            first = hit[np.searchsorted(hit, at)]
            come[j], new[j] = i[first], least
            step //= 2
        back.append(come)
        best = new
    out, j = [], n
    for come in reversed(back):
        if j == 0:
            break
        out.append(int(lengths[j - 1]))
        j = int(come[j])
    return out[::-1]


OWN = ("doc_id", "length", "bucket", "edge", "batch", "slot", "padding")


def carried(names: tuple[str, ...]) -> dict[str, str]:
    """What each carried column is called in the result."""
    out: dict[str, str] = {}
    taken = {n.lower() for n in (*OWN, *names)}
    for n in names:
        new = n
        if n.lower() in OWN:
            while (new := f"doc_{new}").lower() in taken:
                pass
            taken.add(new.lower())
        out[n] = new
    return out


def pack(docs: DataFrame, buckets: int = 16, budget: int = 1 << 18, seed: str = "0", length: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, length, bucket (0 is the shortest), edge, batch (in its bucket), slot (in its batch) and padding of every row, and the columns of ``carry``."""
    size = F.octet_length(docs["text"]) if length is None else length
    rows = docs.select(docs["doc_id"], F.coalesce(size, F.lit(0)).cast("long").alias("length"), *[docs[f"`{c}`"].alias(f"__{c}") for c in carry])
    also = [f"`__{c}`" for c in carry]
    hist = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("length")
    cuts = boundaries(hist.column("length").to_numpy(), hist.column("n").to_numpy(), buckets) or [1]
    bucket, edge = F.lit(len(cuts) - 1), F.lit(cuts[-1])
    for k in range(len(cuts) - 2, -1, -1):
        bucket = F.when(F.col("length") <= cuts[k], k).otherwise(bucket)
        edge = F.when(F.col("length") <= cuts[k], cuts[k]).otherwise(edge)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("length").cast("string")))
    rows = rows.select("doc_id", "length", bucket.cast("int").alias("bucket"), edge.cast("long").alias("edge"), key.alias("key"), *also)
    rows = ranked(rows, ["bucket"], [F.col(c) for c in ("key", "doc_id", "length")], leading(F.col("key"), sum(hist.column("n").to_pylist())), "at", "of")
    per = F.expr(f"greatest(1L, {budget}L div greatest(edge, 1L))")
    return rows.withColumn("per", per).select("doc_id", "length", "bucket", "edge", F.expr("at div per").alias("batch"), F.expr("at % per").alias("slot"), (F.col("edge") - F.col("length")).alias("padding"), *[F.col(f"`__{c}`").alias(new) for c, new in carried(carry).items()])
