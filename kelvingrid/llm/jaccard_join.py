"""N-gram Jaccard self-join of whole documents by vertical partitioning.

A document is its set of word shingles. Documents with the same set are one *class*; a class is what the join
compares. All shingles have one global order: rarest first, by the number of classes that hold them, then by hash; the *hot* ones come last.

1. *Facts.* Each task names its documents' classes by 128 bits, and keeps a merging summary of the shingles that are frequent among all its classes, of fixed
   size (``Frequent``). The sum of the tasks' reports, which are lower bounds, gives the hot shingles, those of surely 1 in ``HOT_SHARE`` documents; with ``s`` shingles a document
   on average there can be no more than ``HOT_SHARE * s`` of them, whatever the data, so every task gets their list. A summary may miss a shingle of fewer than
   s / 2**18 of its documents, which then is cold: that moves work, not results.
2. *Counting.* Every class's other shingles are cut into fragments of the hash range and packed. A fragment counts in how many
   classes each of its shingles occurs and replies with the shared ones. How many fragments there are follows from the number of shingles.
3. *Segments.* A class gathers its replies; shingles without a reply are its own. If these alone rule out the
   threshold, it has no partner; most classes end here. The others keep their shared shingles in the global order.
4. *Candidates.* Any two classes that link share one of their prefixes' shingles (the first ``size - least overlap + 1``), and their sizes
   are in one range of ratio 100 / threshold or in neighbouring ones. So for each prefix shingle the classes of a size range are tied to the least of
   them, and the least ones of neighbouring ranges to each other. What these ties connect, a *cluster*, holds all links of its classes.
5. *Overlaps.* A cluster's classes meet in tiles: pairs of parts of one size range or of neighbouring ones. The shared shingles are cut into fragments; each (tile, fragment)
   is a group that counts the partial overlaps of all its pairs as one packed matrix. The matrices of a tile are summed, and the
   exact test of the sums decides. A tile returns a spanning forest of its links, never pairs as rows.

Two documents link when 100 * overlap >= threshold * union. Documents with fewer words than a shingle are one
shingle of all their words; without words (null, empty or blank text) they have no shingle and link with
nothing. Repeated rows are one class. A row without an id counts for its class but never names a component; it has none if no row of it has an id. Texts of
any length are taken whole, with some 30 bytes of memory a byte. An empty table gives an empty result. Columns other than the id and the text are ignored.
Shingles are compared by 64-bit hashes of their words' hashes, whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import words
from .common import components, cut, drop, forest_of, only, publish

BATCH = 1 << 20
SUMMED = 1 << 19
HOT_SHARE = 2048
HOT_LEAST = 64
ENTRIES = 1 << 22
FRAGMENT = 4096
TILE = 1024
TOKENS = 1 << 20
SEGMENT = 1 << 19
SALTS = 32


def least_overlap(size, threshold: int):
    """The smallest overlap that a set of ``size`` needs with any partner."""
    return -(-threshold * size // 100)


def set_names(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two signed 64-bit names of each set of hashes; zeros for an empty one."""
    out = np.zeros((2, len(sets)), dtype=np.uint64)
    some = np.array([k for k, s in enumerate(sets) if len(s)], dtype=np.int64)
    if len(some):
        size = np.array([len(sets[k]) for k in some.tolist()], dtype=np.int64)
        all_, at = np.concatenate([sets[k] for k in some.tolist()]), np.cumsum(size) - size
        for lane, salt in enumerate((words.U(0x5851F42D4C957F2D), words.U(0x14057B7EF767814F))):
            mixed = words.mix(all_ ^ salt)
            total = np.add.reduceat(mixed, at) * words.U(0x9E3779B97F4A7C15) + np.bitwise_xor.reduceat(words.mix(mixed + salt), at)
            out[lane, some] = words.mix(total + size.astype(np.uint64) * salt)
    return out[0].view(np.int64), out[1].view(np.int64)


def shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
    """Slices of the batches with their rows' sets and the sets' names."""
    for batch in batches:
        for b in words.slices(batch, "text"):
            *_, hashes, first = words.text_words(b.column("text"))
            sets = words.shingles(hashes, first, width)
            yield b, sets, *set_names(sets)


class Fresh:
    """The classes that a task hasn't met lately; copies within a task are merged before the shuffle."""

    def __init__(self, most: int = 1 << 18):
        self.seen: set[tuple[int, int]] = set()
        self.most = most

    def __call__(self, sets: list[np.ndarray], hi: np.ndarray, lo: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        for own, key in zip(sets, zip(hi.tolist(), lo.tolist(), strict=True), strict=True):
            if len(own) and key not in self.seen:
                if len(self.seen) >= self.most:
                    self.seen.clear()
                self.seen.add(key)
                yield own, *key


class Frequent:
    """The shingles that many of a task's classes hold, by a mergeable summary of at most ``most`` counters.

    Batches' exact counts are added up. What exceeds ``most`` counters is cut by taking the largest count that must go from all of them, so a shingle's
    counter falls short of its number by ``short`` at the most, and ``short`` is at most the task's shingles over ``most``.
    """

    def __init__(self, most: int = 1 << 18):
        self.most, self.short, self.classes = most, 0, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, sets: list[np.ndarray]) -> None:
        self.classes += len(sets)
        found, n = np.unique(np.concatenate(sets), return_counts=True)
        keys, at = np.unique(np.concatenate([self.keys, found]), return_inverse=True)
        counts = np.zeros(len(keys), np.int64)
        np.add.at(counts, at[: len(self.keys)], self.counts)
        np.add.at(counts, at[len(self.keys) :], n)
        if len(keys) > self.most:
            less = int(np.partition(counts, len(keys) - self.most - 1)[len(keys) - self.most - 1])
            self.short += less
            keys, counts = keys[counts > less], counts[counts > less] - less
        self.keys, self.counts = keys, counts

    def report(self) -> tuple[np.ndarray, np.ndarray]:
        """Shingles that are surely in one of ``2 * HOT_SHARE`` of the classes, and in four at least, with the least that they can have."""
        often = self.counts >= max(4, self.classes // (2 * HOT_SHARE))
        return self.keys[often], self.counts[often]


FACTS = "kind int, doc_id long, tag long, hi long, lo long, size long"


def facts(width: int):
    """documents -> kind 0: doc_id, tag, the class's two names, its size; kind 1: a shingle (hi) frequent in this task and its number of classes (lo)."""

    def rows(kind: int, doc_id, tag, hi, lo, size) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), kind, np.int32)), *(c if isinstance(c, pa.Array) else pa.array(c.astype(np.int64)) for c in (doc_id, tag, hi, lo, size))], ["kind", "doc_id", "tag", "hi", "lo", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, frequent, held, n = Fresh(), Frequent(), [], 0
        for b, sets, hi, lo in shingled(batches, width):
            yield rows(0, b.column("doc_id"), b.column("tag"), hi, lo, np.array([len(s) for s in sets], dtype=np.int64))
            for own, _, _ in fresh(sets, hi, lo):
                held.append(own)
                n += len(own)
            if n >= SUMMED:
                frequent.add(held)
                held, n = [], 0
        if held:
            frequent.add(held)
        keys, counts = frequent.report()
        none = np.zeros(len(keys), np.int64)
        yield rows(1, none, none, keys.view(np.int64), counts, counts)

    return run


@lru_cache(maxsize=2)
def hot_list(name: str) -> tuple[np.ndarray, np.ndarray]:
    """The hot shingles, sorted, and the place of each in the global order among them."""
    return tuple(np.memmap(SparkFiles.get(name), "<u8", mode="r", shape=(2, int(name.split("-")[1])))) if not name.startswith("none") else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def heads(ids: np.ndarray, *columns: np.ndarray) -> bytes:
    """Rows sorted by class as bytes: the number of classes, the classes, how many rows each has, then the columns."""
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    return np.array([len(at)], "<i8").tobytes() + ids[at].astype("<i8").tobytes() + np.diff(np.append(at, len(ids))).astype("<u4").tobytes() + b"".join(c.tobytes() for c in columns)


def unheaded(blob, *kinds: str) -> list[np.ndarray]:
    """The class of each row, and the columns."""
    n = int(np.frombuffer(blob, "<i8", 1)[0])
    counts = np.frombuffer(blob, "<u4", n, 8 + 8 * n)
    out, at, total = [np.repeat(np.frombuffer(blob, "<i8", n, 8), counts)], 8 + 12 * n, int(counts.sum())
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, total, at))
        at += total * np.dtype(kind).itemsize
    return out


def dealt(where: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The part numbers in a sorted array, and where each lies."""
    edges = np.searchsorted(where, np.arange(parts + 1))
    for p in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
        yield p, slice(int(edges[p]), int(edges[p + 1]))


def fragments(parts: int, width: int, hot: str, renamed: dict[tuple[int, int], int]):
    """documents -> (part, blob): classes' cold shingles by fragment of the hash range; part -1 - home: their hot ones, as places in the order."""

    def flush(sets: list[np.ndarray], ids: list[int]) -> pa.RecordBatch:
        values, rank = hot_list(hot)
        all_, owner = np.concatenate(sets), np.repeat(np.array(ids, dtype=np.int64), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(values, all_), max(len(values) - 1, 0))
        often = values[at] == all_ if len(values) else np.zeros(len(all_), bool)
        out = []
        low, own = all_[~often], owner[~often]
        part = ((low >> words.U(32)) * words.U(parts) >> words.U(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        low, own, part = low[order], own[order], part[order]
        for p, s in dealt(part, parts):
            out.append((p, heads(own[s], low[s].astype("<u8"))))
        own, place = owner[often], rank[at[often]] if len(values) else np.zeros(0, np.uint64)
        home = np.mod(own, parts)
        order = np.argsort(home, kind="stable")
        own, place, home = own[order], place[order], home[order]
        for p, s in dealt(home, parts):
            out.append((-1 - p, heads(own[s], place[s].astype("<u4"))))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, sets, ids, n = Fresh(), [], [], 0
        for _, found, hi, lo in shingled(batches, width):
            for own, a, b in fresh(found, hi, lo):
                sets.append(own)
                ids.append(renamed.get((a, b), a))
                n += len(own)
            if n >= BATCH:
                yield flush(sets, ids)
                sets, ids, n = [], [], 0
        if sets:
            yield flush(sets, ids)

    return run


def counted(parts: int):
    """One fragment's blobs -> (home, kind 1, blob) with the shingles that two or more classes hold, and how many do; hot lists pass as kind 2."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        blobs = [x for chunk in table.column("blob").chunks for x in chunk]  # views of the group's buffers
        if part < 0:
            rows = [(-1 - part, 2, b.as_py()) for b in blobs]
        else:
            rows, step = [], -(-(1 << 32) // (8 * parts))
            first = (part << 32) // parts
            for lo in range(first - step, first + (1 << 32) // parts + step, step):  # about an eighth of the fragment after another
                ids, low = [], []
                for b in blobs:
                    i, t = unheaded(b.as_buffer(), "<u8")
                    top = (t >> words.U(32)).astype(np.int64)
                    own = (top >= lo) & (top < lo + step)
                    ids.append(i[own])
                    low.append(t[own])
                ids, low = np.concatenate(ids), np.concatenate(low)
                if len(ids):
                    rows += replies(ids, low, parts)
        return pa.table({"home": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})

    return run


def replies(ids: np.ndarray, low: np.ndarray, homes: int) -> list[tuple[int, int, bytes]]:
    order = np.lexsort((ids, low))
    ids, low = ids[order], low[order]
    new = np.concatenate([[True], (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])])
    ids, low = ids[new], low[new]
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    df = np.repeat(np.diff(np.append(at, len(low))), np.diff(np.append(at, len(low))))
    ids, low, df = ids[df > 1], low[df > 1], np.minimum(df[df > 1], (1 << 32) - 1)
    home = np.mod(ids, homes)
    order = np.lexsort((ids, home))
    ids, low, df, home = ids[order], low[order], df[order], home[order]
    return [(p, 1, heads(ids[s], low[s].astype("<u8"), df[s].astype("<u4"))) for p, s in dealt(home, homes)]


def gather(threshold: int):
    """One home's replies, hot lists and class sizes -> (c, size, prefix, shared, hot): classes that may have a partner."""

    def run(table: pa.Table) -> pa.Table:
        kinds = {0: [], 1: [], 2: []}
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            kinds[kind].append(blob)
        c, size = (np.concatenate(x) for x in zip(*(np.frombuffer(b, "<i8").reshape(2, -1) for b in kinds[0]), strict=True))
        order = np.argsort(c)
        c, size = c[order], size[order]
        cold = [np.concatenate(x) for x in zip(*(unheaded(b, "<u8", "<u4") for b in kinds[1]), strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint32)]
        hot = [np.concatenate(x) for x in zip(*(unheaded(b, "<u4") for b in kinds[2]), strict=True)] or [np.zeros(0, np.int64), np.zeros(0, np.uint32)]
        order = np.lexsort((cold[1], cold[2], cold[0]))
        own, t = cold[0][order], cold[1][order]
        order = np.lexsort((hot[1], hot[0]))
        hown, place = hot[0][order], hot[1][order]
        if len(hown):  # several tasks may have sent one class
            new = np.concatenate([[True], (hown[1:] != hown[:-1]) | (place[1:] != place[:-1])])
            hown, place = hown[new], place[new]
        a, z = np.searchsorted(own, c, "left"), np.searchsorted(own, c, "right")
        p, q = np.searchsorted(hown, c, "left"), np.searchsorted(hown, c, "right")
        spare, alone = size - least_overlap(size, threshold), size - (z - a) - (q - p)
        k = np.flatnonzero(alone <= spare)
        offsets = lambda x, y: np.concatenate([[0], np.cumsum(y - x)])
        take = lambda x, y: np.arange((y - x).sum()) - np.repeat(np.cumsum(y - x) - (y - x), y - x) + np.repeat(x, y - x)
        return pa.table({
            "c": pa.array(c[k]), "size": pa.array(size[k].astype(np.int32)), "prefix": pa.array((spare + 1 - alone)[k].astype(np.int32)),
            "shared": pa.ListArray.from_arrays(pa.array(offsets(a[k], z[k]), pa.int32()), pa.array(t[take(a[k], z[k])].view(np.int64))),
            "hot": pa.ListArray.from_arrays(pa.array(offsets(p[k], q[k]), pa.int32()), pa.array(place[take(p[k], q[k])].astype(np.int32))),
        })

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each of some sorted lists shares with each of others, counted a slice of the numbers after another."""
    sizes = [np.array([len(x) for x in side], dtype=np.int64) for side in (left, right)]
    ids, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    owner = [np.repeat(np.arange(len(s)), s) for s in sizes]
    mid = int(sizes[0].sum())
    inside = [np.zeros(len(ids), bool), np.zeros(len(ids), bool)]
    inside[0][at[:mid]] = inside[1][at[mid:]] = True
    both = inside[0] & inside[1]
    place = np.cumsum(both) - 1
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    sides = []
    for own, who in ((at[:mid], owner[0]), (at[mid:], owner[1])):
        use = both[own]
        p, o = place[own[use]], who[use]
        by = np.argsort(p, kind="stable")
        sides.append((p[by], o[by]))
    for lo in range(0, int(both.sum()), FRAGMENT):
        m = []
        for (p, o), n in zip(sides, (len(left), len(right)), strict=True):
            i, j = np.searchsorted(p, [lo, lo + FRAGMENT])
            own = np.zeros((n, min(FRAGMENT, int(both.sum()) - lo)), dtype=np.float32)
            own[o[i:j], p[i:j] - lo] = 1
            m.append(own)
        out += m[0] @ m[1].T
    return out.astype(np.uint32)


TILED = "bin long, k long, b1 int, s1 int, b2 int, s2 int"


def lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    if not column.num_chunks:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    own = column.combine_chunks()
    return own.offsets.to_numpy().astype(np.int64), own.values.to_numpy().astype(np.int64)


def partial(table: pa.Table) -> pa.Table:
    """One (tile, fragment) -> a row for each cluster in it: its classes, their sizes, and their pairs' partial overlaps as a packed matrix."""
    key = [table.column(n)[0].as_py() for n in ("bin", "b1", "s1", "b2", "s2")]
    k, c, n, b, s = (table.column(x).to_numpy().astype(np.int64) for x in ("k", "c", "size", "b", "s"))
    (at, t), (hat, h) = lists(table.column("shared")), lists(table.column("hot"))
    order = np.lexsort((c, k))
    edges = np.flatnonzero(np.concatenate([[True], k[order][1:] != k[order][:-1], [True]]))
    out = []
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[lo:hi]
        x, y = (own[(b[own] == key[i]) & (s[own] == key[i + 1])] for i in (1, 3))
        if len(x) and len(y) and len(own) > 1:
            sides = [[np.concatenate([t[at[r] : at[r + 1]], h[hat[r] : hat[r + 1]]]) for r in side.tolist()] for side in (x, y)]
            head = [np.stack([c[side], n[side]]).astype("<i8").tobytes() for side in (x, y)]
            out.append((int(k[own[0]]), *head, overlaps(*sides).astype("<u4").tobytes()))
    fixed = {n: pa.array([v] * len(out), pa.int64() if n == "bin" else pa.int32()) for n, v in zip(("bin", "b1", "s1", "b2", "s2"), key, strict=True)}
    return pa.table({"bin": fixed["bin"], "k": pa.array([r[0] for r in out], pa.int64()), **{n: fixed[n] for n in ("b1", "s1", "b2", "s2")}, **{n: pa.array([r[i] for r in out], pa.binary()) for i, n in ((1, "one"), (2, "two"), (3, "matrix"))}})


def summed(threshold: int):
    """The partial matrices of a tile -> a spanning forest of its links."""

    def run(table: pa.Table) -> pa.Table:
        tiles: dict[int, list] = {}
        for k, one, two, matrix in zip(*(table.column(n).to_pylist() for n in ("k", "one", "two", "matrix")), strict=True):
            part = np.frombuffer(matrix, "<u4").astype(np.int64)
            if k in tiles:
                tiles[k][2] += part
            else:
                tiles[k] = [one, two, part]
        links: list[tuple[int, int]] = []
        for one, two, total in tiles.values():
            (c, n), (d, m) = (np.frombuffer(x, "<i8").reshape(2, -1) for x in (one, two))
            both = total.reshape(len(c), len(d))
            p, q = np.nonzero((100 * both >= threshold * (n[:, None] + m[None, :] - both)) & (c[:, None] != d[None, :]))
            links += forest_of(c[p].tolist(), d[q].tolist())
        return pa.table({"a": pa.array([e[0] for e in links], pa.int64()), "b": pa.array([e[1] for e in links], pa.int64())})

    return run


def classes_of(found: DataFrame) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(hi, lo, c, low, size, tag) of each class: ``c`` is its first name, but for the few classes whose first names are equal."""
    rows = found.where("kind = 0 and size > 0").groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("first"), F.min("size").alias("size"), F.max("size").alias("most"))
    rows = cut(rows.select("hi", "lo", "size", F.col("first.doc_id").alias("low"), F.col("first.tag").alias("tag"), "most"), "classes")
    clash = rows.groupBy("hi").agg(F.count(F.lit(1)).alias("n"), F.collect_list("lo").alias("los"), F.bool_or(F.col("most") != F.col("size")).alias("odd")).where("n > 1 or odd").select("hi", "los", "odd").collect()
    if any(r.odd for r in clash):
        raise RuntimeError("sets of different size have one 128-bit name")
    renamed = {(r.hi, lo): int(words.mix(np.array([r.hi, lo], dtype=np.int64).view(np.uint64)).sum().view(np.int64)) for r in clash for lo in r.los}
    c = F.col("hi")
    for (hi, lo), new in renamed.items():  # about n ** 2 / 2 ** 65 of n classes
        c = F.when((F.col("hi") == hi) & (F.col("lo") == lo), F.lit(new)).otherwise(c)
    return rows.withColumn("c", c), renamed


def hot_shingles(found: DataFrame, least: int) -> str:
    """Publishes the shingles that at least ``least`` classes were reported to hold; at most shingles / least. Returns the file's name."""
    got = found.where("kind = 1").groupBy("hi").agg(F.sum("lo").alias("n")).where(F.col("n") >= least).toArrow()
    if not len(got):
        return "none-0"
    values, n = got.column("hi").to_numpy().view(np.uint64), got.column("n").to_numpy()
    rank = np.empty(len(values), np.uint64)
    rank[np.lexsort((values, n))] = np.arange(len(values), dtype=np.uint64)
    order = np.argsort(values)
    data = np.stack([values[order], rank[order]]).astype("<u8").tobytes()
    name = f"hot-{len(values)}-{hashlib.sha256(data).hexdigest()[:24]}"
    publish(found.sparkSession, name, data)
    return name


def candidates(kept: DataFrame, threshold: int) -> DataFrame:
    """Ties (a, b) between classes that connect all that may link."""
    width = math.log(100 / threshold) * (1 + 1e-9) if threshold < 100 else 1e-9
    t = F.concat(
        F.transform(F.slice("shared", F.lit(1), F.col("prefix")), lambda x: F.struct(F.lit(False).alias("hot"), x.alias("t"))),
        F.transform(F.slice("hot", F.lit(1), F.greatest(F.col("prefix") - F.size("shared"), F.lit(0))), lambda x: F.struct(F.lit(True).alias("hot"), x.cast("long").alias("t"))),
    )
    rows = kept.select("c", F.floor(F.log("size") / width).cast("long").alias("range"), F.explode(t).alias("t")).select("c", "range", "t.hot", "t.t")
    least = cut(rows.groupBy("hot", "t", "range").agg(F.min("c").alias("m"), F.count(F.lit(1)).alias("n")), "least")
    star = rows.join(least.where("n > 1").select("hot", "t", "range", "m"), ["hot", "t", "range"]).where("c <> m").select(F.col("c").alias("a"), F.col("m").alias("b"))
    above = least.select("hot", "t", (F.col("range") - 1).alias("range"), F.col("m").alias("b"))
    return star.unionByName(least.join(above, ["hot", "t", "range"]).select(F.col("m").alias("a"), "b").where("a <> b"))


def spread(rows: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Joins the one row that ``facts`` has for each key to many ``rows``; a key's rows are dealt over ``SALTS`` tasks by their class."""
    salted = facts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.xxhash64(F.lit(3), "c"), F.lit(SALTS)).cast("int")).join(salted, [*keys, "__salt"]).drop("__salt")


def tiles(kept: DataFrame, clusters: DataFrame, threshold: int, bins: int) -> DataFrame:
    """Rows of ``partial``'s groups: each class of a cluster, in each tile and fragment that it takes part in."""
    width = math.log(100 / threshold) * (1 + 1e-9) if threshold < 100 else 1e-9
    rows = kept.join(clusters, "c").select("k", "c", "size", "shared", "hot", (F.size("shared") + F.size("hot")).alias("tokens"))
    whole = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum")).select("k", ((F.col("n") <= TILE) & (F.col("sum") <= TOKENS)).alias("small"))
    range_ = F.floor(F.log("size") / width).cast("int")
    rows = spread(rows, whole, ["k"]).withColumn("b", F.when(F.col("small"), 0).otherwise(range_))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("tokens") / TOKENS)).cast("int")
    sizes = rows.groupBy("k", "small", "b").agg(parts.alias("parts"), F.sum("tokens").alias("sum"))
    along = Window.partitionBy("k").orderBy("b")  # as many rows as a cluster has size ranges
    near = lambda f: F.when((F.abs(f("b").over(along) - F.col("b")) == 1) & ~F.col("small"), f("parts").over(along)).otherwise(0)
    pieces = F.ceil(F.max(F.col("sum") / F.col("parts")).over(Window.partitionBy("k")) / SEGMENT).cast("int")
    sizes = sizes.select("k", "b", "parts", near(F.lead).alias("above"), near(F.lag).alias("below"), F.greatest(pieces, F.lit(1)).alias("pieces"))
    rows = spread(rows, sizes, ["k", "b"]).withColumn("s", F.pmod(F.xxhash64("c"), F.col("parts")).cast("int"))

    def to(n: str, make):
        return F.when(F.col(n) > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), make)).otherwise(F.array().cast("array<struct<b1:int,s1:int,b2:int,s2:int>>"))

    place = lambda b1, s1, b2, s2: F.struct(b1.cast("int").alias("b1"), s1.cast("int").alias("s1"), b2.cast("int").alias("b2"), s2.cast("int").alias("s2"))
    b, s = F.col("b"), F.col("s")
    where = F.concat(to("parts", lambda x: place(b, F.least(s, x), b, F.greatest(s, x))), to("above", lambda x: place(b, s, b + 1, x)), to("below", lambda x: place(b - 1, x, b, s)))
    rows = rows.withColumn("where", F.explode(where)).withColumn("f", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    mine = lambda x: F.pmod(x, F.col("pieces")) == F.col("f")
    # small clusters share a group; each tile of a large one is its own
    bin_ = F.when(F.col("small"), F.pmod(F.xxhash64("k"), F.lit(bins))).otherwise(F.col("k"))
    return rows.select(bin_.alias("bin"), "where.*", "f", "k", "c", "size", "b", "s", F.filter("shared", mine).alias("shared"), F.transform(F.filter("hot", mine), lambda x: x.cast("long")).alias("hot"))


def groups(docs: DataFrame, threshold: int = 80, width: int = 5, hot_least: int = HOT_LEAST, entries: int = ENTRIES) -> DataFrame:
    """doc_id, tag, n_shingles, component_id and first_tag (the tag of the component's first row) of every row of ``docs(doc_id, text)``.

    ``tag`` tells rows of one id with different texts apart: a 64-bit hash of the text.
    """
    rows = docs.select(docs["doc_id"], docs["text"], F.xxhash64(docs["text"]).alias("tag"))
    found = cut(rows.mapInArrow(words.tidy(facts(width)), FACTS), "facts")
    total, n = found.where("kind = 0").agg(F.sum("size"), F.count(F.lit(1))).first()
    classes, renamed = classes_of(found)
    hot = hot_shingles(found, max(hot_least, n // HOT_SHARE))
    parts = max(1, -(-(total or 0) // entries))
    blobs = rows.select("text").mapInArrow(words.tidy(fragments(parts, width, hot, renamed)), "part int, blob binary")
    schema = "home int, kind int, blob binary"
    first = cut(blobs.groupBy("part").applyInArrow(words.tidy_group(counted(parts)), schema), "fragments")

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c, size = (b.column(k).to_numpy().astype(np.int64) for k in ("c", "size"))
            home = np.mod(c, parts)
            order = np.argsort(home, kind="stable")
            out = [(p, np.stack([c[order[s]], size[order[s]]]).astype("<i8").tobytes()) for p, s in dealt(home[order], parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([0] * len(out), pa.int32()), pa.array([r[1] for r in out], pa.binary())], ["home", "kind", "blob"])

    homebound = first.unionByName(classes.select("c", "size").mapInArrow(sized, schema))
    kept = cut(homebound.groupBy("home").applyInArrow(words.tidy_group(gather(threshold)), "c long, size int, prefix int, shared array<long>, hot array<int>"), "kept")
    drop(first)
    clusters = cut(components(candidates(kept, threshold)).select(F.col("id").alias("c"), F.col("comp").alias("k")), "clusters")
    tiled = tiles(kept, clusters, threshold, 4 * parts)
    matrices = tiled.groupBy("bin", "b1", "s1", "b2", "s2", "f").applyInArrow(words.tidy_group(partial), TILED + ", one binary, two binary, matrix binary")
    links = cut(matrices.groupBy("bin", "b1", "s1", "b2", "s2").applyInArrow(words.tidy_group(summed(threshold)), "a long, b long"), "links")
    comp = components(links)
    named = classes.select("hi", "lo", "c", "low", "tag").join(comp.withColumnRenamed("id", "c"), "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    least = named.groupBy("comp").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "tag")).alias("first"))
    named = cut(named.join(least, "comp").select(F.col("hi").alias("__hi"), F.col("lo").alias("__lo"), F.col("first.low").alias("component_id"), F.col("first.tag").alias("first_tag")), "named")
    for done in (kept, clusters, links):
        drop(done)
    docs_ = found.where("kind = 0")
    full = docs_.where("size > 0").join(named, (F.col("hi") == F.col("__hi")) & (F.col("lo") == F.col("__lo")))
    bare = docs_.where("size = 0").select("doc_id", "tag", F.col("size").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("tag").alias("first_tag"))
    return full.select("doc_id", "tag", F.col("size").alias("n_shingles"), "component_id", "first_tag").unionByName(bare)


def jaccard_components(docs: DataFrame, threshold: int = 80, width: int = 5, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text)``."""
    return groups(docs, threshold, width, **options).select("doc_id", "n_shingles", "component_id")


def first_rows(docs: DataFrame, threshold: int = 80, width: int = 5, **options) -> DataFrame:
    """The rows of ``docs``, whole, that come first in their component (by doc_id, then by tag) or hold no word; rows that repeat such a one stay with it."""
    found = groups(docs, threshold, width, **options)
    later = found.where("n_shingles > 0 and not (doc_id <=> component_id and tag = first_tag)").select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag")).distinct()
    same = docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__tag"))
    return docs.join(later, same, "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n_shingles FROM s),
g AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n i ON i.doc_id = a JOIN n j ON j.doc_id = b WHERE 100 * shared >= 80 * (i.n_shingles + j.n_shingles - shared)),
d AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS id, doc_id AS root FROM n UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.id)
SELECT n.doc_id, n.n_shingles, c.component_id FROM n JOIN (SELECT id, min(root) AS component_id FROM r GROUP BY 1) c ON c.id = n.doc_id
"""
