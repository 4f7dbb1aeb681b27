"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors with cosine >= c lie within squared distance 2 - 2c. They are rotated (a seeded random orthogonal
matrix, which keeps distances) and split into blocks of equal low dimension. Squared distances of blocks add up,
so of two linked vectors at least one block is within its proportional share of the budget: pigeonhole. Each
block is range-joined by itself; a candidate pair is verified exactly on the whole vectors in double precision, and
counts in the first block that has it in range, so the union over blocks holds it once.

The range join walks a grid of all axes of the block, with cells two radii wide, axis by axis: a vector goes on only into
those cells that other vectors are in and that its ball, less the distance used up by the axes before, reaches. So only pairs are
compared whose cell and ball meet on every axis. A label of at most ``whole`` vectors is one cell for all its blocks; a larger one is dealt by
a coarse grid over the first axes of each block, as many axes as its size needs: a vector is at home in one coarse cell
and a guest in those later ones that its ball reaches, so that each pair within range meets in one. A cell with more than ``tile`` vectors is
dealt out in tiles by pairs of parts, so no cell is one task's. Tasks return the links' number of each
vector and a spanning forest of the links they found, never pairs as rows.

Vectors compare only when labels are equal and not null. Identical vectors of a label are one representative with a
count. Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, not even with
their copies; vectors of different length don't link. Rows that repeat an id are vectors of their own; a null id never names a
component, and ``kept`` is false for it unless its component has no id at all. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import components, cut, drop, only

SLACK = 1e-9
PAIRS = 1 << 17


def unit_rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector as float64; None where it links with nothing."""
    out: list[np.ndarray | None] = []
    for v in column:
        x = v.values.to_numpy(zero_copy_only=False).astype(np.float64) if v.is_valid else np.zeros(0)
        out.append(x if len(x) and np.isfinite(x).all() and x.any() else None)
    return out


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def bounds(dim: int, blocks: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def shares(dim: int, budget: float, blocks: int) -> list[float]:
    """Each block's part of the squared-distance budget."""
    return [budget * (hi - lo) / dim + SLACK for lo, hi in bounds(dim, blocks)]


def normalised(x: np.ndarray) -> np.ndarray:
    """Rows as unit vectors."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def identities(kind: str, vectors: bool):
    """(vec_id, label, embedding) -> vec_id and key, a digest of label and vector (null if it can't link), and what a representative needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, data = [], []
            for label, x in zip(b.column("label").to_pylist(), unit_rows(b.column("embedding")), strict=True):
                ok = label is not None and x is not None
                data.append((x + 0.0).astype(kind).tobytes() if ok else None)
                keys.append(hashlib.sha256(f"{label}|".encode() + data[-1]).digest() if ok else None)
            out = {"vec_id": b.column("vec_id"), "key": pa.array(keys, pa.binary())}
            if vectors:
                out |= {"label": b.column("label").cast(pa.int64()), "vector": pa.array(data, pa.binary())}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return run


def placed(budget: float, blocks: int, seed: int, kind: str):
    """Representatives with the number of axes of their label -> a row for each cell where they are at home or guests; block -1: all blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            axes, dim = (b.column(k).to_numpy() for k in ("axes", "dim"))
            raw = b.column("vector").to_pylist()
            for d in np.unique(dim).tolist():
                turn = rotation(d, seed)
                for a in np.unique(axes[dim == d]).tolist():
                    own = np.flatnonzero((dim == d) & (axes == a))
                    if not a:
                        got = [(own, np.full(len(own), -1), np.full(len(own), ""), np.ones(len(own), bool))]
                    else:
                        y = normalised(np.stack([np.frombuffer(raw[k], kind).astype(np.float64) for k in own.tolist()])) @ turn
                        got = []
                        for k, ((lo, hi), share) in enumerate(zip(bounds(d, blocks), shares(d, budget, blocks), strict=True)):
                            z, r = y[:, lo : min(hi, lo + a)], np.sqrt(share) + SLACK
                            home = np.floor(z / (2 * r)).astype(np.int64)
                            row, cell, acc = np.arange(len(own)), np.zeros((len(own), 0), np.int64), np.zeros(len(own))
                            for j in range(z.shape[1]):
                                parts = []
                                for step in (-1, 0, 1):
                                    c = home[row, j] + step
                                    gap = np.maximum(0, np.maximum(c * 2 * r - z[row, j], z[row, j] - (c + 1) * 2 * r))
                                    fit = acc + gap**2 <= r * r
                                    parts.append((row[fit], np.column_stack([cell[fit], c[fit]]), (acc + gap**2)[fit]))
                                row, cell, acc = (np.concatenate(p) for p in zip(*parts, strict=True))
                            other = cell != home[row]
                            at = other.argmax(axis=1)
                            later = cell[np.arange(len(row)), at] >= home[row, at]
                            row, cell, other = row[later], cell[later], other[later]
                            got.append((own[row], np.full(len(row), k), np.array([",".join(map(str, c)) for c in cell.tolist()], dtype=str), ~other.any(axis=1)))
                    for rows, block, cell, home in got:
                        taken = b.take(pa.array(rows))
                        yield pa.RecordBatch.from_arrays([*[taken.column(c) for c in ("rep", "n", "label", "dim", "vector")], pa.array(block, pa.int32()), pa.array(cell.tolist(), pa.string()), pa.array(home)], ["rep", "n", "label", "dim", "vector", "block", "cell", "home"])

    return run


def meetings(x: np.ndarray, y: np.ndarray, share: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row of ``x``, row of ``y``) whose grid cell and ball meet on every axis: all pairs within ``share`` are among them."""
    if not len(x) or not len(y):
        return
    r = np.sqrt(share) + SLACK
    w = 2 * r
    base = np.floor(min(x.min(), y.min()) / w).astype(np.int64) - 1
    home = np.floor(y / w).astype(np.int64) - base
    wide = int(max(home.max(), np.floor(x.max() / w) - base)) + 3
    # the cells that hold rows of y, one level of a tree for each axis
    node, levels = np.zeros(len(y), np.int64), []
    for j in range(y.shape[1]):
        keys, node = np.unique(node * wide + home[:, j], return_inverse=True)
        levels.append(keys)
    order = np.argsort(node, kind="stable")
    begin = np.searchsorted(node[order], np.arange(len(levels[-1]) + 1))
    row, at, acc = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for j, keys in enumerate(levels):
        here = np.floor(x[row, j] / w).astype(np.int64)
        parts = []
        for step in (-1, 0, 1):
            c = here + step
            gap = np.maximum(0, np.maximum(c * w - x[row, j], x[row, j] - (c + 1) * w))
            want = at * wide + c - base
            found = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            fit = (acc + gap**2 <= r * r) & (keys[found] == want)
            parts.append((row[fit], found[fit], (acc + gap**2)[fit]))
        row, at, acc = (np.concatenate(p) for p in zip(*parts, strict=True))
    count = begin[at + 1] - begin[at]
    upto = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(row):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + PAIRS, "right")) - 1)
        n = count[a:b]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(row[a:b], n), order[np.repeat(begin[at[a:b]], n) + inner]
        a = b


def joined(cosine: float, budget: float, blocks: int, seed: int, kind: str):
    """One tile of one cell -> links' numbers (kind 0: rep, links), a spanning forest (kind 1: a, b) and the pairs compared (kind 2)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, left, right = (table.column(k)[0].as_py() for k in ("block", "left", "right"))
        home, part, rep, n = (table.column(k).to_numpy(zero_copy_only=False) for k in ("home", "part", "rep", "n"))
        x = normalised(np.stack([np.frombuffer(v, kind).astype(np.float64) for v in table.column("vector").to_pylist()]))
        dim = x.shape[1]
        y = x @ rotation(dim, seed)
        cuts, share = bounds(dim, blocks), shares(dim, budget, blocks)
        links, root = np.zeros(len(rep), dtype=np.int64), np.arange(len(rep))
        forest: list[tuple[int, int]] = []
        compared = 0

        def find(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = int(root[k])
            return k

        ones, others = np.flatnonzero(part == left), np.flatnonzero(part == right)
        for k in range(len(cuts)) if block < 0 else (block,):
            lo, hi = cuts[k]
            for f, g in meetings(y[ones, lo:hi], y[others, lo:hi], share[k]):
                f, g = ones[f], others[g]
                use = home[f] | home[g]
                if left == right:
                    use &= f < g
                f, g = f[use], g[use]
                compared += len(f)
                d = (y[f] - y[g]) ** 2
                first = np.ones(len(f), dtype=bool)
                for s, (u, v) in enumerate(cuts[: k + 1]):
                    inside = d[:, u:v].sum(axis=1) <= share[s]
                    first &= inside if s == k else ~inside
                f, g = f[first], g[first]
                same = np.einsum("ij,ij->i", x[f], x[g]) >= cosine
                f, g = f[same], g[same]
                np.add.at(links, f, n[g])
                np.add.at(links, g, n[f])
                for s, t in zip(f.tolist(), g.tolist(), strict=True):
                    s_, t_ = find(s), find(t)
                    if s_ != t_:
                        root[max(s_, t_)] = min(s_, t_)
                        forest.append((int(rep[s]), int(rep[t])))
        some = np.flatnonzero(links)
        kinds = [0] * len(some) + [1] * len(forest) + [2]
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array([*rep[some].tolist(), *(e[0] for e in forest), compared], pa.int64()), "b": pa.array([*links[some].tolist(), *(e[1] for e in forest), 0], pa.int64())})

    return run


def native(vectors: DataFrame) -> str:
    """How components are stored: as they come, in single or in double precision."""
    kind = vectors.schema["embedding"].dataType
    return "<f4" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "<f8"


def representatives(vectors: DataFrame) -> DataFrame:
    """rep, key, low, n, label, dim and vector of the distinct vectors that can link; written, so that ``rep`` stays."""
    kind = native(vectors)
    rows = only(vectors, "vec_id", "embedding", "label").mapInArrow(identities(kind, True), "vec_id long, key binary, label long, vector binary").where("key is not null")
    found = rows.groupBy("key").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    return cut(found.select(F.monotonically_increasing_id().alias("rep"), "*", (F.octet_length("vector") / int(kind[2])).cast("int").alias("dim")), "reps")


def tiles(reps: DataFrame, kind: str, cosine: float, blocks: int, tile: int, seed: int, whole: int) -> DataFrame:
    """What the tiles find: rows (kind, a, b) of ``joined``."""
    budget = 2 - 2 * cosine
    axes = F.when(F.col("size") <= whole, 0).otherwise(F.least(F.ceil(F.log2(F.col("size") / whole) / 2) + 1, F.lit(4))).cast("int")
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("size")).select("label", "dim", axes.alias("axes"))
    cells = reps.join(sizes, ["label", "dim"]).select("rep", "n", "label", "dim", "vector", "axes")
    cells = cells.mapInArrow(placed(budget, blocks, seed, kind), "rep long, n long, label long, dim int, vector binary, block int, cell string, home boolean")
    where = ["label", "dim", "block", "cell"]
    # parts of a cell, and the tiles (pairs of parts) that a row takes part in
    parts = cells.groupBy(*where).agg(F.count(F.lit(1)).alias("size"), F.count_if("home").alias("homes")).where("size > 1 and homes > 0").select(*where, F.ceil(F.col("size") / tile).cast("int").alias("parts"))
    dealt = cells.join(parts, where).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("left", F.least("part", "other")).withColumn("right", F.greatest("part", "other"))
    dealt = dealt.select(*where, "left", "right", "part", "home", "rep", "n", "vector")
    return cut(dealt.groupBy(*where, "left", "right").applyInArrow(joined(cosine, budget, blocks, seed, kind), "kind int, a long, b long"), "found")


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, blocks: int = 8, tile: int = 2048, seed: int = 7, whole: int = 1 << 15) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors(vec_id, embedding, label)``."""
    kind = native(vectors)
    reps = representatives(vectors)
    found = tiles(reps, kind, cosine, blocks, tile, seed, whole)
    links = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("more"))
    comp = components(found.where("kind = 1").select("a", "b"))
    facts = reps.select("key", "rep", "low", "n").join(links, "rep", "left").join(comp.withColumnRenamed("id", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    facts = facts.join(facts.groupBy("comp").agg(F.min("low").alias("component_id")), "comp")
    facts = cut(facts.select(F.col("key").alias("__key"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id"), "facts")
    for done in (found, reps):
        drop(done)
    rows = only(vectors, "vec_id", "embedding", "label").mapInArrow(identities(kind, False), "vec_id long, key binary")
    out = rows.join(facts, F.col("key") == F.col("__key"), "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
e AS (SELECT i.vec_id AS a, j.vec_id AS b FROM v i JOIN v j ON i.label = j.label AND i.vec_id <> j.vec_id AND len(i.x) = len(j.x) WHERE list_cosine_similarity(i.x, j.x) >= 0.98),
r AS (SELECT vec_id AS id, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id),
c AS (SELECT id, min(root) AS component_id FROM r GROUP BY 1)
SELECT id AS vec_id, (SELECT count(*) FROM e WHERE e.a = id) AS n_links, component_id, id = component_id AS kept FROM c
"""
