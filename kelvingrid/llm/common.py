"""Shared helpers: table access, lineage cuts in the shared folder, distributed ranks and components."""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from functools import reduce
from operator import and_
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kelvingrid.plans.shared import discard as drop
from kelvingrid.plans.shared import folder
from kelvingrid.plans.shared import materialise as cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables; read by Spark only, so any file system will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, wherever they are."""
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(f.relative_to(top.parent))), f.read_bytes())
    publish(spark, f"{top.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip", data.getvalue(), code=True)


def publish(spark: SparkSession, name: str, data: bytes, code: bool = False) -> None:
    """Give every executor a local copy of ``data`` as the Spark file ``name``; it starts in the shared folder."""
    if name in {f.rsplit("/", 1)[-1] for f in spark.sparkContext.listFiles}:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
    out.write(bytearray(data))
    out.close()
    (spark.sparkContext.addPyFile if code else spark.sparkContext.addFile)(path.toString())


def partitions(spark: SparkSession) -> int:
    """How many parts a shuffle of this session has; callers size their own groups by it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; others, whatever they are called, never meet an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def leading(key: Column, rows: int) -> Column:
    """The first hexadecimal digits of a key as a number: a bucket for ``ranked`` for every 16,384 rows or so, 4,096 at least."""
    digits = 3
    while 16**digits << 14 < rows and digits < 7:
        digits += 1
    return F.conv(F.substring(key, 1, digits), 16, 10).cast("int")


def ranked(df: DataFrame, group: list[str], order: list[Column], bucket: Column, rank: str, total: str) -> DataFrame:
    """Exact 0-based ``rank`` of each row within ``group`` by ``order``, and the group's ``total``, without one task per group.

    ``bucket`` must be a non-negative int that never falls along ``order``. Rows are numbered within
    (group, bucket); a prefix sum over the counts of the buckets, of which a group has a bounded
    number, adds what lies below. A group of any size is thus spread over its buckets.
    """
    rows = df.withColumn("__bucket", bucket)
    keys = [*group, "__bucket"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    below = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("__n").over(below), F.lit(0)).alias("__start"), F.sum("__n").over(whole).alias(total))
    inner = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)])
    return inner.join(starts, same).select(*df.columns, (F.col("__start") + F.col("__rn") - 1).alias(rank), total)


def dealt_join(left: DataFrame, right: DataFrame, key: str, chunk: int = 1024) -> DataFrame:
    """``left`` (a written table), with the columns of ``right``, whose keys are unique, where it has the row's key.

    Keys of more than ``chunk`` rows, and of more than a thousandth of all, are dealt out: their rows by number over as many parts as they have
    chunks, and their row of ``right`` to each part. There are a thousand such keys at the most, so every task gets their list.
    """
    bound = max(chunk, left.count() // 1000)
    heavy = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > bound).select(key, F.ceil(F.col("__n") / chunk).cast("int").alias("__parts"))
    heavy = cut(heavy, "heavy")
    dealt = left.withColumn("__row", F.monotonically_increasing_id()).join(F.broadcast(heavy), key, "left")
    dealt = dealt.withColumn("__part", F.coalesce(F.pmod(F.col("__row") + F.shiftright("__row", 33), F.col("__parts")).cast("int"), F.lit(0))).drop("__row", "__parts")
    copies = right.join(F.broadcast(heavy), key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return dealt.join(copies, [key, "__part"], "left").drop("__part")


EDGES = 1 << 20


def forest_of(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A forest of stars of some edges: each id but the smallest of its component, linked to that smallest."""
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while (up := root.setdefault(k, k)) != k:
            root[k] = root.setdefault(up, up)
            k = up
        return k

    for x, y in zip(a, b, strict=True):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(k, r) for k in root if (r := find(k)) != k]


def forest(batches: Iterator[pa.RecordBatch], most: int = EDGES) -> Iterator[pa.RecordBatch]:
    """One task's edges (a, b) as forests of stars, each of ``most`` edges or so, so that a task's memory is bounded."""
    a: list[int] = []
    b: list[int] = []

    def stars() -> pa.RecordBatch:
        rows = forest_of(a, b)
        a.clear()
        b.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        a += batch.column("a").to_pylist()
        b += batch.column("b").to_pylist()
        if len(a) >= 2 * most:
            yield stars()
    yield stars()


def components(edges: DataFrame, max_rounds: int = 60, most: int = EDGES) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long ids): rows (id, comp) with the smallest id reachable.

    Each round contracts the edges of every task, ``most`` at the most, to a forest of stars by union-find; once one task holds
    all edges that is the answer. While there are more, a large-star and a small-star round over the cluster follow, each round
    written to the shared folder. The smallest neighbour is found by a combining aggregate and joined back, so a hub with very many
    neighbours is neither gathered in one list nor bound to one task.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        j = both.join(least, "a")
        if small:
            # a > b always: link every smaller neighbour, and a itself, to the smallest one
            out = j.select(F.col("b").alias("u"), "m").unionByName(least.select(F.col("a").alias("u"), "m"))
        else:
            out = j.where(F.col("b") > F.col("a")).select(F.col("b").alias("u"), "m")
        return out.where(F.col("u") != F.col("m")).select(F.col("u").alias("a"), F.col("m").alias("b")).distinct()

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(forest, "a long, b long"), "components")
    seen = None
    for _ in range(max_rounds):
        n, *rest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        parts = max(1, -(-n // most))
        if parts == 1:
            nxt = cut(now.coalesce(1).mapInArrow(forest, "a long, b long"), "components")
            drop(now)
            now = nxt
            break
        before, seen = seen, (n, *rest)
        if before == seen:
            break
        stars = cut(now.repartition(parts).mapInArrow(forest, "a long, b long"), "components")
        nxt = cut(star(star(stars, small=False), small=True), "components")
        for done in (now, stars):
            drop(done)
        now = nxt
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct()
    return now.select(F.col("a").alias("id"), F.col("b").alias("comp")).unionByName(roots)
