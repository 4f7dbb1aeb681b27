"""A Merkle manifest of a dataset in an external-memory node store: one tree a group of rows, and one over the groups' subroots.

* Leaves, hashed where the texts lie, are written as narrow rows, sorted into *runs* by (group, id, leaf) and numbered: a run's rows by their
  place, the runs of a group by a prefix sum over their sizes. So a group of any size is spread over as many runs as it needs.
* Level 0 of the store holds the leaves by coordinate (tree, pos). Each further level is a folder of Parquet that is made by one sequential read of the
  level before it: ``fanout`` consecutive nodes, fewer in a tree's last run, become the hash of their digests. A node keeps the digests of
  its children, so that a level can be read without the one below it.
* ``proofs`` goes down from the roots and merges each level with the one above it by coordinate. Every node takes over its parent's path and puts
  its own siblings before it; the trees' roots start with their path in the tree of subroots.

H is lowercase hexadecimal SHA-256 of the inputs put together. A field counts as ``-`` if null, else as its UTF-8 length, ``:`` and its value. Digests enter as
hexadecimal text. Groups are ordered null first, then bytewise; a null id comes first in its group; rows that share an id are ordered by
leaf, and rows equal in all fields are leaves of their own. Null text is not empty text. Texts are hashed whole. Other columns are ignored.
An empty table has no levels, no root (null) and no proofs.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, drop, folder, only

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<left:string,right:string>>"
NODES = "tree string, pos long, width long, digest binary, kids array<binary>"


def encoded(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(*values: Column) -> Column:
    """A row's leaf, as hexadecimal text."""
    return F.sha2(F.concat(*[encoded(v) for v in values]), 256)


def text_of(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(steps, leaf, lambda acc, s: F.sha2(F.concat(s["left"], acc, s["right"]), 256))


def siblings(steps: Column) -> Column:
    """All digests of a proof, from the leaf's run to the root, left to right, put together."""
    return F.concat_ws("", F.transform(steps, lambda s: F.concat(s["left"], s["right"])))


class Levels:
    """The levels of one or many trees: Parquet folders ``level=k`` with (tree, pos, width, digest, kids), pos counted from 0 and width the tree's nodes on that level."""

    def __init__(self, rows: DataFrame, order: list[str], fanout: int, label: str):
        """``rows``: (tree, digest) and the columns of ``order``; others are carried on level 0."""
        self.spark, self.fanout = rows.sparkSession, fanout
        self.path = f"{folder(self.spark)}/{label}-{uuid.uuid4().hex}"
        self.depth = self.write_leaves(rows, order, label)
        for k in range(1, self.depth):
            self.write_level(k)

    def write_leaves(self, rows: DataFrame, order: list[str], label: str) -> int:
        """Level 0; how many levels there will be."""
        # equal rows may be a third of the table: the row's number, written down, lets them spread over runs
        rows = cut(rows.withColumn("__row", F.monotonically_increasing_id()), label + "-rows")
        keys = ["tree", *order, "__row"]
        runs = cut(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()).drop("__row"), label + "-runs")
        run = F.shiftright("__at", 33)
        sizes = runs.groupBy("tree", run.alias("__run")).agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first"))
        tree = Window.partitionBy("tree")
        before = F.coalesce(F.sum("n").over(tree.orderBy("__run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        starts = cut(sizes.select("tree", "__run", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("width")), label + "-starts")
        placed = runs.withColumn("__run", run).join(starts, ["tree", "__run"])
        own = [c for c in rows.columns if c not in ("tree", "digest", "__row")]
        placed = placed.select("tree", (F.col("__at") + F.col("shift")).alias("pos"), "width", "digest", F.lit(None).cast("array<binary>").alias("kids"), *own)
        self.leaves = placed.schema
        placed.sortWithinPartitions("tree", "pos").write.parquet(f"{self.path}/level=0")
        most = starts.agg(F.max("width")).first()[0] or 0
        for done in (rows, runs, starts):
            drop(done)
        depth = 1 if most else 0
        while most > 1:
            most, depth = -(-most // self.fanout), depth + 1
        return depth

    def write_level(self, k: int) -> None:
        parts = self.level(k - 1).where("width > 1").groupBy("tree", F.expr(f"pos div {self.fanout}").alias("pos"))
        nodes = parts.agg(F.expr(f"(max(width) + {self.fanout - 1}) div {self.fanout}").alias("width"), F.sort_array(F.collect_list(F.struct("pos", "digest")))["digest"].alias("kids"))
        digest = F.unhex(F.sha2(F.concat_ws("", F.transform("kids", text_of)), 256))
        nodes.select("tree", "pos", "width", digest.alias("digest"), "kids").sortWithinPartitions("tree", "pos").write.parquet(f"{self.path}/level={k}")

    def level(self, k: int) -> DataFrame:
        return self.spark.read.schema(NODES if k else self.leaves).parquet(f"{self.path}/level={k}")

    def tops(self) -> DataFrame:
        """(tree, pos, level, digest, kids): the root of each tree."""
        own = [self.level(k).where("width = 1").select("tree", "pos", F.lit(k).alias("level"), "digest", "kids") for k in range(self.depth)]
        return reduce(DataFrame.unionByName, own)

    def paths(self, crown: DataFrame, given: dict[str, str], level: int = 0) -> DataFrame:
        """The nodes of a level with their siblings up to their tree's root, then what ``crown`` says of that: its steps and the columns of ``given``.

        ``crown``: a row of ``tops`` with ``steps`` and ``given`` for each tree that is asked for; nodes of other trees are left out.
        """
        above = None
        for k in range(self.depth - 1, level - 1, -1):
            also = ["kids"] if k > level else [c for c in self.level(k).columns if c not in ("tree", "pos", "width")]
            roots = crown.where(F.col("level") == k).select("tree", "pos", "steps", *given)
            nodes = self.level(k)
            here = nodes.where("width = 1").join(roots, ["tree", "pos"]).select("tree", "pos", "steps", *given, *also)
            if above is not None:
                up = above.select("tree", F.col("pos").alias("__up"), F.col("kids").alias("__run"), "steps", *given)
                at = F.pmod("pos", F.lit(self.fanout)).cast("int")
                left = F.concat_ws("", F.transform(F.slice("__run", F.lit(1), at), text_of))
                right = F.concat_ws("", F.transform(F.slice("__run", at + 2, F.lit(self.fanout)), text_of))
                below = nodes.where("width > 1").withColumn("__up", F.expr(f"pos div {self.fanout}")).join(up, ["tree", "__up"])
                steps = F.concat(F.array(F.struct(left.alias("left"), right.alias("right"))), F.col("steps"))
                here = here.unionByName(below.select("tree", "pos", steps.alias("steps"), *given, *also))
            above = here
        return above

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Manifest:
    """The tree of each group's leaves (``trees``), the tree of their roots (``top``) and the ``root`` of all, as hexadecimal text."""

    def __init__(self, docs: DataFrame, group: str = "source", key: str = "doc_id", fields: tuple[str, ...] = FIELDS, fanout: int = 3, carry: Mapping[str, Column] | None = None):
        """``carry``: further columns of a row, by name, that ``proofs`` is to return; narrow ones, as they are kept with the leaves."""
        rows = only(docs, *dict.fromkeys((*fields, group, key)))
        # "" for null, "=" before all others: sorts as null first, then bytewise
        tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
        self.carried = list(carry or {})
        leaves = rows.select(tree.alias("tree"), F.col(key).alias("__key"), F.unhex(leaf_of(*[F.col(f) for f in fields])).alias("digest"), *[c.alias(f"__{n}") for n, c in (carry or {}).items()])
        self.key = key
        self.trees = Levels(leaves, ["__key", "digest"], fanout, "merkle")
        self.top, self.crown, self.root = None, None, None
        if self.trees.depth:
            tops = cut(self.trees.tops(), "merkle-subroots")
            self.top = Levels(tops.select(F.lit("").alias("tree"), F.col("tree").alias("group"), "digest"), ["group"], fanout, "merkle-top")
            highest = self.top.tops().withColumn("steps", F.array().cast(STEP))
            self.root = bytes(highest.first()["digest"]).hex()
            above = self.top.paths(highest, {}).select(F.col("group").alias("tree"), "steps")
            self.crown = cut(tops.join(above, "tree").withColumn("subroot", text_of(F.col("digest"))), "merkle-crown")
            drop(tops)

    def subroots(self) -> DataFrame:
        """(tree, subroot, steps) of every group, the steps from its subroot to the root."""
        return self.crown.select("tree", "subroot", "steps")

    def proofs(self, trees: list[str] | None = None) -> DataFrame:
        """(key, pos, leaf, subroot, steps, carried columns) of every leaf, or of those of a few trees only."""
        crown = self.crown if trees is None else self.crown.where(F.col("tree").isin(trees))
        rows = self.trees.paths(crown, {"subroot": "string"})
        return rows.select(F.col("__key").alias(self.key), "pos", text_of(F.col("digest")).alias("leaf"), "subroot", "steps", *[F.col(f"__{n}").alias(n) for n in self.carried])


def chosen(key: Column) -> Column:
    """Rows whose text is tampered with: those whose id's checksum is even; none without id."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 2 == 0, F.lit(False))


def audit(docs: DataFrame, fanout: int = 3) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and what a row folds to whose text lost its line feeds (``chosen`` rows) or kept them."""
    spark: SparkSession = docs.sparkSession
    text = F.col("text")
    bare = leaf_of(*[F.replace(text, F.lit("\n"), F.lit("")) if f == "text" else F.col(f) for f in FIELDS])
    claimed = F.when(chosen(F.col("doc_id")) & F.contains(text, F.lit("\n")), F.unhex(bare))  # null: as built
    out = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean".format(docs.schema["doc_id"].dataType.simpleString())
    manifest = Manifest(docs, fanout=fanout, carry={"claimed": claimed})
    if manifest.root is None:
        return spark.createDataFrame([], out)
    rows = manifest.proofs()
    leaf = F.coalesce(text_of(F.col("claimed")), F.col("leaf"))
    rows = rows.select("doc_id", "leaf", "subroot", F.lit(manifest.root).alias("root"), F.sha2(siblings(F.col("steps")), 256).alias("proof_sha256"), folded(leaf, F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, text, [ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')] AS codes,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head, replace(text, chr(10), '') AS bare
  FROM documents
), c AS (
  SELECT *, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf, sha256(head || coalesce(strlen(bare) || ':' || bare, '-')) AS bare_leaf,
    list_reduce(list_prepend(4294967295::BIGINT, codes::BIGINT[]), lambda s, b: list_reduce([xor(s, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda v, e: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)) AS crc
  FROM d
), l AS (
  SELECT doc_id, source, leaf, CASE WHEN xor(crc, 4294967295) % 2 = 0 THEN bare_leaf ELSE leaf END AS claimed,
    row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS width, row_number() OVER () AS id
  FROM c WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)
), t AS (
  SELECT 0 AS k, source, pos, width, leaf AS digest FROM l
  UNION ALL
  SELECT k + 1, source, pos // 3, (max(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM t WHERE width > 1 GROUP BY k, source, pos // 3
), subroots AS (
  SELECT source, k AS height, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS width FROM t WHERE width = 1
), u AS (
  SELECT 0 AS k, pos, width, digest FROM subroots
  UNION ALL
  SELECT k + 1, pos // 3, (max(width) + 2) // 3, sha256(string_agg(digest, '' ORDER BY pos)) FROM u WHERE width > 1 GROUP BY k, pos // 3
), nodes AS (
  SELECT source, false AS above, k, pos, pos // 3 AS run, digest FROM t WHERE width > 1
  UNION ALL
  SELECT NULL, true, k, pos, pos // 3, digest FROM u WHERE width > 1
), places AS (
  SELECT id, k AS step, l.source, false AS above, k, l.pos // CAST(power(3, k) AS BIGINT) AS pos FROM l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, generate_series(0, s.height - 1) g(k)
  UNION ALL
  SELECT id, s.height + k, NULL, true, k, s.pos // CAST(power(3, k) AS BIGINT) FROM l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source, generate_series(0, (SELECT max(k) FROM u) - 1) g(k)
), steps AS (
  SELECT id, step, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos < p.pos), '') AS lefts, coalesce(string_agg(n.digest, '' ORDER BY n.pos) FILTER (n.pos > p.pos), '') AS rights
  FROM places p JOIN nodes n ON p.above = n.above AND p.k = n.k AND p.pos // 3 = n.run AND p.source IS NOT DISTINCT FROM n.source GROUP BY id, step
), f AS (
  SELECT id, 0 AS step, claimed AS digest FROM l
  UNION ALL
  SELECT f.id, f.step + 1, sha256(lefts || digest || rights) FROM f JOIN steps s ON f.id = s.id AND f.step = s.step
), last AS (SELECT id, max_by(digest, step) AS folded_root FROM f GROUP BY id),
proofs AS (SELECT id, string_agg(lefts || rights, '' ORDER BY step) AS proof FROM steps GROUP BY id),
root AS (SELECT digest FROM u WHERE width = 1)
SELECT doc_id, leaf, s.digest AS subroot, r.digest AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = r.digest AS verified
FROM l JOIN subroots s ON l.source IS NOT DISTINCT FROM s.source CROSS JOIN root r JOIN last USING (id) LEFT JOIN proofs USING (id)
"""
