"""Exact deduplication through a log-structured merge index of digests, with DataFrame functions only.

* A memtable is what one task reads, up to ``memtable_rows`` rows. It flushes a *run* (level 0): a Parquet file of
  (digest, doc_id) sorted by digest, with a Bloom filter and min/max statistics on the digest.
* Compaction merges ``fan_in`` neighbouring runs into a *segment* (level 1), and the segments into one level (2): for each digest
  the smallest id and the number of rows. Each merge keeps the smallest identifier.
* The digests that level 2 holds more than once go into a *filter* (``sieve``), sized by their number, of at most ``bits`` bits. All rows probe it. A row that
  misses is alone, and no more is read of it; the text of a row that passes is a *hit*. Hits are joined with level 2, and their texts compared with
  their keeper's, byte for byte. A keeper with many hits is dealt out in copies, ``chunk`` hits to each, by the hits' places in the scan and not by their ids,
  so that no group of copies meets in one task. Hits that fail (a digest collision) are grouped by digest and text instead.

Null text counts as empty; empty texts are equal to each other. Repeated rows are counted row by row, and are all kept or all dropped
(``distinct_rows`` leaves one of them). A row without an id is a copy of any row that has one; a group without any id has no ``keep_id``, and
its rows are kept. Texts of any length are taken whole. An empty table gives an empty result. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, only
from .sieve import Sieve

BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class MergeIndex:
    """The index over one table: ``runs`` (level 0), ``segments`` (level 1), ``level`` (level 2: digest, keep_id, n) and the ``filter`` of what repeats."""

    def __init__(self, docs: DataFrame, digest: Callable[[Column], Column] = sha256, memtable_rows: int = 1 << 16, chunk: int = 1024, fan_in: int = 8, bits: int = 1 << 28):
        self.digest, self.memtable_rows, self.chunk, self.fan_in, self.bits = digest, memtable_rows, chunk, fan_in, bits
        self.docs = docs
        self.runs = self.flush()
        self.segments, self.level = self.compact()
        self.filter = Sieve(self.level.where("n > 1").select("digest"), "digest", most=max(1, bits // 512))

    def texts(self, *carried: Column) -> DataFrame:
        rows = self.docs.select(self.docs["doc_id"], normalised(self.docs["text"]).alias("text"), *carried)
        return rows.withColumn("digest", self.digest(F.col("text")))

    def filtered(self, rows: DataFrame, label: str) -> DataFrame:
        """Write some rows sorted by digest, with a Bloom filter on it."""
        options = {"maxRecordsPerFile": str(self.memtable_rows), "parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(self.memtable_rows), "parquet.bloom.filter.adaptive.enabled": "true"}
        return cut(rows.sortWithinPartitions("digest"), label, **options)

    def flush(self) -> DataFrame:
        """Level 0: sorted runs, each with its filter."""
        return self.filtered(self.texts().select("digest", "doc_id"), "runs")

    def compact(self) -> tuple[DataFrame, DataFrame]:
        """Levels 1 and 2; the smallest identifier of each digest stays."""
        parts = self.runs.withColumn("segment", F.floor(F.spark_partition_id() / self.fan_in))
        segments = parts.groupBy("segment", "digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        segments = self.filtered(segments.select("digest", "keep_id", "n"), "segments")
        return segments, self.filtered(segments.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")), "level")

    def probed(self, rows: DataFrame) -> DataFrame:
        """Adds ``hit``: whether the row's digest passes the filter. The filter's size is bounded, so every task gets it."""
        return self.filter.probed(rows)

    def lookup(self, digests: list[bytes]) -> DataFrame:
        """Rows of a few digests straight from the runs; filters and statistics skip runs that lack them."""
        return self.runs.where(F.col("digest").isin([bytearray(d) for d in digests])).groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))

    def verified(self, hits: DataFrame) -> DataFrame:
        """Hits (doc_id, digest, text, ...) with keep_id, n, and ``same``: their text is the keeper's, byte for byte."""
        parts = F.ceil(F.col("n") / self.chunk).cast("int")
        many = self.level.where("n > 1")
        # at most rows / bound digests are that frequent: a thousand
        bound = max(self.chunk, self.runs.count() // 1000)
        frequent = many.where(F.col("n") > bound).select("digest", parts.alias("__parts"))
        row = F.monotonically_increasing_id()  # tasks number their rows apart: all copies of a text may share an id, or have none
        hits = hits.withColumn("__row", row + F.shiftright(row, 33)).join(F.broadcast(frequent), "digest", "left").withColumn("part", F.coalesce(F.pmod(F.col("__row"), F.col("__parts")).cast("int"), F.lit(0))).drop("__parts", "__row")
        dealt = F.when(F.col("n") > bound, parts).otherwise(1)
        keys = many.select("digest", "keep_id", "n", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"))
        found = hits.join(keys, ["digest", "part"], "left")
        keepers = found.where("n is not null and doc_id <=> keep_id").groupBy("digest").agg(F.min("text").alias("kept_text"), F.max("n").alias("n"))
        keepers = keepers.select("digest", "kept_text", F.explode(F.sequence(F.lit(0), dealt - 1)).alias("part"))
        found = found.join(keepers, ["digest", "part"], "left")
        return found.withColumn("same", F.coalesce(F.col("text") == F.col("kept_text"), F.lit(True))).withColumn("keep_id", F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))).withColumn("n", F.coalesce("n", F.lit(1)))

    def settled(self, found: DataFrame) -> DataFrame:
        """Verified hits, with keeper and number set right where digests collided; ``text`` is needed where ``same`` is false."""
        odd = found.where("not same")
        if odd.isEmpty():
            return found
        odd = odd.drop("keep_id", "n")
        again = odd.groupBy("digest", "text").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
        less = odd.groupBy("digest").agg(F.count(F.lit(1)).alias("less"))
        right = found.where("same").join(less, "digest", "left").withColumn("n", F.col("n") - F.coalesce("less", F.lit(0))).drop("less")
        return right.unionByName(odd.join(again, ["digest", "text"]))

    def assign(self) -> DataFrame:
        """For every row: doc_id, digest, keep_id, group_size, kept."""
        alone = self.probed(self.runs).where("not hit").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"))
        hits = self.probed(self.texts()).where("hit").select("doc_id", "digest", "text")
        found = cut(self.verified(hits).select("doc_id", "digest", "keep_id", "n", "same", F.when(~F.col("same"), F.col("text")).alias("text")), "found")
        out = alone.unionByName(self.settled(found).select("doc_id", "digest", "keep_id", "n"))
        return out.select("doc_id", "digest", "keep_id", F.col("n").alias("group_size"), kept().alias("kept"))

    def clear(self) -> None:
        """Delete what only the build needs."""  # the filter and level 2 are read by the result
        drop(self.segments)


def kept() -> Column:
    return F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of ``docs(doc_id, text)``."""
    index = MergeIndex(only(docs, "doc_id", "text"), **options)
    rows = index.assign()
    index.clear()
    return rows.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_rows(docs: DataFrame, **options) -> DataFrame:
    """One whole row of ``docs`` for each text: the one with the smallest doc_id; of rows that repeat id and text, one."""
    index = MergeIndex(docs, **options)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    alone = index.probed(index.texts(row)).where("not hit").select("row.*")
    hits = index.probed(index.texts(row)).where("hit").select("doc_id", "digest", "text", "row")
    found = index.verified(hits).where(~F.col("same") | kept()).select("doc_id", "digest", "keep_id", "n", "same", F.when(~F.col("same"), F.col("text")).alias("text"), "row")
    found = index.settled(cut(found, "found")).where(kept())
    index.clear()
    return alone.unionByName(found.dropDuplicates(["digest", "text"]).select("row.*"))


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
