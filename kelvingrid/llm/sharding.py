"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of each source are shuffled by a seeded hash and ranked; a row's place is (rank + u) / rows of its
source, with a seeded offset u in [0, 1) for each source, so that single-row sources spread as well. All
rows are ordered by place and the order is cut in equal parts: every shard has each source in proportion,
and the shards' row counts differ by one at most (law ``rows``). Both rankings are bucketed prefix sums
(``common.ranked``), so neither a hot source nor the whole table goes to one task.

The buckets grow in number with the rows. A null source is a source of its own. Null text has size 1 (0 bytes plus 1) and the checksum
of no bytes; null ids are ordered by text. Repeated ids are separate rows; rows that repeat an id and a text share a bucket.
An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import leading, only, ranked


def _hex(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def interleave(docs: DataFrame, shards: int = 16, seed: str = "0") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law is ``rows``) of every row."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = only(docs, "doc_id", "source", "text").select(
        "doc_id", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.crc32(text).cast("string"))).alias("key"),
    )
    order = [F.col(c) for c in ("key", "doc_id", "text_crc32", "size")]
    n = docs.count()
    rows = ranked(rows, ["source"], order, leading(F.col("key"), n), "rank", "of")
    offset = _hex(F.concat_ws("|", F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))), 8) / F.lit(float(1 << 32))
    rows = rows.withColumn("place", (F.col("rank") + offset) / F.col("of"))
    buckets = max(4096, n >> 14)
    bucket = F.least(F.floor(F.col("place") * buckets), F.lit(buckets - 1)).cast("int")
    rows = ranked(rows, [], [F.col("place"), *order], bucket, "at", "all")
    shard = F.expr(f"int(at * {shards} div all)")
    first = F.expr(f"(shard * all + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("at") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
