"""Bounded samples of labelled rows, to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only

#: What a sample's texts may hold together: it bounds the features that come to the driver.
MOST_BYTES = 32 << 20
#: A text of more than this part of them isn't taken, so that no single one decides how many others are.
SHARE = 8


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, where: Column | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, text, label, draw) of at most ``rows`` labelled documents, those with the smallest hash of their id, with at most ``most_bytes`` of text.

    Texts of more than an eighth of ``most_bytes`` are left out, and so is, in the order of the hash, each text that doesn't fit any more; the others stay. ``draw`` in [0, 1)
    splits the sample. Labels that are null don't count; of several labels of one id the largest does, of several texts of one id the
    smallest. The ids, ``rows`` at the most, are sent to every executor: the documents are scanned once, in place, and the texts found are written.
    """
    ids = only(labels, "doc_id", label).where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if where is not None:
        ids = ids.where(where)
    rank = F.xxhash64(F.lit(11), "doc_id")
    ids = ids.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(rank, "doc_id").limit(rows)
    ids = ids.select(F.col("doc_id").alias("__id"), "label", rank.alias("rank"))
    draw = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1000)) / 1000
    texts = only(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.octet_length("text") <= most_bytes // SHARE)
    found = texts.join(F.broadcast(ids), F.col("doc_id") == F.col("__id")).groupBy("doc_id", "label", "rank").agg(F.min("text").alias("text"))
    found = cut(found.select("doc_id", "text", "label", draw.alias("draw"), "rank"), "sample")
    fits, left = [], most_bytes
    for r in found.select("doc_id", F.octet_length("text").alias("size")).orderBy("rank", "doc_id").collect():  # ``rows`` at the most
        if r["size"] <= left:
            left -= r["size"]
            fits.append((r["doc_id"],))
    chosen = docs.sparkSession.createDataFrame(fits, f"__id {docs.schema['doc_id'].dataType.simpleString()}")
    return found.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select("doc_id", "text", "label", "draw")
