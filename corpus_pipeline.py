"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Every stage works on all rows that the one before has kept. The models of the first two stages are fitted on bounded
samples of the labelled documents of ``sf_dir``. A stage judges each row by its text; an id that several rows share, or that is
null, doesn't tie them together: of a group of copies one row stays, whichever id the others have. Of rows that are equal in id and text one stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kelvingrid.llm import exact_dedup, jaccard_join, packing, quality, rowfilter, toxicity
from kelvingrid.llm.common import cut, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of a grade of 1 or more is 1/2 at least."""
    model = quality.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rowfilter.keep(docs, lambda text: model.kept(text, 1))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity is under 1/2."""
    model = toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), where=toxicity.fold() != 0)
    return rowfilter.keep(docs, lambda text: model.scores(text) < 0.5)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest id."""
    return exact_dedup.distinct_rows(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more the document with the smallest id."""
    return jaccard_join.first_rows(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of all documents that remain, with their texts."""
    return packing.pack(docs, carry=tuple(c for c in docs.columns if c != "doc_id"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("exact dedup", exact_copies),
    ("n-gram jaccard join", near_copies),
    ("packing", packed),
]

#: The classifiers can't be expressed in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
