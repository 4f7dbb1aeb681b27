"""Lineage cuts for driver-steered loops: tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """This application's own folder under ``spark.checkpoint.dir``; it goes when the application ends.

    Where the setting is unset, a local session, whose executors share the driver's disk, gets a temporary folder; a cluster gets an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    known, _, own = spark.conf.get("spark.kelvingrid.folder", "").partition(" ")
    if own and known == (base or "none"):
        return own
    key = base or "none"
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="kelvingrid-")
    own = f"{base.rstrip('/')}/kelvingrid-{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(own)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    spark.conf.set("spark.kelvingrid.folder", f"{key} {own}")
    return own


def materialise(df: DataFrame, label: str = "rounds", **options: str) -> DataFrame:
    """Write the rows once as Parquet and read them back, so that later rounds don't repeat earlier ones.

    It cuts the lineage as ``checkpoint()`` does, but computes the rows once, and a lost executor costs nothing: the files are in the shared folder.
    """
    path = f"{folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the table behind a ``materialise`` that nothing reads any more."""
    spark = df.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """Partitions for steps that make far more of their rows than they read: four times the session's, 400 at the most unless the session has more."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(own, min(4 * own, 400))


def dealt(df: DataFrame, *keys: str, parts: int | None = None) -> DataFrame:
    """Rows dealt by their keys over a number of tasks that adaptive execution leaves as it is; it would merge partitions by the bytes that a step reads."""
    return df.repartition(parts or tasks(df.sparkSession), *keys)


def parts(spark: SparkSession, rows: float, each: int) -> int:
    """Partitions for a step that makes about ``rows`` rows: ``tasks``, and more where that leaves them over ``each`` rows, so that a task's memory doesn't grow with the tables."""
    return max(tasks(spark), min(int(-(-rows // each)), 20_000))


def shares(table: DataFrame, rows: int = 40_000) -> int:
    """Partitions for steps that sort a table several times: no more than ``rows`` rows in one. The count of a Parquet table reads its footers only."""
    return parts(table.sparkSession, table.count(), rows)


def sorted_join(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that sends neither side to all tasks: of tables that come from few bytes, exploded or compressed, Spark expects far fewer rows than there are, and
    a broadcast of them passes through the driver."""
    return left.join(right.hint("merge"), on, how)
