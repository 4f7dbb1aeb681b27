"""Streaming intake: scenario files that drop into a folder are ingested as they come, and the outcome of each is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kelvingrid.engine import Engine
from kelvingrid.sources.geojson import InputError


def intake(engine: Engine, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Watch ``folder`` for GeoJSON files. Rows (path, scenario, error) go to the store's ``intake`` table.

    Only paths and sizes travel with the stream; a file's rows are read by the batch ingest. The checkpoint makes a file count once.
    """
    spark = engine.spark

    def each(batch: DataFrame, _: int) -> None:
        done = []
        for r in batch.select("path").toLocalIterator():  # a micro-batch of file names, bounded by maxFilesPerTrigger
            try:
                done.append((r.path, engine.ingest(r.path, r.path.rsplit("/", 1)[-1]), None))
            except InputError as e:
                done.append((r.path, None, str(e)))
        if done:
            spark.createDataFrame(done, "path string, scenario string, error string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{engine.store}/intake")

    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.geojson").option("maxFilesPerTrigger", 16).schema("path string, modificationTime timestamp, length long, content binary").load(folder).drop("content")
    writer = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
