"""Folders that grow: a file stream whose batches are written under their own numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files as S
from .scratch import saved

_BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest(spark: SparkSession, folder: str, sink: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], extractor: S.Extractor, glob: str = "*.pdf", fallback: S.Extractor | None = None, files_a_batch: int = 1000):
    """Extracts the files that ``folder`` has gained since the last run and writes what ``plan`` makes of them.

    ``sink/chunks/batch=n`` holds the chunks of batch n, ``sink/failed/batch=n`` the files that could not be read (path,
    filename, _error). The checkpoint fixes which files a batch has before it runs, and a batch that was cut off is
    written anew in place, so however often a run is killed each chunk is there once. Returns the finished query.
    """
    stream = spark.readStream.format("binaryFile").schema(_BINARY).option("pathGlobFilter", glob).option("maxFilesPerTrigger", files_a_batch).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        found = saved(S.extracted(batch, extractor, fallback), "ingested")
        plan(found).write.mode("overwrite").parquet(f"{sink}/chunks/batch={number}")
        found.filter("_error is not null").select("path", "filename", "_error").write.mode("overwrite").parquet(f"{sink}/failed/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
