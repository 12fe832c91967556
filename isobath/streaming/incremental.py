"""New region files as they arrive: the file stream's micro-batches go through the same scan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import anvil

_FILES = "path string, modificationTime timestamp, length long, content binary"


def stream_columns(spark: SparkSession, folder: str, caves: bool = True, min_y: int | None = None) -> DataFrame:
    """A streaming table of the water columns of region files that appear in a folder; chunks in side files are joined as they lie there at that time."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.mca").load(folder)
    return anvil.decoded_columns(anvil.chunks_of(files, folder), caves, min_y)


def run_batches(columns: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to handle, once, and stop when no file is left."""
    return columns.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
