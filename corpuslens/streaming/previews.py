"""Previews of files as they arrive; the same narrow plan as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuslens.limits import DEFAULTS, Limits
from corpuslens.plans.preview import Extractors, oversize_previews, preview_corpus
from corpuslens.sources.files import readable_files

_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def stream_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """New files below ``path`` as a stream of ``(path, modificationTime, length, content)``."""
    reader = (
        spark.readStream.format("binaryFile").schema(_SCHEMA).option("recursiveFileLookup", "true")
    )
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def preview_stream(
    files: DataFrame, limits: Limits = DEFAULTS, extractors: Extractors | None = None
) -> DataFrame:
    """Preview rows of a stream of files, error rows for files too large for one value included.
    Archives and comics are drawn like any other file, in their row."""
    rows = readable_files(files).select(
        F.col("path").alias("id"),
        "path",
        F.lit(False).alias("is_dir"),
        F.col("length").alias("size"),
        "content",
    )
    return preview_corpus(rows, limits, extractors).unionByName(oversize_previews(files, extractors))


def write_preview_stream(
    previews: DataFrame, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Append preview rows as parquet, one directory per kind, exactly once per file."""
    writer = (
        previews.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("kind")
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
