"""Files as a stream: what is new since the last run, and partitioned output that takes each row once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def stream_path(path: str, files: list[str]) -> str:
    """A file stream takes folders and patterns: one file is given as a pattern that fits it alone."""
    name = path.rstrip("/").rpartition("/")[2]
    return f"{path[:-1]}[{path[-1]}]" if len(files) == 1 and files[0].endswith(f"/{name}") else path


def arriving(spark: SparkSession, path: str, files_per_batch: int, oldest_file: str) -> DataFrame:
    """The Parquet files of a growing folder, or one file, as a stream with the schema they have now.

    ``oldest_file``: files older than this before the newest one are never taken, so it is to be long where files may come late.
    """
    there = spark.read.parquet(path)
    reader = spark.readStream.schema(there.schema).option("maxFilesPerTrigger", files_per_batch).option("maxFileAge", oldest_file)
    return reader.parquet(stream_path(path, there.inputFiles()))


def drain(rows: DataFrame, path: str, checkpoint: str, *partitions: str) -> None:
    """Appends all that has arrived to partitioned Parquet files and returns when there is no more. The checkpoint and the sink's own
    log make a rerun, also after a crash, add nothing twice."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partitions)
    writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
