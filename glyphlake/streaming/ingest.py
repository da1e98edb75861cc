"""Files that arrive in a folder, validated as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from glyphlake.operators import rules, structure


def watch(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """A streaming DataFrame of new files."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    s = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder)
    return s.select(F.xxhash64("path").alias("file_id"), "path", "length", "content")


def validated(stream: DataFrame) -> DataFrame:
    """(file_id, path, code, issues) of every new file."""
    v = rules.validate(structure.index_files(stream))
    return v.select("file_id", "path", rules.exit_code().alias("code"), F.size("report").alias("n_issues"))


def store(stream: DataFrame, target: str, checkpoint: str):
    """Append to a Parquet table whatever has arrived, then stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
