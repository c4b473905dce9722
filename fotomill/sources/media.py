"""Files of a library as a DataFrame, by Spark's own file source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotomill.functions.text import MEDIA_EXTENSIONS, extension, mime_of


def media_files(spark: SparkSession, path: str, content: bool = False) -> DataFrame:
    """(path, filename, size, modified, mime_type[, content]) of the supported media files below a folder.

    Contents are read only if asked for; sort by path where order matters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.filter(extension(name).isin(MEDIA_EXTENSIONS)).select(
        "path", name.alias("filename"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), mime_of(name).alias("mime_type"),
        *(["content"] if content else []),
    )


def listed_between(listing: DataFrame, created: str, start: str, end: str) -> DataFrame:
    """Rows created from midnight of `start` to midnight of `end` (both YYYY-MM-DD, UTC, inclusive)."""
    at = F.to_timestamp_ntz(F.col(created), F.lit("yyyy-MM-dd HH:mm:ss"))
    return listing.filter(at.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def write_library(items: DataFrame, path: str) -> None:
    """Item metadata as Parquet, one folder a year and event."""
    items.write.mode("overwrite").partitionBy("event_year", "folder_name").parquet(path)
