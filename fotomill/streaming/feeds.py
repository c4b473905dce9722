"""Streaming forms of re-indexing and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fotomill.session import cut_lineage


def new_items(spark: SparkSession, path: str, schema: StructType, key: str, at: str, late: str = "7 days") -> DataFrame:
    """A stream of Parquet rows in which a key comes out once among the rows that arrive within `late` of one another by their time `at`.

    The state holds the keys of that time alone. What is delivered again later meets the table of known items in append_unknown().
    """
    rows = spark.readStream.schema(schema).parquet(path).withColumn("__at", F.col(at).cast("timestamp"))
    return rows.withWatermark("__at", late).dropDuplicatesWithinWatermark([key]).drop("__at")


def append_unknown(known_path: str, key: str):
    """A foreachBatch sink that appends the rows whose key the Parquet table at known_path does not have yet, as re-indexing a source adds only unknown
    records. The table is the state; a batch that is run again after a failure adds nothing twice."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        known = spark.read.schema(batch.schema).parquet(known_path).select(key)
        cut_lineage(batch.dropDuplicates([key]).join(known, key, "left_anti")).write.mode("append").parquet(known_path)

    return write


def live_sessions(events: DataFrame, user: str, at: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """(user, session_start, session_end, event_count) of finished sessions of a stream; rows later than `late` are dropped.

    session_end is the last event's time. Unlike the batch operator, a finished session is not reopened.
    """
    rows = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return (
        rows.groupBy(F.col(user).alias("user"), F.session_window("__at", gap).alias("w"))
        .agg(F.min("__at").alias("session_start"), F.max("__at").alias("session_end"), F.count("*").alias("event_count"))
        .drop("w")
    )
