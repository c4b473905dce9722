"""Problem 6: activity split into sessions by gaps of inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, user: str, micros: str, gap_seconds: int, record_id: str | None = None) -> DataFrame:
    """(user, session_no, start_micros, end_micros, duration_seconds, event_count) of each user's sessions.

    micros: the event's time in microseconds (BIGINT). An event more than gap_seconds after the one before it
    starts a session. Rows with a null user or time belong to no session. With record_id, rows equal in user, record and
    time count once; without it every row counts. Ties in time fall into one session. Extra columns don't matter.

    Scale: events are first put into slots as long as the gap. Those of one slot always share a session,
    so a slot is one row (first, last, count) made by partial aggregation, and a user's window sees at most one
    row per slot of the time covered (22 000 for 15 years of 6-hour slots), however many events the user has.
    Lag over the slots flags the gaps, the running sum of flags numbers the sessions.
    """
    gap = gap_seconds * 1_000_000
    rows = events.select(
        F.col(user).alias("user"), F.col(micros).cast("bigint").alias("at"), *([F.col(record_id).alias("record")] if record_id else [])
    ).filter("user IS NOT NULL AND at IS NOT NULL")
    if record_id:
        rows = rows.dropDuplicates(["user", "at", "record"])
    slots = rows.groupBy("user", ((F.col("at") - F.pmod("at", F.lit(gap))) / gap).cast("bigint").alias("slot")).agg(
        F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n")
    )
    w = Window.partitionBy("user").orderBy("first_at")
    starts = F.coalesce((F.col("first_at") - F.lag("last_at").over(w) > gap).cast("int"), F.lit(1))
    numbered = slots.withColumn("starts", starts).withColumn("session_no", F.sum("starts").over(w))
    return (
        numbered.groupBy("user", "session_no")
        .agg(F.min("first_at").alias("start_micros"), F.max("last_at").alias("end_micros"), F.sum("n").alias("event_count"))
        .withColumn("duration_seconds", (F.col("end_micros") - F.col("start_micros")) / 1_000_000)
    )
