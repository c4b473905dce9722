"""Queries of the general problems 2, 3 and 6 over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotomill.functions.timestamps import utc_text
from fotomill.operators.references import Reference, orphan_counts, orphan_references
from fotomill.operators.sessions import sessions
from fotomill.operators.timestamps import capture_times, created_times, estimated_times
from fotomill.session import table

#: An item more than this many seconds after the one before it starts a shooting session.
SESSION_GAP_SECONDS = 21_600


def _references(spark: SparkSession, d: str) -> list[Reference]:
    media, groups, log = (table(spark, d, t) for t in ("media_items", "event_groups", "audit_log"))
    return [
        Reference("media_items", media, "id", "event_group_id", "updated_at", "event_groups", groups, "id", "created_at"),
        Reference("audit_log", log, "id", "media_item_id", "logged_at", "media_items", media, "id", "created_at"),
    ]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d))


def p2_counts(spark: SparkSession, d: str) -> DataFrame:
    return orphan_counts(_references(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    media, metadata, estimates, devices = (
        table(spark, d, t) for t in ("media_items", "metadata_info", "date_estimate", "devices")
    )
    fields = {
        "media_items.date_taken": capture_times(media, devices),
        "metadata_info.create_date": created_times(metadata, media, devices),
        "date_estimate.ai_date": estimated_times(estimates, media, devices),
    }
    return reduce(
        DataFrame.unionByName,
        [df.select(F.lit(k).alias("field_name"), "record_id", utc_text(F.col("utc_micros")).alias("utc_time")) for k, df in fields.items()],
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    media, devices = table(spark, d, "media_items"), table(spark, d, "devices")
    taken = capture_times(media, devices, {"source_device": F.col("source_device")}).filter("has_time")
    found = sessions(taken, "source_device", "utc_micros", SESSION_GAP_SECONDS, "record_id")
    return found.select(
        F.col("user").alias("source_device"),
        utc_text(F.col("start_micros")).alias("session_start"),
        utc_text(F.col("end_micros")).alias("session_end"),
        F.col("event_count").alias("item_count"),
    )


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p6_found)}

_P2 = """
WITH refs AS (
  SELECT DISTINCT 'media_items' AS table_name, m.id AS record_id, m.event_group_id AS missing_key, g.id AS parent,
         g.created_at > m.updated_at AS late, substr(m.updated_at, 1, 7) AS period
  FROM media_items m LEFT JOIN event_groups g ON g.id = m.event_group_id WHERE m.event_group_id IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'audit_log', a.id, a.media_item_id, m.id, m.created_at > a.logged_at, substr(a.logged_at, 1, 7)
  FROM audit_log a LEFT JOIN media_items m ON m.id = a.media_item_id WHERE a.media_item_id IS NOT NULL)
, found AS (
  SELECT table_name, record_id, missing_key, CASE WHEN parent IS NULL THEN 'missing' ELSE 'late' END AS orphan_kind, period
  FROM refs WHERE parent IS NULL OR late)
"""

_ZONE = r"[zZ]|UTC|GMT|utc|gmt|[+-]\d{2}:?\d{2}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+"
_CLOCK = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
_REST = rf"(?:,? {_CLOCK}(?: ?([AaPp][Mm]))? ?({_ZONE})?)?$"
_OFFSET = "(epoch_us(timezone(by_zone, ({0}) AT TIME ZONE 'UTC')) - epoch_us({0}))"
# Every written time as UTC. A local time takes the offset of the day before, unless that does not hold at it and the offset of the day after does.
_TIMES = rf"""
WITH item AS (SELECT id, min(source_device) AS dev FROM media_items WHERE source_device IS NOT NULL GROUP BY 1)
, device AS (SELECT device_id, min(time_zone) AS zone, min(date_order) AS date_order FROM devices GROUP BY 1)
, said AS (
  SELECT 'media_items.date_taken' AS field_name, id AS record_id, source_device AS dev, date_taken AS v, coalesce(lower(trim(date_taken_source)) = 'fixture', false) AS as_utc FROM media_items
  UNION ALL SELECT 'metadata_info.create_date', record_id, dev, v, as_utc FROM (SELECT DISTINCT record_id, media_item_id, create_date AS v, coalesce(lower(trim(mime_type)) LIKE 'video/%', false) AS as_utc FROM metadata_info) LEFT JOIN item ON id = media_item_id
  UNION ALL SELECT 'date_estimate.ai_date', estimate_id, dev, v, false FROM (SELECT DISTINCT estimate_id, media_item_id, ai_date AS v FROM date_estimate) LEFT JOIN item ON id = media_item_id)
, trimmed AS (SELECT said.*, zone, coalesce(upper(date_order) = 'MDY', false) AS mdy, trim(v, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM said LEFT JOIN device ON device_id = dev WHERE v IS NOT NULL)
, read AS (SELECT *, regexp_extract(t, '^(\d{{4}})(?:-(\d{{2}})-(\d{{2}})|:(\d{{2}}):(\d{{2}}))(?:[ T](\d{{2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d+))?)? ?({_ZONE})?)?$', ['y','m','d','m2','d2','h','mi','s','f','z']) AS i,
  regexp_extract(t, '^(\d{{4}})(\d{{2}})(\d{{2}})(?:[_T ]?(\d{{2}})(\d{{2}})(\d{{2}}) ?({_ZONE})?)?$', ['y','m','d','h','mi','s','z']) AS c,
  regexp_extract(t, '^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}}){_REST}', ['a','b','y','h','mi','s','f','half','z']) AS l,
  regexp_extract(t, '^(?:[A-Za-z]{{3}}, )?(\d{{1,2}}) (?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[a-z]* (\d{{4}}){_REST}', ['d','m','y','h','mi','s','f','half','z']) AS w FROM trimmed)
, parts AS (SELECT field_name, record_id, dev, as_utc, zone, t, CASE
  WHEN i.y <> '' THEN {{'y': i.y, 'm': i.m || i.m2, 'd': i.d || i.d2, 'h': i.h, 'mi': i.mi, 's': i.s, 'f': i.f, 'half': '', 'z': i.z}}
  WHEN c.y <> '' THEN {{'y': c.y, 'm': c.m, 'd': c.d, 'h': c.h, 'mi': c.mi, 's': c.s, 'f': '', 'half': '', 'z': c.z}}
  WHEN l.y <> '' THEN {{'y': l.y, 'm': CASE WHEN mdy THEN l.a ELSE l.b END, 'd': CASE WHEN mdy THEN l.b ELSE l.a END, 'h': l.h, 'mi': l.mi, 's': l.s, 'f': l.f, 'half': lower(l.half), 'z': l.z}}
  WHEN w.y <> '' THEN {{'y': w.y, 'm': ((strpos('janfebmaraprmayjunjulaugsepoctnovdec', lower(w.m)) + 2) // 3)::VARCHAR, 'd': w.d, 'h': w.h, 'mi': w.mi, 's': w.s, 'f': w.f, 'half': lower(w.half), 'z': w.z}} END AS p FROM read)
, timed AS (SELECT field_name, record_id, dev, t, p.z AS own, p.h <> '' AS timed,
  CASE WHEN p.h = '' THEN 12 WHEN p.half = '' THEN try_cast(p.h AS INT) WHEN try_cast(p.h AS INT) BETWEEN 1 AND 12 THEN try_cast(p.h AS INT) % 12 + CASE WHEN p.half = 'pm' THEN 12 ELSE 0 END ELSE 99 END AS h,
  coalesce(try_cast(p.mi AS INT), 0) AS mi, coalesce(try_cast(p.s AS INT), 0) AS s, coalesce(try_cast(rpad(p.f[1:6], 6, '0') AS INT), 0) AS f,
  try_cast(p.y || '-' || lpad(p.m, 2, '0') || '-' || lpad(p.d, 2, '0') AS DATE) AS day,
  CASE WHEN p.z = '' THEN CASE WHEN NOT as_utc AND zone IN (SELECT name FROM pg_timezone_names()) THEN zone ELSE 'UTC' END WHEN lower(p.z) IN ('z', 'utc', 'gmt') THEN 'UTC' WHEN p.z IN (SELECT name FROM pg_timezone_names()) THEN p.z END AS by_zone FROM parts)
, local AS (SELECT *, CASE WHEN h <= 23 AND mi <= 59 AND s <= 59 THEN day::TIMESTAMP + to_microseconds(((h * 60 + mi) * 60 + s)::BIGINT * 1000000 + f) END AS ts FROM timed)
, moved AS (SELECT *, {_OFFSET.format("ts - INTERVAL 1 DAY")} AS o1, {_OFFSET.format("ts + INTERVAL 1 DAY")} AS o2 FROM local)
, both_ways AS (SELECT *, ts - to_microseconds(o1) AS u1, ts - to_microseconds(o2) AS u2 FROM moved)
, times AS (SELECT field_name, record_id, dev, timed OR regexp_full_match(t, '\d{{10}}|\d{{13}}') AS has_time, CASE
  WHEN regexp_full_match(t, '\d{{10}}') THEN make_timestamp(try_cast(t AS BIGINT) * 1000000) WHEN regexp_full_match(t, '\d{{13}}') THEN make_timestamp(try_cast(t AS BIGINT) * 1000)
  WHEN by_zone IS NULL THEN CASE WHEN regexp_full_match(own, '[+-]\d{{2}}:?\d{{2}}') AND try_cast(own[2:3] AS INT) <= 18 AND try_cast(own[-2:] AS INT) < 60 THEN ts - to_microseconds((CASE WHEN own[1] = '-' THEN -1 ELSE 1 END) * (try_cast(own[2:3] AS BIGINT) * 60 + try_cast(own[-2:] AS BIGINT)) * 60000000) END
  WHEN {_OFFSET.format("u1")} = o1 OR {_OFFSET.format("u2")} <> o2 THEN u1 ELSE u2 END AS utc FROM both_ways)
"""
_UTC = "strftime({0}, '%Y-%m-%dT%H:%M:%S.%fZ')"

SQL = {
    "p3_found": _TIMES + f"SELECT field_name, record_id, {_UTC.format('utc')} AS utc_time FROM times WHERE utc IS NOT NULL",
    "p6_found": _TIMES
    + f"""
, taken AS (SELECT DISTINCT dev, utc, record_id FROM times WHERE field_name = 'media_items.date_taken' AND has_time AND utc IS NOT NULL AND dev IS NOT NULL)
, flagged AS (SELECT *, CASE WHEN epoch_us(utc) - epoch_us(lag(utc) OVER w) <= {SESSION_GAP_SECONDS * 1_000_000} THEN 0 ELSE 1 END AS starts FROM taken WINDOW w AS (PARTITION BY dev ORDER BY utc, record_id))
, numbered AS (SELECT *, sum(starts) OVER (PARTITION BY dev ORDER BY utc, record_id) AS n FROM flagged)
SELECT dev AS source_device, {_UTC.format('min(utc)')} AS session_start, {_UTC.format('max(utc)')} AS session_end, count(*) AS item_count FROM numbered GROUP BY dev, n""",
    "p2_found": _P2 + "SELECT * FROM found",
    "p2_counts": _P2
    + """SELECT table_name, orphan_kind, period, count(*) AS orphans, count(DISTINCT missing_key) AS missing_keys
         FROM found GROUP BY ALL""",
}
