"""Problems 2, 3 and 6 against plain Python and SQL, and their edge cases."""

import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from fotomill.functions.timestamps import utc_text, with_instant
from fotomill.operators.references import Reference, orphan_counts, orphan_references
from fotomill.operators.sessions import sessions
from fotomill.operators.timestamps import normalise, with_zones
from fotomill.plans import problems
from tests.oracle import connect, duck_rows, spark_rows

MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def brute_time(text, zone, order):
    """(datetime in UTC, has_time) by another road: split the text into date, clock and zone and let datetime judge."""
    s = (text or "").strip()
    utc = timezone.utc
    if re.fullmatch(r"\d{10}|\d{13}", s):
        n = int(s)
        us = n * 1_000_000 if len(s) == 10 else n * 1000
        return datetime(1970, 1, 1, tzinfo=utc) + timedelta(microseconds=us), True
    own = None
    m = re.search(r"(Z|UTC|GMT|[+-]\d\d:?\d\d|[A-Z][a-z]+/[A-Za-z_]+)$", s)
    if m and (":" in s or "T" in s) and not re.fullmatch(r"\d{4}-\d\d-\d\d", s):
        own, s = m[1], s[: m.start()].strip()
    half = None
    if m := re.search(r" ([AP]M)$", s):
        half, s = m[1], s[: m.start()]
    s = re.sub(r"^[A-Z][a-z][a-z], ", "", s)
    for pat, names in (
        (r"(\d{4})[:-](\d\d)[:-](\d\d)(?:[ T](.*))?", "ymdc"),
        (r"(\d{4})(\d\d)(\d\d)(?:[_T](\d{6}))?", "ymdc"),
        (r"(\d+)/(\d+)/(\d{4})(?: (.*))?", "mdyc" if order == "MDY" else "dmyc"),
        (r"(\d+) ([A-Z][a-z]{2}) (\d{4})(?:,? (.*))?", "dmyc"),
    ):
        if m := re.fullmatch(pat, s):
            p = dict(zip(names, m.groups(), strict=True))
            break
    else:
        return None
    month = MONTHS.index(p["m"].lower()) + 1 if p["m"].isalpha() else int(p["m"])
    clock = p["c"]
    if clock is None:
        h, mi, sec, us = 12, 0, 0, 0
    else:
        if re.fullmatch(r"\d{6}", clock):
            clock = f"{clock[:2]}:{clock[2:4]}:{clock[4:]}"
        clock, _, frac = clock.partition(".")
        h, mi, sec = (*map(int, clock.split(":")), 0)[:3]
        us = int((frac + "000000")[:6])
        if half:
            h = h % 12 + (12 if half == "PM" else 0)
    try:
        local = datetime(int(p["y"]), month, int(p["d"]), h, mi, sec, us)
    except ValueError:
        return None
    if own in ("Z", "UTC", "GMT"):
        at = local.replace(tzinfo=utc)
    elif own and own[0] in "+-":
        d = own[1:].replace(":", "")
        off = timedelta(hours=int(d[:2]), minutes=int(d[2:])) * (-1 if own[0] == "-" else 1)
        at = (local - off).replace(tzinfo=utc)
    else:
        at = local.replace(tzinfo=ZoneInfo(own or zone or "UTC")).astimezone(utc)
    return at, clock is not None


def fmt(at):
    return at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def brute_fields(sf):
    con = connect(sf)
    dev = {r[0]: r[1:] for r in con.execute("SELECT device_id, time_zone, date_order FROM devices").fetchall()}
    of = dict(con.execute("SELECT id, source_device FROM media_items").fetchall())
    none = (None, None)
    out = set()
    times = []
    for i, v, src, d in con.execute("SELECT id, date_taken, date_taken_source, source_device FROM media_items").fetchall():
        zone, order = dev.get(d, none)
        if r := brute_time(v, None if (src or "").strip().lower() == "fixture" else zone, order):
            out.add(("media_items.date_taken", i, fmt(r[0])))
            if r[1] and d:
                times.append((d, r[0]))
    for i, item, v, mime in con.execute("SELECT record_id, media_item_id, create_date, mime_type FROM metadata_info").fetchall():
        zone, order = dev.get(of.get(item), none)
        if r := brute_time(v, None if (mime or "").strip().lower().startswith("video/") else zone, order):
            out.add(("metadata_info.create_date", i, fmt(r[0])))
    for i, item, v in con.execute("SELECT estimate_id, media_item_id, ai_date FROM date_estimate").fetchall():
        zone, order = dev.get(of.get(item), none)
        if r := brute_time(v, zone, order):
            out.add(("date_estimate.ai_date", i, fmt(r[0])))
    return out, times


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_p3_and_p6_against_plain_python(spark, size):
    d = f"/root/testdata/{size}"
    want, times = brute_fields(d)
    rows = [tuple(r) for r in problems.p3_found(spark, d).select("field_name", "record_id", "utc_time").collect()]
    assert len(rows) == len(set(rows))
    assert set(rows) == want
    runs = {}
    for dev, at in sorted(times):
        last = runs.setdefault(dev, [])
        if last and (at - last[-1][1]).total_seconds() <= 21600:
            last[-1][1] = at
            last[-1][2] += 1
        else:
            last.append([at, at, 1])
    want6 = {(k, fmt(a), fmt(b), n) for k, v in runs.items() for a, b, n in v}
    got6 = [tuple(r) for r in problems.p6_found(spark, d).select("source_device", "session_start", "session_end", "item_count").collect()]
    assert len(got6) == len(want6)
    assert set(got6) == want6


CASES = [
    ("2021-10-31 02:30:00", "Europe/Berlin", "DMY", "2021-10-31T00:30:00.000000Z"),  # twice: the first
    ("2021-03-28 02:30:00", "Europe/Berlin", "DMY", "2021-03-28T01:30:00.000000Z"),  # skipped: the offset before
    ("2021-10-03 02:10:00", "Australia/Lord_Howe", "DMY", "2021-10-02T15:40:00.000000Z"),  # half an hour skipped
    ("2020:02:29", "Asia/Kathmandu", "DMY", "2020-02-29T06:15:00.000000Z"),
    ("2021-02-29", None, None, None),
    ("  2014-07-18T20:05:14.472140999Z ", "Asia/Tokyo", "DMY", "2014-07-18T20:05:14.472140Z"),
    ("2014-07-18T20:05", None, None, "2014-07-18T20:05:00.000000Z"),
    ("03/04/2019 12:05 AM", "UTC", "MDY", "2019-03-04T00:05:00.000000Z"),
    ("03/04/2019 12:05 PM", "UTC", "DMY", "2019-04-03T12:05:00.000000Z"),
    ("13/04/2019", "UTC", "MDY", None),
    ("03/04/2019 13:05 PM", "UTC", "MDY", None),
    ("Fri, 01 Jul 2011 05:48:27 +0200", None, None, "2011-07-01T03:48:27.000000Z"),
    ("1 May 2009, 02:35", "America/New_York", "MDY", "2009-05-01T06:35:00.000000Z"),
    ("20090201T011159Z", "Asia/Tokyo", "DMY", "2009-02-01T01:11:59.000000Z"),
    ("20090201_011159", "Asia/Tokyo", "DMY", "2009-01-31T16:11:59.000000Z"),
    ("20090201", "Asia/Tokyo", "DMY", "2009-02-01T03:00:00.000000Z"),
    ("1233446605", "Asia/Tokyo", "DMY", "2009-02-01T00:03:25.000000Z"),
    ("1233448272342", None, None, "2009-02-01T00:31:12.342000Z"),
    ("2010-01-01 10:00:00 Europe/Nowhere", None, None, None),
    ("2010-01-01 10:00:00 Europe/London", "Asia/Tokyo", None, "2010-01-01T10:00:00.000000Z"),
    ("2010-01-01 10:00:00", "Not/AZone", None, "2010-01-01T10:00:00.000000Z"),
    ("1969-12-31 23:59:59.5", None, None, "1969-12-31T23:59:59.500000Z"),
    ("2010-01-01 24:00:00", None, None, None),
    ("2010-01-01 10:60:00", None, None, None),
    ("2010-01-01 10:00:00+25:00", None, None, None),
    ("2010-01", None, None, None),
    ("", None, None, None),
    (None, None, None, None),
    ("x" * 100_000, None, None, None),
]


def test_written_times(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(CASES)], "i int, v string, z string, o string")
    got = {r["i"]: r["u"] for r in with_instant(df, "v", F.col("z"), F.col("o")).select("i", utc_text(F.col("utc_micros")).alias("u")).collect()}
    for i, c in enumerate(CASES):
        assert got.get(i) == c[3], c


def test_written_times_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("2021-03-28 02:30:00", "Europe/Berlin")], "v string, z string")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = with_instant(df, "v", F.col("z"), F.lit("DMY")).select(utc_text(F.col("utc_micros"))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert r[0] == "2021-03-28T01:30:00.000000Z"


def test_normalise_edges(spark):
    dev = spark.createDataFrame(
        [("a", "Asia/Tokyo", "DMY"), ("a", "Asia/Tokyo", "DMY"), ("b", None, None)], "device_id string, time_zone string, date_order string"
    )
    df = spark.createDataFrame(
        [(1, "2020-01-01 09:00:00", "a", 5), (2, "2020-01-01 09:00:00", None, 6), (3, "2020-01-01 09:00:00", "zz", 7), (None, "2020-01-02", "b", 8), (4, None, "a", 9)],
        "id long, v string, zone string, utc_micros int",
    )
    rows = lambda f: with_zones(f.select(F.col("id").alias("record_id"), F.col("v").alias("value"), F.lit(None).cast("boolean").alias("as_utc"), F.col("zone").alias("dev"), "utc_micros"), 5, dev, "dev", "record_id")
    got = normalise(rows(df), [])
    assert got.columns == ["record_id", "utc_micros", "has_time"]
    by = {r[0]: (r[1], r[2]) for r in got.collect()}
    nine = 1577869200 * 1_000_000
    assert by == {1: (nine - 9 * 3600 * 1_000_000, True), 2: (nine, True), 3: (nine, True), None: (1577966400 * 1_000_000, False)}
    assert normalise(rows(df.limit(0)), []).count() == 0


@pytest.mark.parametrize("name", sorted(problems.SQL))
def test_against_sql(spark, sf, name):
    assert spark_rows(problems.QUERIES[name](spark, sf)) == duck_rows(connect(sf), problems.SQL[name])


def _refs(spark, rows, parents):
    child = spark.createDataFrame(rows, "id long, k long, at string, parent_at string, is_parent int")
    parent = spark.createDataFrame(parents, "id long, made string, at string")
    return [Reference("c", child, "id", "k", "at", "p", parent, "id", "made")]


def test_orphans_edges(spark):
    t = "2024-01-05 00:00:00"
    rows = [
        (1, 1, t, None, 1), (1, 1, t, None, 1),  # missing, delivered twice
        (2, 2, t, None, 1),  # there
        (3, 3, t, None, 1),  # late
        (4, None, t, None, 1), (5, 3, None, None, 1), (6, 9, None, None, 1), (7, 4, t, None, 1), (None, 9, t, None, 1),
    ]
    parents = [(2, t, "x"), (3, "2024-01-05 00:00:01", "x"), (4, None, "x"), (4, "2024-01-01 00:00:00", "x"), (None, t, "x")]
    got = {tuple(r) for r in orphan_references(_refs(spark, rows, parents)).collect()}
    assert got == {
        ("c", 1, 1, "missing", "2024-01"), ("c", 3, 3, "late", "2024-01"), ("c", 6, 9, "missing", None), ("c", None, 9, "missing", "2024-01"),
    }
    assert orphan_references(_refs(spark, [], parents)).count() == 0
    assert orphan_references(_refs(spark, rows, [])).count() == 7
    hot = [(i, 77, t, None, 1) for i in range(5000)]
    assert orphan_counts(_refs(spark, hot, parents)).collect()[0].asDict() == {
        "table_name": "c", "orphan_kind": "missing", "period": "2024-01", "orphans": 5000, "missing_keys": 1,
    }


def test_sessions_edges(spark):
    s = 1_000_000
    rows = [("u", 0, 1), ("u", 10 * s, 2), ("u", 10 * s, 2), ("u", 10 * s, 3), ("u", 20 * s + 1, 4), ("v", -5 * s, 5), ("v", 5 * s, 6), (None, 0, 7), ("w", None, 8)]
    df = spark.createDataFrame(rows, "u string, t long, slot long")
    got = {(r["user"], r["start_micros"], r["end_micros"], r["event_count"]) for r in sessions(df, "u", "t", 10, "slot").collect()}
    assert got == {("u", 0, 10 * s, 3), ("u", 20 * s + 1, 20 * s + 1, 1), ("v", -5 * s, 5 * s, 2)}
    assert {r["event_count"] for r in sessions(df, "u", "t", 10).filter("user = 'u'").collect()} == {4, 1}
    assert sessions(df.limit(0), "u", "t", 10).count() == 0
