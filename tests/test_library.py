"""The library's operators against SQL, plain Python and the small cases they are known by."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fotomill.functions import dates, geo, hashes, media, payloads, text
from fotomill.operators import bursts, clusters, duplicates, kernels, lifecycle, locations, naming, ordering
from fotomill.plans import library
from fotomill.sources.media import media_files, write_library
from fotomill.streaming.feeds import append_unknown, live_sessions, new_items
from tests.oracle import connect, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(library.SQL))
def test_against_sql(spark, sf, name):
    assert spark_rows(library.QUERIES[name](spark, sf)) == duck_rows(connect(sf), library.SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _items(spark, rows):
    return spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").try_cast("timestamp_ntz").alias("at"))


def test_clusters_and_long_spans(spark):
    df = _items(spark, [(1, "2025-07-01"), (2, "2025-07-02"), (3, "2025-07-10"), (4, None)])
    got = clusters.day_clusters(df, "at")
    assert sorted((r["id"], r["cluster_no"]) for r in got.collect()) == [(1, 1), (2, 1), (3, 2)]
    long = clusters.day_clusters(_items(spark, [(i + 1, f"2026-01-{d:02d}") for i, d in enumerate((1, 2, 3, 20, 21))]), "at", gap_days=30)
    parts = clusters.split_long_spans(long, "at", 14)
    assert sorted((r["id"], r["part_no"]) for r in parts.collect()) == [(1, 0), (2, 0), (3, 0), (4, 1), (5, 1)]
    days = _items(spark, [(1, "2025-07-01 10:00:00"), (2, "2025-07-01 14:00:00"), (3, "2025-07-03"), (4, "2025-12-24")]).withColumn("g", F.lit(1))
    s = {r["duration_days"]: r for r in clusters.cluster_stats(days.filter("id < 4"), ["g"], "at").collect()}
    assert s[3]["distinct_days"] == 2 and not s[3]["is_holiday"]
    assert clusters.cluster_stats(days.filter("id = 4"), ["g"], "at").first()["is_holiday"]
    assert clusters.day_clusters(df.limit(0), "at").count() == 0


def test_long_span_is_cut_once_at_the_first_largest_gap_even_within_an_hour(spark):
    rng = random.Random(2)
    t0, rows, at = datetime(2024, 3, 1), [], datetime(2024, 3, 1)
    for i in range(2500):
        at += timedelta(seconds=rng.choice([300, 500, 900, 1100, 1100]))
        rows.append((i, at.isoformat(sep=" ")))
    assert (at - t0).days > 14
    c = clusters.day_clusters(_items(spark, rows), "at")
    got = {r["id"]: r["part_no"] for r in clusters.split_long_spans(c, "at").collect()}
    gaps = [(datetime.fromisoformat(b[1]) - datetime.fromisoformat(a[1])).total_seconds() for a, b in zip(rows, rows[1:], strict=False)]
    cut = gaps.index(max(gaps)) + 1
    assert got == {i: int(i >= cut) for i in range(2500)}


def test_generic_clusters_are_cut_until_named(spark):
    rng = random.Random(8)
    at, rows = datetime(2024, 5, 1), []
    for i in range(90):
        at += timedelta(seconds=rng.choice([0, 60, 600, 40_000]))
        rows.append((i, at))
    flat = [(100 + i, datetime(2024, 1, 1)) for i in range(30)]

    def split(part):
        gaps = [(b[1] - a[1]).total_seconds() for a, b in zip(part, part[1:], strict=False)]
        if len(part) <= 20 or max(gaps) == 0 or part[0][1].day % 2 == 0:
            return [part]
        k = gaps.index(max(gaps)) + 1
        return split(part[:k]) + split(part[k:])

    df = spark.createDataFrame([(i, t, "a") for i, t in rows] + [(i, t, "b") for i, t in flat], "id long, t timestamp, c string")
    df = df.select("id", F.col("t").cast("timestamp_ntz").alias("at"), "c")
    got = clusters.resplit_generic(df, "c", "at", lambda s: s.filter("day(start_date) % 2 = 1")).collect()
    parts = {}
    for r in got:
        parts.setdefault(r["c"], set()).add(r["id"])
    assert sorted(map(sorted, parts.values())) == sorted([sorted(x[0] for x in p) for p in split(rows)] + [[x[0] for x in flat]])


def greedy_bursts(rows, seconds, distance):
    """{(id, first id, best id)} by looking, for each burst, through all later rows."""
    rows, out = sorted(rows, key=lambda r: (r[1], r[0])), set()
    while rows:
        burst, rest = rows[:1], rows[1:]
        while rest and (rest[0][1] - burst[-1][1]) // 1_000_000 <= seconds:
            row = rest.pop(0)
            if ((row[2] ^ burst[-1][2]) & (2**64 - 1)).bit_count() <= distance:
                burst.append(row)
        if len(burst) > 1:
            best = max(enumerate(burst), key=lambda x: (x[1][3], x[0]))[1]
            out |= {(r[0], burst[0][0], best[0]) for r in burst}
            rows = rest
        else:
            rows = rows[1:]
    return out


def test_bursts_by_islands_equal_one_scan(spark):
    rng = random.Random(4)
    rows, t = [], 0
    for i in range(600):
        t += rng.choice([200_000, 900_000, 2_500_000, 3_900_000, 4_000_000, 9_000_000])
        rows.append((i, t, rng.choice([0, 1, 3, 0xFFFF, -1]), float(rng.randint(0, 3))))
    df = spark.createDataFrame([(*r, "a") for r in rows], "id long, us long, h long, blur double, dev string")
    df = df.withColumn("at", F.timestamp_micros("us").cast("timestamp_ntz"))
    want = {(i, first, i == best) for i, first, best in greedy_bursts(rows, 3, 10)}
    for by in (["dev"], []):
        assert {tuple(r) for r in bursts.bursts(df, by, "at", "id", "h", "blur").collect()} == want
    pair = [(1, 0, 0, 100.0), (2, 2_000_000, 1, 120.0)]
    assert greedy_bursts(pair, 3, 10) == {(1, 1, 2), (2, 1, 2)}
    assert greedy_bursts([(1, 0, 0, 1.0), (2, 2_000_000, -1, 1.0)], 3, 10) == set()


def test_thinning(spark):
    names = ["IMG_1.jpg", "IMG_2.jpg", "DSC1.jpg", "IMG_3.jpg", "IMG_4.jpg"]
    secs = [0, 3, 4, 6, 100]
    df = spark.createDataFrame([(i + 1, n, s, 1) for i, (n, s) in enumerate(zip(names, secs, strict=True))], "id long, n string, s long, g int")
    df = df.withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = clusters.thin_near_duplicates(df, ["g"], "at", "id", text.filename_prefix(F.col("n")))
    assert sorted(r["id"] for r in got.collect()) == [1, 3, 4, 5]


def test_places_from_the_cache_and_answers_into_it(spark):
    cache = spark.createDataFrame([("1.00:2.00", "Rome", "Italy"), ("3.00:4.00", None, None), ("3.00:4.00", None, None), (None, "x", "y")], "coord_key string, city string, country string")
    items = spark.createDataFrame([(1, 1.001, 2.0), (2, 3.0, 4.0), (3, 5.0, 6.0), (4, None, 6.0)], "id long, la double, lo double").withColumn("cached", F.lit("clash"))
    got = {r["id"]: tuple(r)[3:] for r in locations.with_cached_places(items.drop("cached"), F.col("la"), F.col("lo"), cache).collect()}
    assert got == {1: ("1.00:2.00", "Rome", "Italy", True), 2: ("3.00:4.00", None, None, True), 3: ("5.00:6.00", None, None, False), 4: (None, None, None, False)}
    answers = spark.createDataFrame([("5.00:6.00", None, None), ("1.00:2.00", "Paris", "France")], cache.schema)
    assert sorted((r["coord_key"] or "", r["city"] or "") for r in locations.cache_with_answers(cache, answers).collect()) == [("", "x"), ("1.00:2.00", "Rome"), ("3.00:4.00", ""), ("3.00:4.00", ""), ("5.00:6.00", "")]


def test_a_hot_group_is_numbered_over_many_tasks(spark):
    df = spark.range(120_500).select("id", F.when(F.col("id") < 120_000, "hot").when(F.col("id") < 120_400, F.lit(None)).otherwise("cold").alias("name"))
    got = ordering.numbered_in_group(df, ["name"], ["id"])
    assert got.filter("name = 'hot' AND pos = id").count() == 120_000
    assert got.filter("name IS NULL AND pos = id - 120000").count() == 400 and got.filter("name = 'cold' AND pos = id - 120400").count() == 100


def test_views_and_queues_are_in_order(spark, sf):
    rows = [r for r in library.video_threshold_views(spark, sf).collect()]
    size = {r["id"]: (r["file_size"], r["duration_secs"]) for r in spark.read.parquet(f"{sf}/media_items.parquet").collect()}
    keys = [(r["mode"], size[r["id"]][r["mode"] == "duration"], r["id"]) for r in rows]
    assert keys == sorted(keys) and len(keys) > 2
    groups = [(-r["event_year"], r["group_name"]) for r in library.group_listing(spark, sf).collect()]
    assert groups == sorted(groups)


def test_even_positions(spark):
    cases = {(10, 5): [0, 2, 5, 7, 9], (3, 5): [0, 1, 2], (0, 5): [], (1, 5): [0], (5, 5): [0, 1, 2, 3, 4], (7, 1): [0], (100, 10): [0, 11, 22, 33, 44, 55, 66, 77, 88, 99]}
    df = spark.createDataFrame([(n, t) for n, t in cases], "n long, t int")
    got = {(r["n"], r["t"]): r["p"] for r in df.select("n", "t", ordering.even_positions(F.col("n"), F.col("t")).alias("p")).collect()}
    assert got == cases
    rows = df.filter("n > 0").withColumn("pos", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    hit = rows.filter(ordering.is_even_sample(F.col("pos"), F.col("n"), F.least("t", "n"))).groupBy("n", "t").agg(F.sort_array(F.collect_list("pos")).alias("p"))
    assert {(r["n"], r["t"]): r["p"] for r in hit.collect()} == {k: v for k, v in cases.items() if k[0]}


def test_ordinals_and_upper_median(spark):
    df = spark.createDataFrame([(i * 7919 % 1000, i) for i in range(1000)], "k long, v long")
    got = {r["k"]: r["ordinal"] for r in ordering.global_ordinal(df, ["k"]).collect()}
    assert got == {k: k + 1 for k in range(1000)}
    m = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("a", 10.0), ("b", 5.0), ("b", None)], "g string, v double")
    assert {tuple(r) for r in ordering.upper_median(m.withColumn("i", F.monotonically_increasing_id()), ["g"], "v", ["i"]).collect()} == {("a", 3.0), ("b", 5.0)}


def test_collisions_and_names(spark):
    df = spark.createDataFrame([(i, 2025, "2025 - Trip" if i % 2 else " 2025 - trip") for i in range(5)], "i int, y int, n string")
    got = [r["folder_name"] for r in naming.resolve_collisions(df, ["y"], "n", [F.col("i")]).orderBy("i").collect()]
    assert got == ["2025 - trip", "2025 - Trip (Early)", "2025 - trip (Late)", "2025 - Trip 2", "2025 - trip 3"]
    v = spark.createDataFrame([("Portland/Oregon Trip", "sure", "party", 2025), ("Good Times", "high", "Travel", 2025), (" ", None, None, 2025), (None, "LOW", "misc", 2025)], "n string, c string, t string, y int")
    got = [tuple(r["x"]) for r in v.select(naming.validated_name(*[F.col(c) for c in "ncty"]).alias("x")).collect()]
    assert got == [("2025 - Portland-Oregon Trip", "medium", None, False), ("2025 - Good Times", "low", "travel", True), ("2025 - Misc", "medium", None, False), ("2025 - Misc", "low", "misc", True)]
    s = "struct<confidence:string,needs_fallback:boolean,n:int>"
    r = spark.createDataFrame([(("low", False, 1), ("high", False, 2)), (("high", False, 1), ("high", False, 2)), (None, ("low", True, 2)), (("low", True, 1), None)], f"a {s}, b {s}")
    assert [x[0] for x in r.select(naming.routed(F.col("a"), F.col("b"))["n"]).collect()] == [2, 1, 2, 1]


def test_cluster_names_go_by_size_then_season_then_confidence(spark):
    day = lambda m, d: datetime(2025, m, d).date()
    rows = [(2026, 5, datetime(2026, 2, 14).date(), False), (2026, 2, datetime(2026, 2, 14).date(), False), (2025, 2, day(12, 24), True), (2025, 3, day(12, 24), True)]
    c = spark.createDataFrame(rows, "event_year int, item_count long, start_date date, is_holiday boolean")
    got = [tuple(r) for r in naming.cluster_names(c).select("suggested_name", "base_name", "confidence", "event_type", "is_misc").collect()]
    assert got == [
        ("2026 - February Activities", "2026 - February Memories", "low", "misc", 1), ("2026 - Misc", "2026 - Misc", "medium", "misc", 1),
        ("2025 - Misc", "2025 - Misc", "medium", "misc", 1), ("2025 - Family Christmas", "2025 - Family Christmas", "high", "holiday", 0),
    ]
    away = naming.cluster_names(c, away=F.lit(True), place=F.lit("Lisbon")).first()
    assert (away["suggested_name"], away["base_name"], away["is_misc"]) == ("2026 - Lisbon Trip", "2026 - Lisbon Trip", 1)
    said = [("2025 - Snow", "High", "sports"), ("2025 - Walks ", "LOW", "family"), ("2025 - Bits", "low", "Misc"), (" ", "medium", None), ("2025 - Misc", "medium", None), (None, None, None)]
    s = spark.createDataFrame([(2025, 9, day(12, 24 if i == 0 else 1), i == 0, (*x, "why")) for i, x in enumerate(said)], "event_year int, item_count long, start_date date, is_holiday boolean, said " + naming.SUGGESTION)
    named = naming.cluster_names(s, F.col("said"))
    assert [(r["base_name"], r["is_misc"]) for r in named.collect()] == [("2025 - Snow", 0), ("2025 - Walks", 0), ("2025 - December Memories", 1), ("2025 - Misc", 1), ("2025 - Misc", 1), ("2025 - Misc", 1)]
    audit = [(r["media_item_id"], r["old_value"], r["new_value"], r["details"]) for r in naming.low_confidence_audit(named).collect()]
    assert audit == [(None, "2025 - Walks ", "2025 - Walks", "why"), (None, "2025 - Bits", "2025 - December Memories", "why")]


def test_scalars(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    assert 2441 < val(geo.haversine_miles(F.lit(40.7128), F.lit(-74.006), F.lit(34.0522), F.lit(-118.2437))) < 2461
    assert val(geo.geocode_key(F.lit(36.169), F.lit(-86.785))) == "36.17:-86.78"
    assert val(hashes.hamming(F.lit(0), F.lit(-1).cast("bigint"))) == 64
    assert val(text.sanitize_folder_name(F.lit(' a<b>:"c|?* .. '))) == "a-b---c---"
    assert val(text.sanitize_folder_name(F.lit("name. ."))) == "name." and val(text.sanitize_folder_name(F.lit("name .."))) == "name"
    assert val(text.filename_prefix(F.lit("IMG_001.jpg"))) == "img"
    assert val(text.long_path(F.lit("x" * 241))).startswith("\\\\?\\x") and val(text.long_path(F.lit("x" * 240))) == "x" * 240
    assert val(text.model_id(F.lit("a"), F.lit("b"))) == "a:b"
    assert val(dates.exif_day(F.lit("2026:03:12 10:11:12"))) == "2026-03-12" and val(dates.exif_day(F.lit("2026-03-12T10:11:12Z"))) == "2026-03-12T10:11:12Z"
    assert val(dates.capture_time(F.lit("2026-03-12"))) == datetime(2026, 3, 12, 12) and val(dates.capture_time(F.lit("2026-03-12T10:11:12Z"))) is None
    assert val(dates.capture_time(F.lit("2026-03-12T10:11:12.5"), fraction=False)) is None
    for w, h, ok in ((4000, 3000, True), (6000, 4000, True), (1920, 1080, True), (1170, 2532, False), (0, 5, False)):
        assert val(media.is_camera_ratio(F.lit(w), F.lit(h))) is ok
    assert val(media.is_screen_size(F.lit(2532), F.lit(1170))) and not val(media.is_screen_size(F.lit(4000), F.lit(3000)))
    assert abs(val(media.screenshot_score(F.lit(1170), F.lit(2532), F.lit(False), F.lit(0.7), F.lit(True))) - 1.0) < 1e-9
    assert val(text.auth_status(F.lit("Invalid email/password combination."))) == "invalid_credentials" and val(text.auth_status(F.lit("x"))) == "error"
    assert val(text.format_duration(F.lit(125.4))) == "2:05" and val(text.format_bytes(F.lit(1536))) == "2 KB"
    assert val(text.mime_of(F.lit("a.MOV"))) == "video/quicktime" and val(text.mime_of(F.lit("a.MOV"), text.DISPLAY_MIME)) == "video/mp4" and val(text.extension(F.lit(".hidden"))) == ""


def test_payloads(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    e = val(payloads.exif_record(F.lit('{"Duration": "12.5", "CodecID": "hvc1", "ImageWidth": 10, "Make": "X"}')))
    assert (e["duration_secs"], e["video_codec"], e["width"], e["camera_make"]) == (12.5, "hvc1", 10, "X")
    assert val(payloads.exif_record(F.lit('{"Duration": 3, "VideoCodec": "a", "CodecID": "b"}')))["duration_secs"] == 3.0
    assert tuple(val(payloads.date_estimate(F.lit("{broken")))) == (None, 0.0, "Awaiting AI estimation")
    assert tuple(val(payloads.date_estimate(F.lit('{"ai_date": "2026-03-11", "confidence": 0.88, "reasoning": "r"}')))) == ("2026-03-11", 0.88, "r")
    assert val(payloads.string_list(F.lit("nope"))) == [] and val(payloads.string_list(F.lit('["a"]'))) == ["a"]
    clues = val(payloads.cluster_clues(F.lit('{"scene_signals": [" a ", ""], "dominant_context": "Travel", "people_focus": "x"}')))
    assert (clues["scene_signals"], clues["dominant_context"], clues["people_focus"], clues["needs_fallback"]) == (["a"], "travel", None, False)
    assert tuple(val(payloads.city_country(F.lit('{"results": [{"name": "", "country": "X"}], "address": {"village": " V ", "country": "C"}}')))) == ("V", "C")
    assert val(payloads.city_country(F.lit('{"address": {"city": "", "country": "C"}}'))) is None
    assert tuple(val(payloads.first_place(F.lit('[{"lat": "1.5", "lon": "2", "display_name": "d"}]')))) == (1.5, 2.0, "d")
    assert val(payloads.first_place(F.lit("[]"))) is None


def test_duplicate_groups(spark):
    rows = [(1, 0, None), (2, 0, None), (3, 1, "b"), (4, 1, "b"), (5, 1 << 60, None), (6, 9, "c"), (7, 9, "c"), (8, None, None), (9, 0b11111100000, None)]
    df = spark.createDataFrame(rows, "id long, h long, burst string")
    got = {tuple(r) for r in duplicates.duplicate_groups(df, "id", "h", "burst").collect()}
    assert got == {(i, "dup-1") for i in (1, 2, 3, 4, 6, 7)}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long")
    assert {r["label"] for r in duplicates.least_labels(chain, "a", "b").collect()} == {0}


def test_a_crowded_prefix_is_compared_block_by_block(spark):
    rows = spark.range(900).select(F.lit(7).alias("p"), F.when(F.col("id") < 700, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("rep"))
    got = duplicates._meetings(rows, ["p", "k"], ["rep"], "rep", block=50)
    pairs = [(r["rep_a"], r["rep_b"]) for r in got.select("rep_a", "rep_b").collect()]
    assert len(pairs) == len(set(pairs)) == 700 * 700 + 200


def test_location_facts_without_coordinates(spark):
    df = spark.createDataFrame([(1, datetime(2025, 1, 1), None, None, None)], "id long, at timestamp, lat double, lon double, city string").withColumn("g", F.lit(1))
    r = locations.location_facts(df, ["g"], ["at", "id"], "at", "lat", "lon", "city", (0.0, 0.0, 25.0, "x")).first()
    assert (r["gps_coverage_percent"], r["away_from_home"], r["location_consistency"], r["maybe_travel"]) == (0.0, None, "none", False)
    p = spark.createDataFrame([(1, 0, "Rome"), (1, 1, "ROME"), (1, 2, "Oslo"), (2, 0, "B"), (2, 1, "a")], "g int, pos int, c string")
    got = {r["g"]: tuple(r)[1:] for r in locations.dominant_places(p, ["g"], "c", "pos").collect()}
    assert got == {1: ("Rome", "medium", "mixed"), 2: ("B", "medium", "mixed")}


def test_changes(spark):
    items = spark.createDataFrame([(1, "grouped"), (2, "filed"), (3, None)], "id long, status string")
    ids = spark.createDataFrame([(1,), (2,), (1,)], "x long")
    ok = F.col("status").isin("grouped", "indexed")
    assert not lifecycle.all_or_nothing(items, ids, "id", ok) and lifecycle.all_or_nothing(items, ids.filter("x = 1"), "id", ok)
    got = lifecycle.change_where(items, ids, "id", {"status": F.lit("excluded")}, ok)
    assert sorted(tuple(r) for r in got.collect()) == [(1, "excluded"), (2, "filed"), (3, None)]
    base = spark.createDataFrame([("a", "1", 0), ("b", "2", 0)], "k string, v string, n int")
    new = spark.createDataFrame([("b", "3", 1), ("b", "4", 2), ("c", "5", 1)], "k string, v string, n int")
    assert sorted(r["v"] for r in lifecycle.upsert(base, new, ["k"], ["n"]).collect()) == ["1", "4", "5"]
    assert sorted(r["v"] for r in lifecycle.insert_or_ignore(base, new, "k", ["n"]).collect()) == ["1", "2", "5"]
    paths = spark.createDataFrame([(1, "a.jpg"), (2, "a.jpg"), (3, "b")], "id long, f string")
    taken = spark.createDataFrame([("d/b",)], "p string")
    got = {r["id"]: r["target_path"] for r in lifecycle.target_paths(paths, F.lit("d"), "f", "id", taken).collect()}
    assert got == {1: "d/a.jpg", 2: "d/2_a.jpg", 3: "d/3_b"}
    assert {r["id"]: r["unique_name"] for r in lifecycle.numbered_paths(paths, "f", "id", most=0).collect()} == {1: "a.jpg", 2: "a_overflow.jpg", 3: "b"}


def test_kernels(spark):
    flat = np.full((1, 64, 64), 128.0)
    assert kernels.laplacian_variance(flat) == [0] and kernels.laplacian_variance(np.eye(2)[None]) == [0]
    assert kernels.laplacian_variance((np.indices((64, 64)).sum(0) % 2 * 255.0)[None]) > 1e5
    assert kernels.exposure(np.full((1, 4, 4), 10.0))[2] == 1 and kernels.exposure(np.full((1, 4, 4), 240.0))[3] == 1
    falling = np.tile(np.arange(9, 0, -1.0), (8, 1))
    assert kernels.difference_hash(np.stack([falling, falling[:, ::-1]])).tolist() == [-1, 0]
    wide = np.repeat(np.repeat(falling * 20, 5, 0), 7, 1)[None]  # shrinking keeps the slope
    assert kernels.difference_hash(wide) == [-1] and kernels.resize(wide, 8, 9).shape == (1, 8, 9)
    assert kernels.resize(np.array([[[0.0, 100.0]]]), 1, 4).tolist() == [[[0.0, 25.0, 75.0, 100.0]]]
    rgb = np.stack([flat] * 3, -1)
    assert kernels.flat_share(rgb) == [1] and kernels.has_bars(rgb) == [True] and kernels.flat_share(np.random.default_rng(1).integers(0, 255, (1, 64, 64, 3))) == [0]
    assert kernels.shrink(np.zeros((1, 3000, 10))).shape == (1, 1024, 3)
    two = spark.createDataFrame([(1, [7.0] * (64 * 64 * 3), 64, 64), (2, [1.0] * 5, 64, 64), (3, None, 64, 64), (4, [None] * 3, 1, 1), (5, [1.0] * 3, 1, 1)], "id long, p array<double>, w int, h int")
    got = {r["record_id"]: (r["flat_share"], r["has_bars"]) for r in kernels.picture_signals(two, "id", "p", "w", "h").collect()}
    assert got == {1: (1.0, True), 2: (None, None), 3: (None, None), 4: (None, None), 5: (0.0, False)}
    df = spark.createDataFrame([(1, [0.0] * 100, 10, 10), (2, None, 1, 1), (3, [1.0], 2, 2)], "id long, p array<double>, w int, h int")
    got = {r["record_id"]: (r["blur_score"], r["dhash"], r["dark_share"]) for r in kernels.picture_measures(df, "id", "p", "w", "h").collect()}
    assert got == {1: (0.0, 0, 1.0), 2: (None, None, None), 3: (None, None, None)}


def test_files_and_sink(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for n in ("a.JPG", "sub/b.mov", "c.txt", "noext"):
        (tmp_path / "in" / n).write_bytes(b"xyz")
    got = {r["filename"]: (r["size"], r["mime_type"]) for r in media_files(spark, str(tmp_path / "in")).collect()}
    assert got == {"a.JPG": (3, "image/jpeg"), "b.mov": (3, "video/quicktime")}
    items = spark.createDataFrame([(1, 2024, "x"), (2, 2025, "y")], "id long, event_year int, folder_name string")
    write_library(items, str(tmp_path / "out"))
    assert (tmp_path / "out/event_year=2024/folder_name=x").is_dir()


def test_streams(spark, sf, tmp_path):
    items = spark.createDataFrame([(i % 5, "u", datetime(2024, 1, 1) + timedelta(hours=i)) for i in range(10)], "id long, u string, at timestamp")
    items.write.parquet(str(tmp_path / "in"))
    q = new_items(spark, str(tmp_path / "in"), items.schema, "id", "at").writeStream.format("memory").queryName("fresh").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("fresh").count() == 5
    known = str(tmp_path / "known")
    items.filter("id = 0").limit(1).write.parquet(known)
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(append_unknown(known, "id")).option("checkpointLocation", str(tmp_path / "c0")).start()
    q.processAllAvailable()
    q.stop()
    append_unknown(known, "id")(items, 1)  # a batch that runs again
    assert sorted(r["id"] for r in spark.read.parquet(known).collect()) == [0, 1, 2, 3, 4]
    late = spark.createDataFrame([(99, "u", datetime(2024, 2, 1)), (98, "u", datetime(2024, 3, 1))], items.schema)
    late.write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    q = live_sessions(stream, "u", "at").writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["session_start"], r["session_end"], r["event_count"]) for r in spark.table("live").collect()}
    assert (datetime(2024, 1, 1), datetime(2024, 1, 1, 9), 10) in got


def _tables(spark, d, **rows):
    """A folder of small tables: a list of rows and a schema each."""
    for name, (data, schema) in rows.items():
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def test_labels_of_every_item(spark, tmp_path):
    rows = [(1, 2048, None), (2, 3 << 20, float("nan")), (3, 10, 125.4), (4, None, None)]
    d = _tables(spark, tmp_path, media_items=(rows, "id long, file_size long, duration_secs double"))
    got = {r["id"]: (r["size_label"], r["duration_label"]) for r in library.QUERIES["item_labels"](spark, d).collect()}
    assert got == {1: ("2 KB", None), 2: ("3.0 MB", None), 3: ("10 B", "2:05"), 4: ("0 B", None)}
    assert spark_rows(library.QUERIES["item_labels"](spark, d)) == duck_rows(connect(d), library.SQL["item_labels"])


def test_screenshots_without_a_blur_score(spark, tmp_path):
    nan = float("nan")
    rows = [(1, "image/png", None, 0.7, 5), (2, "image/png", nan, 0.6, None), (3, "IMAGE/heic", 50.0, nan, 5), (4, "image/jpeg", 70.0, None, 5), (5, "video/mp4", 50.0, 0.9, 5)]
    d = _tables(spark, tmp_path, media_items=(rows, "id long, mime_type string, blur_score double, screenshot_heuristic double, file_size long"))
    got = {tuple(r) for r in library.QUERIES["review_candidates"](spark, d).collect()}
    assert got == {(1, False, True, 5), (2, False, True, 0), (3, True, False, 5), (4, False, False, 5)}
    assert spark_rows(library.QUERIES["review_candidates"](spark, d)) == duck_rows(connect(d), library.SQL["review_candidates"])


def test_group_items_image_sort_and_thumbnail_windows(spark, tmp_path):
    nan, old = float("nan"), "2020-01-01"
    rows = [
        (1, "image/png", "indexed", 1, "b", 5, nan), (2, "image/png", "excluded", 1, "b", 9, 1.0), (3, "image/png", "excluded", 1, None, None, 2.0), (4, "image/png", "grouped", 1, "a", 5, 1.0),
        (5, "image/png", "indexed", 2, None, 5, 0.5), (6, "image/png", None, 1, "a", 5, 1.0), (7, "image/png", "image_reviewed", None, "a", 7, None), (8, None, "filed", 1, "b", 1, None),
    ]
    rows += [(100 + i, "image/png", "indexed", None, f"c{i:02d}", 0, 0.0) for i in range(25)] + [(200 + i, "video/mp4", "video_reviewed", None, old, i << 20, None) for i in range(25)]
    schema = "id long, mime_type string, status string, event_group_id long, date_taken string, file_size long, sharpness_score double"
    names = ", filename string, current_path string"
    done = [(5,), (101,), (202,), (202,), (None,)]
    d = _tables(spark, tmp_path, media_items=([(*r, "f", "p") for r in rows], schema + names), date_estimate=(done, "media_item_id long"))
    got = [(r["excluded"], r["id"], r["mime_type"]) for r in library.QUERIES["group_items"](spark, d).collect()]
    assert got == [(False, 4, "image/png"), (False, 1, "image/png"), (False, 8, ""), (True, 3, "image/png"), (True, 2, "image/png")]
    at = {}
    for r in library.QUERIES["image_sort"](spark, d).orderBy("pos").collect():
        at.setdefault((r["mode"], r["excluded"]), []).append(r["id"])
    rest = [100 + i for i in range(25)]
    assert at[("date", False)] == [5, 7, 1, *rest] and at[("size", False)] == [7, 5, 1, *rest] and at[("sharpness", False)] == [5, 7, 1, *rest]
    assert at[("date", True)] == [3, 2] and at[("size", True)] == [2, 3] and at[("sharpness", True)] == [3, 2]
    got = {}
    for r in library.QUERIES["thumbnail_windows"](spark, d).collect():
        got.setdefault(r["kind"], []).append(r["id"])
    assert got == {"image": [7, 1, 100, *range(102, 119)], "video": [200, 201, *range(203, 213)]}
    for name in ("group_items", "image_sort", "thumbnail_windows"):
        assert spark_rows(library.QUERIES[name](spark, d)) == duck_rows(connect(d), library.SQL[name])


def test_video_fields_come_each_from_its_first_record(spark, tmp_path):
    nan = float("nan")
    items = [(1, "video/mp4", None, None, None, None), (2, "video/mp4", 5, None, "own", 3.0), (3, "video/mp4", None, None, None, nan), (4, "image/png", None, None, None, None), (5, "VIDEO/mp4", None, None, None, None)]
    # the item's records in falling order; of video 1 none has all fields
    records = [(9, 1, 99, 99, "z", 99.0), (8, 1, None, None, "hvc1", None), (7, 1, None, 20, None, 2.5), (6, 1, 10, None, None, nan), (5, 2, 1, 2, "x", 4.0), (4, 3, None, None, None, nan), (3, None, 1, 1, "n", 1.0)]
    tail = "width long, height long, video_codec string, duration_secs double"
    d = _tables(
        spark, tmp_path, media_items=(items, "id long, mime_type string, video_width long, video_height long, video_codec string, duration_secs double"),
        metadata_info=(records, "record_id long, media_item_id long, " + tail),
    )
    got = {tuple(r) for r in library.QUERIES["video_fields"](spark, d).collect()}
    assert got == {(1, 10, 20, "hvc1", 2.5), (2, 5, 2, "own", 3.0), (3, None, None, None, 0.0), (5, None, None, None, 0.0)}
    assert spark_rows(library.QUERIES["video_fields"](spark, d)) == duck_rows(connect(d), library.SQL["video_fields"])


def sampled(cluster):
    """Ids of the reference's sample of one cluster of (time, id, filename)."""
    kept = []
    for at, i, name in sorted(cluster):
        stem = name.rpartition(".")[0].lower().rstrip("0123456789_- ")
        if not any(stem == s and int((at - t).total_seconds()) <= 5 for t, _, s in kept):
            kept.append((at, i, stem))
    last = len(kept) - 1
    return {kept[p][1] for p in (range(len(kept)) if last < 10 else {int(k * last / 9 + 0.5) for k in range(10)})}


def test_samples_are_taken_from_the_thinned_cluster(spark, tmp_path):
    rng = random.Random(6)
    at, rows = datetime(2024, 5, 1), []
    for i in range(160):
        at += timedelta(seconds=rng.choice([1, 2, 3, 5, 6, 40, 20_000])) + timedelta(days=4 * (i in (40, 120)))
        rows.append((at, i, rng.choice(["IMG_", "DSC "]) + f"{i}.jpg"))
    rows += [(datetime(2025, 5, 1, 10, 0, k), 1000 + k, f"IMG_{k}.jpg") for k in range(12)]
    table = [(i, name, "a", 1.0, "0", t.isoformat(sep=" ")) for t, i, name in rows]
    d = _tables(spark, tmp_path, media_items=(table, "id long, filename string, source_device string, blur_score double, perceptual_hash string, date_taken string"))
    cuts = [rows[:40], rows[40:120], rows[120:160], rows[160:]]
    got = {r["id"] for r in library.QUERIES["cluster_samples"](spark, d).collect()}
    assert got == set().union(*map(sampled, cuts)) and got & {r[1] for r in rows[160:]} == {1000, 1006}
    assert got != {r["id"] for r in library.QUERIES["even_samples"](spark, d).collect()}


def test_thinning_keeps_items_without_a_name(spark):
    rows = [(1, "IMG_1.jpg", 0), (2, None, 1), (3, None, 2), (4, "IMG_2.jpg", 3), (5, None, None), (6, "IMG_3.jpg", None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, n string, s long, g int")
    df = df.withColumn("at", F.timestamp_seconds("s").cast("timestamp_ntz"))
    got = clusters.thin_near_duplicates(df, ["g"], "at", "id", text.filename_prefix(F.col("n")))
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == [1, 2, 3]


def test_groups_are_created_renamed_and_deleted(spark):
    g = spark.createDataFrame([(1, 2020, " Trip", "2020 -  Trip"), (2, 2021, "Misc", "2021 - Misc"), (3, 2022, None, None)], "id long, event_year int, group_name string, folder_name string")
    wanted = spark.createDataFrame([(2025, " new "), (2024, "NEW"), (2020, "trip"), (2020, " "), (2020, None)], "event_year int, group_name string")
    assert [tuple(r) for r in lifecycle.created_groups(g, wanted).collect()] == [(2024, "NEW", "2024 - NEW")]
    names = spark.createDataFrame([(1, "TRIP"), (2, "trip "), (3, "Snow"), (9, "x")], "id long, new_name string")
    got = {r["id"]: (r["group_name"], r["folder_name"]) for r in lifecycle.renamed_groups(g, names).collect()}
    assert got == {1: (" Trip", "2020 -  Trip"), 2: ("Misc", "2021 - Misc"), 3: ("Snow", "2022 - Snow")}
    items = spark.createDataFrame([(1, "grouped"), (2, "excluded"), (None, "grouped")], "event_group_id long, status string")
    left = lifecycle.deleted_groups(g, items, spark.createDataFrame([(1,), (2,)], "id long"))
    assert sorted(r["id"] for r in left.collect()) == [1, 3]


def test_best_shots_follow_answers_of_members(spark):
    members = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "g string, i long")
    sharpest = spark.createDataFrame([("a", 1), ("b", 3)], "g string, i long")
    answers = spark.createDataFrame([("a", 2), ("b", 1), ("c", 4)], "g string, i long")
    assert {tuple(r) for r in bursts.best_shots(sharpest, members, answers, "g", "i").collect()} == {("a", 2), ("b", 3)}
