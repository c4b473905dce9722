"""Queries of the photo library's own operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotomill.functions import dates, geo, hashes, media, payloads, text
from fotomill.operators import bursts, clusters, duplicates, kernels, lifecycle, locations, naming, ordering
from fotomill.session import table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that must give the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _media(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "media_items")


# -- shared pieces of SQL ----------------------------------------------------------------------------------------------

_AT = r"""CASE WHEN regexp_full_match(date_taken, '\d{4}-\d{2}-\d{2}( \d{2}:\d{2}:\d{2}|T\d{2}:\d{2}:\d{2}(\.\d+)?)') THEN try_cast(date_taken AS TIMESTAMP)
  WHEN regexp_full_match(date_taken, '\d{4}-\d{2}-\d{2}') THEN try_cast(date_taken AS TIMESTAMP) + INTERVAL 12 HOUR END"""
_ITEMS = f"items AS (SELECT id, filename, source_device, blur_score, perceptual_hash, {_AT} AS ts FROM media_items)"
_CLUSTERS = f"""{_ITEMS}
, flagged AS (SELECT *, year(ts)::INT AS event_year, CASE WHEN ts::DATE - lag(ts::DATE) OVER w > 2 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f
  FROM items WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY year(ts) ORDER BY ts, id))
, clustered AS (SELECT *, sum(f) OVER (PARTITION BY event_year ORDER BY ts, id)::INT AS cluster_no FROM flagged)"""
_SPLIT = f"""{_CLUSTERS}
, gaps AS (SELECT *, date_sub('second', lag(ts) OVER w, ts) AS gap, row_number() OVER w AS pos FROM clustered
  WINDOW w AS (PARTITION BY event_year, cluster_no ORDER BY ts, id))
, cuts AS (SELECT event_year, cluster_no, max(ts::DATE) - min(ts::DATE) AS days, max(gap) AS top FROM gaps GROUP BY ALL)
, first_cut AS (SELECT g.event_year, g.cluster_no, min(pos) AS cut FROM gaps g JOIN cuts c USING (event_year, cluster_no) WHERE gap = top AND days > 14 GROUP BY ALL)
, parts AS (SELECT g.*, CASE WHEN pos >= cut THEN 1 ELSE 0 END AS part_no FROM gaps g LEFT JOIN first_cut USING (event_year, cluster_no))"""
_STATS = f"""{_SPLIT}
, stats AS (SELECT event_year, cluster_no, part_no, count(*) AS item_count, min(ts::DATE) AS start_date, max(ts::DATE) AS end_date,
  (max(ts::DATE) - min(ts::DATE) + 1)::BIGINT AS duration_days, count(DISTINCT ts::DATE) AS distinct_days,
  bool_or(month(ts) = 12 AND day(ts) >= 20) AS is_holiday FROM parts GROUP BY event_year, cluster_no, part_no)"""
# The items that are ready to be grouped.
_READY = "status = 'date_verified' AND coalesce(date_needs_review, 0) = 0"
_READY_STATS = _STATS.replace("FROM media_items)", f"FROM media_items WHERE {_READY})")
_OFFLINE = "CASE WHEN away AND place IS NOT NULL THEN place || ' Trip' ELSE monthname(start_date) || ' Activities' END"
# Over `described`: the clusters' facts with what was suggested for them (s_*), away and place.
_NAMING = f"""suggested AS (SELECT *, event_year::VARCHAR || ' - ' AS y,
  CASE WHEN item_count < 3 THEN 'small' WHEN is_holiday AND NOT coalesce(CASE WHEN has_s THEN lower(s_confidence) = 'high' ELSE false END, false) THEN 'holiday' WHEN has_s THEN 'given' ELSE 'offline' END AS way FROM described)
, chosen AS (SELECT *, CASE way WHEN 'small' THEN y || 'Misc' WHEN 'holiday' THEN y || 'Family Christmas' WHEN 'given' THEN CASE WHEN coalesce(trim(s_name), '') = '' THEN y || 'Misc' ELSE s_name END ELSE y || {_OFFLINE} END AS suggested_name,
  CASE way WHEN 'small' THEN 'medium' WHEN 'holiday' THEN 'high' WHEN 'given' THEN s_confidence ELSE 'low' END AS confidence,
  CASE way WHEN 'small' THEN 'misc' WHEN 'holiday' THEN 'holiday' WHEN 'given' THEN s_type ELSE 'misc' END AS event_type FROM suggested)
, rewritten AS (SELECT *, CASE WHEN lower(confidence) = 'low' AND lower(event_type) = 'misc' THEN y || CASE WHEN away AND place IS NOT NULL THEN place || ' Trip' ELSE monthname(start_date) || ' Memories' END
  ELSE trim(suggested_name) END AS base_name FROM chosen)
, named AS (SELECT *, CASE WHEN event_type IS NOT NULL THEN lower(event_type) = 'misc' ELSE lower(CASE WHEN starts_with(base_name, y) THEN substr(base_name, length(y) + 1) ELSE base_name END) = 'misc' END::INT AS is_misc FROM rewritten)"""
_NAMES = f"""{_READY_STATS}
, described AS (SELECT *, false AS has_s, NULL::VARCHAR AS s_name, NULL::VARCHAR AS s_confidence, NULL::VARCHAR AS s_type, false AS away, NULL::VARCHAR AS place FROM stats)
, {_NAMING}
, ranked AS (SELECT *, row_number() OVER (PARTITION BY event_year, lower(base_name) ORDER BY cluster_no DESC, part_no DESC) AS n FROM named)
, folders AS (SELECT *, CASE n WHEN 1 THEN base_name WHEN 2 THEN base_name || ' (Early)' WHEN 3 THEN base_name || ' (Late)' ELSE base_name || ' ' || (n - 2)::VARCHAR END AS folder_name FROM ranked)"""


def _items(spark: SparkSession, d: str, ready: bool = False) -> DataFrame:
    m = _ready(_media(spark, d)) if ready else _media(spark, d)
    return m.select("id", "filename", "source_device", "blur_score", "perceptual_hash", dates.capture_time(F.col("date_taken")).alias("at"))


def _ready(media: DataFrame) -> DataFrame:
    """Items whose date is verified and not up for review."""
    return media.filter((F.col("status") == "date_verified") & (F.coalesce("date_needs_review", F.lit(0)) == 0))


def _parts(spark: SparkSession, d: str, ready: bool = False) -> DataFrame:
    items = _items(spark, d, ready)
    return clusters.split_long_spans(clusters.day_clusters(items, "at"), "at")


_GROUP = ["event_year", "cluster_no", "part_no"]


# -- dashboard, counts and groups --------------------------------------------------------------------------------------


@query("""SELECT count(*) AS total, count(*) FILTER (WHERE status = 'indexed') AS indexed,
 count(*) FILTER (WHERE status = 'indexed' AND coalesce(image_flags, '') NOT IN ('', '[]')) AS image_review, count(*) FILTER (WHERE status = 'image_reviewed') AS image_verified,
 count(*) FILTER (WHERE status = 'image_reviewed' AND date_needs_review = 1) AS date_review, count(*) FILTER (WHERE date_needs_review = 1) AS date_needs_review,
 count(*) FILTER (WHERE status = 'date_verified') AS date_verified, count(*) FILTER (WHERE status = 'grouped') AS grouped, count(*) FILTER (WHERE status = 'filed') AS filed,
 count(*) FILTER (WHERE mime_type ILIKE 'video/%' AND status IN ('image_reviewed','video_reviewed','date_verified','excluded','grouped','filed')) AS video_total,
 count(*) FILTER (WHERE mime_type ILIKE 'video/%' AND status = 'excluded') AS video_excluded,
 count(*) FILTER (WHERE mime_type ILIKE 'video/%' AND status = 'image_reviewed' AND (coalesce(file_size, 0) <= 5242880 OR coalesce(duration_secs, 0) <= 10)) AS video_flagged
 FROM media_items""")
def dashboard_counts(spark, d):
    """All counters in one pass."""
    s, video = F.col("status"), F.col("mime_type").ilike("video/%")
    flags = F.coalesce("image_flags", F.lit(""))
    low = (F.coalesce("file_size", F.lit(0)) <= 5 * 1024 * 1024) | (F.coalesce("duration_secs", F.lit(0.0)) <= 10)
    counted = {
        "indexed": s == "indexed", "image_review": (s == "indexed") & ~flags.isin("", "[]"), "image_verified": s == "image_reviewed",
        "date_review": (s == "image_reviewed") & (F.col("date_needs_review") == 1), "date_needs_review": F.col("date_needs_review") == 1,
        "date_verified": s == "date_verified", "grouped": s == "grouped", "filed": s == "filed",
        "video_total": video & s.isin("image_reviewed", "video_reviewed", "date_verified", "excluded", "grouped", "filed"),
        "video_excluded": video & (s == "excluded"), "video_flagged": video & (s == "image_reviewed") & low,
    }
    return _media(spark, d).agg(F.count("*").alias("total"), *[F.count_if(c).alias(k) for k, c in counted.items()])


@query("""SELECT g.id AS group_id, g.item_count AS recorded, count(m.id) AS item_count FROM event_groups g
 LEFT JOIN media_items m ON m.event_group_id = g.id AND m.status <> 'excluded' GROUP BY ALL""")
def group_item_counts(spark, d):
    g = table(spark, d, "event_groups").select(F.col("id").alias("group_id"), F.col("item_count").alias("recorded"))
    return lifecycle.with_counts(g, _media(spark, d), "group_id", "event_group_id", F.col("status") != "excluded", "item_count")


@query("SELECT DISTINCT event_group_id FROM media_items WHERE event_group_id IS NOT NULL AND id IN (SELECT media_item_id FROM date_estimate)")
def distinct_groups(spark, d):
    """Groups touched by a set of items."""
    ids = table(spark, d, "date_estimate").select(F.col("media_item_id").alias("id"))
    return _media(spark, d).join(ids, "id", "left_semi").filter("event_group_id IS NOT NULL").select("event_group_id").distinct()


@query("""SELECT event_group_id, try_cast(substr(arg_min(date_taken, (date_taken, id)), 1, 4) AS INT) AS event_year FROM media_items
 WHERE event_group_id IS NOT NULL AND try_cast(substr(date_taken, 1, 4) AS INT) IS NOT NULL AND regexp_full_match(substr(date_taken, 1, 4), '\\d{4}') GROUP BY 1""")
def group_years(spark, d):
    """Year of the first dated item of each group."""
    year = F.when(F.substring("date_taken", 1, 4).rlike(r"^\d{4}$"), F.substring("date_taken", 1, 4).try_cast("int"))
    m = _media(spark, d).withColumn("y", year).filter("y IS NOT NULL AND event_group_id IS NOT NULL")
    return m.groupBy("event_group_id").agg(F.min_by("y", F.struct("date_taken", "id")).alias("event_year"))


@query("""SELECT lower(trim(burst_group_id)) AS burst, list(id ORDER BY date_taken NULLS FIRST, id) AS ids FROM media_items
 WHERE status <> 'excluded' AND trim(burst_group_id) <> '' GROUP BY 1""")
def burst_listing(spark, d):
    """Members of each burst in order; a burst is as small as a camera's series."""
    b = F.lower(F.trim("burst_group_id"))
    m = _media(spark, d).filter((F.col("status") != "excluded") & (b != "")).select(b.alias("burst"), "date_taken", "id")
    xs = F.sort_array(F.collect_list(F.struct(F.col("date_taken").alias("t"), F.col("id").alias("i"))))
    return m.groupBy("burst").agg(F.transform(xs, lambda x: x["i"]).alias("ids"))


@query("""SELECT lower(trim(burst_group_id)) AS burst, arg_max(id, (coalesce(CASE WHEN isnan(blur_score) THEN NULL ELSE blur_score END, 0.0), id)) AS primary_id
 FROM media_items WHERE trim(burst_group_id) <> '' GROUP BY 1""")
def burst_primaries(spark, d):
    """The sharpest of each burst, of equals the last."""
    b = F.lower(F.trim("burst_group_id"))
    score = F.coalesce(F.when(~F.isnan("blur_score"), F.col("blur_score")), F.lit(0.0))
    m = _media(spark, d).select(F.when(b != "", b).alias("burst"), "id", score.alias("score"))
    return bursts.best_of_groups(m, "burst", "id", ["score"]).withColumnRenamed("id", "primary_id")


@query("""SELECT mime_type, round(avg(b), 4) AS mean_blur, round(var_pop(b), 2) AS var_blur, round(stddev_pop(e), 4) AS std_exposure, round(avg(CASE WHEN e <= 90 THEN 1.0 ELSE 0.0 END), 6) AS dark_share
 FROM (SELECT lower(mime_type) AS mime_type, CASE WHEN NOT isnan(blur_score) AND blur_score >= 0 THEN blur_score END AS b, exposure_mean AS e FROM media_items WHERE exposure_mean IS NOT NULL AND NOT isnan(exposure_mean)) GROUP BY 1""")
def score_moments(spark, d):
    m = _media(spark, d).filter("exposure_mean IS NOT NULL AND NOT isnan(exposure_mean)")
    b = F.when(~F.isnan("blur_score") & (F.col("blur_score") >= 0), F.col("blur_score"))
    m = m.select(F.lower("mime_type").alias("mime_type"), b.alias("b"), F.col("exposure_mean").alias("e"))
    return m.groupBy("mime_type").agg(
        F.round(F.avg("b"), 4).alias("mean_blur"), F.round(F.var_pop("b"), 2).alias("var_blur"), F.round(F.stddev_pop("e"), 4).alias("std_exposure"),
        F.round(F.avg(F.when(F.col("e") <= 90, 1.0).otherwise(0.0)), 6).alias("dark_share"),
    )


@query("""SELECT status, count(*) FILTER (WHERE coalesce(image_flags, '[]') NOT IN ('', '[]')) AS flagged, count(*) FILTER (WHERE coalesce(image_flags, '[]') IN ('', '[]')) AS unflagged FROM media_items GROUP BY 1""")
def flag_counts(spark, d):
    empty = F.coalesce("image_flags", F.lit("[]")).isin("", "[]")
    return _media(spark, d).groupBy("status").agg(F.count_if(~empty).alias("flagged"), F.count_if(empty).alias("unflagged"))


# -- queues, filters and views -----------------------------------------------------------------------------------------

_FLAGS_SQL = "CASE WHEN json_valid(image_flags) AND json_type(image_flags) = 'ARRAY' THEN from_json(image_flags, '[\"VARCHAR\"]') ELSE [] END"


@query("""WITH j AS (SELECT id, filename, CASE WHEN json_valid(ai_date_estimate_raw) THEN ai_date_estimate_raw END AS e FROM media_items WHERE date_needs_review = 1)
 SELECT id, filename, e ->> '$.ai_date' AS ai_date, CASE WHEN json_type(e, '$.confidence') IN ('DOUBLE','UBIGINT','BIGINT') THEN (e ->> '$.confidence')::DOUBLE ELSE 0.0 END AS confidence,
 coalesce(e ->> '$.reasoning', 'Awaiting AI estimation') AS reasoning FROM j""")
def date_review_queue(spark, d):
    e = payloads.date_estimate(F.col("ai_date_estimate_raw"))
    return _media(spark, d).filter("date_needs_review = 1").select("id", "filename", e.alias("e")).select("id", "filename", "e.*").orderBy("id")


@query(f"SELECT id, filename, {_FLAGS_SQL} AS flags FROM media_items WHERE mime_type ILIKE 'image/%' AND status IN ('indexed', 'image_reviewed')")
def image_review_queue(spark, d):
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%") & F.col("status").isin("indexed", "image_reviewed"))
    return m.orderBy(F.asc_nulls_first("date_taken"), "id").select("id", "filename", payloads.string_list(F.col("image_flags")).alias("flags"))


@query("""SELECT id, coalesce(file_size, 0) AS file_size, coalesce(duration_secs, 0.0) AS duration_secs FROM media_items
 WHERE mime_type ILIKE 'video/%' AND status IN ('image_reviewed', 'video_reviewed')""")
def video_review_queue(spark, d):
    m = _media(spark, d).filter(F.col("mime_type").ilike("video/%") & F.col("status").isin("image_reviewed", "video_reviewed"))
    m = m.orderBy(F.asc_nulls_first("date_taken"), "id")
    return m.select("id", F.coalesce("file_size", F.lit(0)).alias("file_size"), F.coalesce("duration_secs", F.lit(0.0)).alias("duration_secs"))


@query("""SELECT 'size' AS mode, id FROM media_items WHERE mime_type ILIKE 'video/%' AND status <> 'excluded' AND file_size <= 20971520
 UNION ALL SELECT 'duration', id FROM media_items WHERE mime_type ILIKE 'video/%' AND status <> 'excluded' AND duration_secs <= 15""")
def video_threshold_views(spark, d):
    """Short or small videos, by either mode, smallest first."""
    v = _media(spark, d).filter(F.col("mime_type").ilike("video/%") & (F.col("status") != "excluded"))
    size, seconds = F.col("file_size"), F.col("duration_secs")
    modes = F.array(
        F.when(size <= 20 * 1024 * 1024, F.struct(F.lit("size").alias("mode"), size.cast("double").alias("key"))),
        F.when(seconds <= 15, F.struct(F.lit("duration").alias("mode"), seconds.alias("key"))),
    )
    rows = v.select("id", F.explode(F.filter(modes, lambda x: x.isNotNull())).alias("m"))
    return rows.select("m.mode", "id", "m.key").orderBy("mode", "key", "id").select("mode", "id")


@query(f"""WITH v AS (SELECT id, {_FLAGS_SQL} AS f, duplicate_group_id AS dup, burst_group_id AS b FROM media_items WHERE status <> 'excluded' AND mime_type ILIKE 'image/%')
 SELECT id, len(f) > 0 AS flagged, dup IS NOT NULL AS duplicate, list_contains(f, 'screenshot_or_meme') AS screenshot, b IS NOT NULL AS burst FROM v""")
def image_view_modes(spark, d):
    m = _media(spark, d).filter((F.col("status") != "excluded") & F.col("mime_type").ilike("image/%"))
    f = payloads.string_list(F.col("image_flags"))
    return m.select(
        "id", (F.size(f) > 0).alias("flagged"), F.col("duplicate_group_id").isNotNull().alias("duplicate"),
        F.array_contains(f, "screenshot_or_meme").alias("screenshot"), F.col("burst_group_id").isNotNull().alias("burst"),
    )


@query("""SELECT id, blur_score BETWEEN 40 AND 60 AS borderline, coalesce(screenshot_heuristic >= 0.6 AND NOT isnan(screenshot_heuristic), false) AS screenshot_candidate, coalesce(file_size, 0) AS file_size
 FROM media_items WHERE mime_type ILIKE 'image/%' AND status = 'indexed'""")
def scan_candidates(spark, d):
    """Images still to be scanned: whether the blur score, if any, is borderline, and whether they may be screenshots."""
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%") & (F.col("status") == "indexed"))
    shot = F.coalesce((F.col("screenshot_heuristic") >= 0.6) & ~F.isnan("screenshot_heuristic"), F.lit(False))
    return m.select("id", F.col("blur_score").between(50 * 0.8, 50 * 1.2).alias("borderline"), shot.alias("screenshot_candidate"), F.coalesce("file_size", F.lit(0)).alias("file_size"))


@query("""SELECT id, coalesce(blur_score BETWEEN 40 AND 60, false) AS borderline, coalesce(screenshot_heuristic >= 0.6 AND NOT isnan(screenshot_heuristic), false) AS screenshot_candidate, coalesce(file_size, 0) AS file_size
 FROM media_items WHERE mime_type ILIKE 'image/%'""")
def review_candidates(spark, d):
    """Every image: whether its blur score is borderline (not without a usable one), and whether it may be a screenshot, whatever its blur."""
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%"))
    shot = F.coalesce((F.col("screenshot_heuristic") >= 0.6) & ~F.isnan("screenshot_heuristic"), F.lit(False))
    borderline = F.coalesce(F.col("blur_score").between(50 * 0.8, 50 * 1.2), F.lit(False))
    return m.select("id", borderline.alias("borderline"), shot.alias("screenshot_candidate"), F.coalesce("file_size", F.lit(0)).alias("file_size"))


@query("SELECT a.id, a.group_name FROM event_groups a WHERE EXISTS (SELECT 1 FROM event_groups b WHERE lower(trim(a.group_name)) = lower(trim(b.group_name)) AND a.id <> b.id)")
def name_exists(spark, d):
    """Groups whose name another group has; counted per name, so that a common name is no quadratic join."""
    g = table(spark, d, "event_groups").select("id", "group_name", text.normalise_name(F.col("group_name")).alias("k"))
    shared = g.groupBy("k").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).filter("lo < hi").select("k")
    return g.join(shared, "k", "left_semi").select("id", "group_name")


@query("SELECT id, date_taken FROM media_items WHERE date_taken IS NULL OR trim(date_taken) = '' OR starts_with(date_taken, '1970:01:01') OR starts_with(date_taken, '0000:00:00')")
def invalid_dates(spark, d):
    t = F.col("date_taken")
    return _media(spark, d).filter(t.isNull() | (F.trim(t) == "") | dates.is_invalid_date(t)).select("id", "date_taken")


@query("""SELECT id, CASE WHEN event_group_id IS NOT NULL THEN 'grouped' WHEN mime_type ILIKE 'video/%' THEN 'image_reviewed' ELSE 'indexed' END AS restored FROM media_items WHERE status = 'excluded'""")
def restore_status(spark, d):
    to = F.when(F.col("event_group_id").isNotNull(), "grouped").when(F.col("mime_type").ilike("video/%"), "image_reviewed").otherwise("indexed")
    return _media(spark, d).filter("status = 'excluded'").select("id", to.alias("restored"))


@query("""SELECT action_name, CASE WHEN action_name IN ('queued','indexed','image_reviewed','video_reviewed','date_verified','grouped','filed','excluded') THEN action_name
 WHEN action_name IN ('downloading','downloaded','metadata_extracted','date_review_pending','error') THEN 'indexed' ELSE 'queued' END AS status, count(*) AS n FROM audit_log GROUP BY ALL""")
def status_remap(spark, d):
    a = table(spark, d, "audit_log")
    return a.groupBy("action_name", text.remap_status(F.col("action_name")).alias("status")).agg(F.count("*").alias("n"))


# -- joins, listings and pages -----------------------------------------------------------------------------------------


@query("""SELECT m.id, 'organized/' || g.event_year::VARCHAR || '/' || g.folder_name || '/' || CASE WHEN row_number() OVER (PARTITION BY g.event_year, g.folder_name, m.filename ORDER BY m.id) > 1
 THEN m.id::VARCHAR || '_' ELSE '' END || m.filename AS target_path FROM media_items m JOIN event_groups g ON g.id = m.event_group_id WHERE m.status = 'grouped'""")
def target_paths(spark, d):
    """Where grouped items are filed; equal names in a folder are told apart."""
    g = table(spark, d, "event_groups").select(F.col("id").alias("event_group_id"), F.col("event_year").alias("y"), "folder_name")
    m = _media(spark, d).filter("status = 'grouped'").select("id", "filename", "event_group_id").join(g, "event_group_id")
    folder = F.concat(F.lit("organized/"), F.col("y").cast("string"), F.lit("/"), F.col("folder_name"))
    return lifecycle.target_paths(m, folder, "filename", "id").select("id", "target_path")


@query("""WITH r AS (SELECT id, filename, row_number() OVER (PARTITION BY filename ORDER BY id) - 1 AS n FROM media_items)
 SELECT id, CASE WHEN n = 0 THEN filename ELSE regexp_extract(filename, '^(.*?)(\\.[^.]*)?$', 1) || '_' || CASE WHEN n <= 9999 THEN n::VARCHAR ELSE 'overflow' END || regexp_extract(filename, '^(.*?)(\\.[^.]*)?$', 2) END AS unique_name FROM r""")
def numbered_names(spark, d):
    return lifecycle.numbered_paths(_media(spark, d).select("id", "filename"), "filename", "id").select("id", "unique_name")


@query("SELECT id, event_year, group_name, item_count FROM event_groups")
def group_listing(spark, d):
    return table(spark, d, "event_groups").orderBy(F.desc("event_year"), "group_name").select("id", "event_year", "group_name", "item_count")


@query("""SELECT status = 'excluded' AS excluded, id, filename, current_path, date_taken, coalesce(mime_type, '') AS mime_type FROM media_items WHERE event_group_id = 1 AND status IS NOT NULL""")
def group_items(spark, d):
    """The items of group 1, those not excluded and then the excluded ones, each by date and id."""
    m = _media(spark, d).filter("event_group_id = 1 AND status IS NOT NULL").withColumn("excluded", F.col("status") == "excluded")
    m = m.orderBy("excluded", F.asc_nulls_first("date_taken"), "id")
    return m.select("excluded", "id", "filename", "current_path", "date_taken", F.coalesce("mime_type", F.lit("")).alias("mime_type"))


@query("""WITH i AS (SELECT id, date_taken, status = 'excluded' AS excluded, coalesce(file_size, 0) AS size, CASE WHEN NOT isnan(sharpness_score) THEN sharpness_score ELSE 0.0 END AS sharp
  FROM media_items WHERE mime_type ILIKE 'image/%' AND status IN ('indexed', 'image_reviewed', 'excluded'))
 SELECT 'date' AS mode, excluded, row_number() OVER (PARTITION BY excluded ORDER BY coalesce(date_taken, ''), date_taken NULLS FIRST, id) - 1 AS pos, id FROM i
 UNION ALL SELECT 'size', excluded, row_number() OVER (PARTITION BY excluded ORDER BY size DESC, date_taken NULLS FIRST, id) - 1, id FROM i
 UNION ALL SELECT 'sharpness', excluded, row_number() OVER (PARTITION BY excluded ORDER BY sharp DESC, date_taken NULLS FIRST, id) - 1, id FROM i""")
def image_sort(spark, d):
    """Place of each image of the review, excluded ones apart, by date, by size or by sharpness (0 where unknown); of equals the queue's order."""
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%") & F.col("status").isin("indexed", "image_reviewed", "excluded"))
    sharp = F.coalesce(F.when(~F.isnan("sharpness_score"), F.col("sharpness_score")), F.lit(0.0))
    falling = {"date": F.lit(0.0), "size": -F.coalesce("file_size", F.lit(0)).cast("double"), "sharpness": -sharp}
    modes = F.array(*[F.struct(F.lit(k).alias("mode"), v.alias("key")) for k, v in falling.items()])
    m = m.select("id", "date_taken", (F.col("status") == "excluded").alias("excluded"), F.inline(modes))
    return ordering.position_in_group(m, ["mode", "excluded"], ["key", "date_taken", "id"]).select("mode", "excluded", "pos", "id")


@query("""WITH todo AS (SELECT * FROM media_items WHERE id NOT IN (SELECT media_item_id FROM date_estimate WHERE media_item_id IS NOT NULL))
 (SELECT 'image' AS kind, id FROM todo WHERE mime_type ILIKE 'image/%' AND status IN ('indexed', 'image_reviewed') ORDER BY date_taken NULLS FIRST, id LIMIT 20)
 UNION ALL (SELECT 'video', id FROM todo WHERE mime_type ILIKE 'video/%' AND status IN ('image_reviewed', 'video_reviewed') AND coalesce(file_size, 0) <= 20971520 ORDER BY coalesce(file_size, 0), date_taken NULLS FIRST, id LIMIT 12)""")
def thumbnail_windows(spark, d):
    """The next images, by date, and small videos, by size, that lack a thumbnail; items with a date estimate stand in for those that have one."""
    m, done = _media(spark, d), table(spark, d, "date_estimate").select(F.col("media_item_id").alias("id"))
    size, shown = F.coalesce("file_size", F.lit(0)), [F.asc_nulls_first("date_taken"), F.col("id")]
    images = m.filter(F.col("mime_type").ilike("image/%") & F.col("status").isin("indexed", "image_reviewed"))
    videos = m.filter(F.col("mime_type").ilike("video/%") & F.col("status").isin("image_reviewed", "video_reviewed") & (size <= 20 * 1024 * 1024))
    images, videos = ordering.work_window(images, done, "id", shown, 20), ordering.work_window(videos, done, "id", [size, *shown], 12)
    return images.select(F.lit("image").alias("kind"), "id").unionByName(videos.select(F.lit("video").alias("kind"), "id"))


@query("""WITH top AS (SELECT id AS g, row_number() OVER (ORDER BY item_count DESC, id) AS r FROM event_groups ORDER BY item_count DESC, id LIMIT 3)
 SELECT r::INT AS group_rank, m.id FROM media_items m JOIN top ON top.g = m.event_group_id WHERE mime_type ILIKE 'image/%' ORDER BY r, date_taken NULLS FIRST, m.id LIMIT 3""")
def top_group_pictures(spark, d):
    """The first three pictures of the three largest groups."""
    top = ordering.first_by_order(table(spark, d, "event_groups"), [F.desc("item_count"), F.col("id")], 3)
    rows = [(r["id"], k + 1) for k, r in enumerate(top.select("id").collect())]  # three rows: the feature's own limit
    ranks = spark.createDataFrame(rows, "event_group_id long, group_rank int")
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%")).join(F.broadcast(ranks), "event_group_id")
    return ordering.first_by_order(m, [F.col("group_rank"), F.asc_nulls_first("date_taken"), F.col("id")], 3).select("group_rank", "id")


@query("SELECT id FROM media_items WHERE status <> 'excluded' ORDER BY coalesce(file_size, 0) DESC, id OFFSET 40 LIMIT 20")
def page_slice(spark, d):
    """The third page of twenty, largest files first."""
    m = _media(spark, d).filter("status <> 'excluded'")
    return ordering.first_by_order(m, [F.desc(F.coalesce("file_size", F.lit(0))), F.col("id")], 20, skip=40).select("id")


@query("""SELECT event_year, greatest(1, floor(1000 / 180))::INT AS columns_n, ceil(count(*) / greatest(1, floor(1000 / 180)))::BIGINT AS rows_n,
 (ceil(count(*) / 5.0) * 5 - count(*))::BIGINT AS empty_slots FROM event_groups GROUP BY 1""")
def grid_layout(spark, d):
    """Rows and empty slots of a grid 1000 pixels wide with items of 180."""
    n, cols = F.count("*"), F.greatest(F.lit(1), F.floor(F.lit(1000 / 180)))
    g = table(spark, d, "event_groups").groupBy("event_year").agg(cols.cast("int").alias("columns_n"), F.ceil(n / cols).alias("rows_n"), n.alias("n"))
    return g.select("event_year", "columns_n", "rows_n", (F.col("rows_n") * F.col("columns_n") - F.col("n")).alias("empty_slots"))


@query("""WITH s AS (SELECT id, original_path, row_number() OVER (ORDER BY original_path NULLS FIRST, id) AS n FROM media_items)
 SELECT id, lpad(n::VARCHAR, greatest(5, length(n::VARCHAR))::INT, '0') || '-' || (SELECT filename FROM media_items m WHERE m.id = s.id) AS staged_name FROM s""")
def staged_names(spark, d):
    """File names numbered in path order, without sorting in one place."""
    m = ordering.global_ordinal(_media(spark, d).select("id", "original_path", "filename"), ["original_path", "id"])
    n = F.col("ordinal").cast("string")
    return m.select("id", F.concat(F.when(F.length(n) >= 5, n).otherwise(F.lpad(n, 5, "0")), F.lit("-"), "filename").alias("staged_name"))


@query("""WITH k AS (SELECT id, (date_taken, id) AS k, file_size FROM media_items WHERE date_taken IS NOT NULL)
, ends AS (SELECT min(k) AS lo, max(k) AS hi FROM (SELECT k FROM k ORDER BY file_size DESC NULLS LAST, id LIMIT 2))
SELECT id FROM k, ends WHERE k BETWEEN lo AND hi""")
def range_selection(spark, d):
    """Rows between the two largest recorded files in the order of date and id: bounds by two keys instead of numbering all rows."""
    m = _media(spark, d).filter("date_taken IS NOT NULL").select("id", F.struct("date_taken", "id").alias("k"), "file_size")
    ends = ordering.first_by_order(m, [F.desc_nulls_last("file_size"), F.col("id")], 2).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    return m.join(F.broadcast(ends), (F.col("k") >= F.col("lo")) & (F.col("k") <= F.col("hi"))).select("id")


@query("""SELECT id, CASE WHEN current_path IN (SELECT current_path FROM media_items WHERE file_size > 0) THEN current_path
 WHEN original_path IN (SELECT current_path FROM media_items WHERE file_size > 0) THEN original_path ELSE current_path END AS resolved_path FROM media_items""")
def resolved_paths(spark, d):
    m = _media(spark, d)
    listing = m.filter("file_size > 0").select("current_path")
    return lifecycle.resolve_paths(m.select("id", "current_path", "original_path"), [F.col("current_path"), F.col("original_path")], listing).select("id", "resolved_path")


@query("SELECT id, created_at FROM media_items WHERE created_at::TIMESTAMP BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-02-01'")
def listed_between(spark, d):
    from fotomill.sources.media import listed_between as between

    return between(_media(spark, d).select("id", "created_at"), "created_at", "2024-01-01", "2024-02-01")


# -- scalars -----------------------------------------------------------------------------------------------------------

_EXT = r"lower(regexp_extract(filename, '[^/]\.([^./]*)$', 1))"


@query(f"""SELECT id, {_EXT} AS ext, {_EXT} IN ('jpg','jpeg','png','heic','heif','gif','webp','bmp','tif','tiff','mp4','mov','m4v') AS supported,
 CASE {_EXT} WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'heic' THEN 'image/heic' WHEN 'heif' THEN 'image/heic' WHEN 'gif' THEN 'image/gif'
 WHEN 'webp' THEN 'image/webp' WHEN 'bmp' THEN 'image/bmp' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'mp4' THEN 'video/mp4' WHEN 'm4v' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime'
 ELSE 'application/octet-stream' END AS index_mime, CASE WHEN {_EXT} IN ('jpg','jpeg') THEN 'image/jpeg' WHEN {_EXT} IN ('png','webp','gif','bmp') THEN 'image/' || {_EXT} WHEN {_EXT} IN ('tif','tiff') THEN 'image/tiff'
 WHEN {_EXT} IN ('heic','heif') THEN 'image/heic' WHEN {_EXT} IN ('mp4','mov','m4v') THEN 'video/mp4' ELSE 'application/octet-stream' END AS display_mime,
 {_EXT} IN ('jpg','jpeg','png') AS copyable, {_EXT} IN ('jpg','jpeg','png','webp','gif','bmp') AS renderable FROM media_items""")
def media_types(spark, d):
    e = text.extension(F.col("filename"))
    return _media(spark, d).select(
        "id", e.alias("ext"), e.isin(text.MEDIA_EXTENSIONS).alias("supported"), text.mime_of(F.col("filename")).alias("index_mime"),
        text.mime_of(F.col("filename"), text.DISPLAY_MIME).alias("display_mime"), e.isin(text.COPYABLE).alias("copyable"), e.isin(text.RENDERABLE).alias("renderable"),
    )


@query(f"SELECT id, {_AT} AS taken_at FROM media_items")
def capture_parse(spark, d):
    return _media(spark, d).select("id", dates.capture_time(F.col("date_taken")).alias("taken_at"))


@query("""SELECT record_id, CASE WHEN substr(create_date, 5, 1) = ':' THEN replace(substr(create_date, 1, 10), ':', '-') ELSE create_date END AS day,
 CASE WHEN substr(create_date, 5, 1) = ':' THEN replace(substr(create_date, 1, 10), ':', '-') ELSE '2026-01-01' END AS legacy_day FROM metadata_info""")
def exif_days(spark, d):
    c = F.col("create_date")
    return table(spark, d, "metadata_info").select("record_id", dates.exif_day(c).alias("day"), dates.normalised_day(c, 2026).alias("legacy_day"))


@query(r"""SELECT id, rtrim(rtrim(trim(regexp_replace(ai_suggested_name, '[<>:"/\\|?*]', '-', 'g')), '.'), ' ') AS cleaned, event_year::VARCHAR || ' - ' || group_name AS with_year, lower(trim(group_name)) AS normal,
 CASE WHEN starts_with(folder_name, event_year::VARCHAR || ' - ') THEN substr(folder_name, length(event_year::VARCHAR) + 4) ELSE folder_name END AS without_year FROM event_groups""")
def group_names(spark, d):
    g = table(spark, d, "event_groups")
    return g.select(
        "id", text.sanitize_folder_name(F.col("ai_suggested_name")).alias("cleaned"), text.with_year(F.col("group_name"), F.col("event_year")).alias("with_year"),
        text.normalise_name(F.col("group_name")).alias("normal"), text.without_year(F.col("folder_name"), F.col("event_year")).alias("without_year"),
    )


@query(r"SELECT id, regexp_replace(regexp_replace(lower(filename), '\.[^.]*$', ''), '[0-9_\- ]+$', '') AS prefix FROM media_items")
def filename_prefixes(spark, d):
    return _media(spark, d).select("id", text.filename_prefix(F.col("filename")).alias("prefix"))


@query("""SELECT id, CASE WHEN file_size >= 1048576 THEN printf('%.1f', file_size / 1048576.0) || ' MB' WHEN file_size >= 1024 THEN floor(file_size / 1024.0 + 0.5)::BIGINT::VARCHAR || ' KB' ELSE file_size::VARCHAR || ' B' END AS size_label,
 floor(greatest(0, floor(duration_secs + 0.5)) / 60)::BIGINT::VARCHAR || ':' || lpad((greatest(0, floor(duration_secs + 0.5))::BIGINT % 60)::VARCHAR, 2, '0') AS duration_label
 FROM media_items WHERE duration_secs IS NOT NULL AND NOT isnan(duration_secs)""")
def size_labels(spark, d):
    """Labels of the items with a duration alone, as the SQL has them; item_labels has those of every item."""
    m = _media(spark, d).filter("duration_secs IS NOT NULL AND NOT isnan(duration_secs)")
    return m.select("id", text.format_bytes(F.col("file_size")).alias("size_label"), text.format_duration(F.col("duration_secs")).alias("duration_label"))


@query("""WITH m AS (SELECT id, coalesce(file_size, 0) AS b, CASE WHEN NOT isnan(duration_secs) THEN greatest(0, floor(duration_secs + 0.5))::BIGINT END AS s FROM media_items)
 SELECT id, CASE WHEN b >= 1048576 THEN printf('%.1f', b / 1048576.0) || ' MB' WHEN b >= 1024 THEN floor(b / 1024.0 + 0.5)::BIGINT::VARCHAR || ' KB' ELSE b::VARCHAR || ' B' END AS size_label,
 (s // 60)::VARCHAR || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS duration_label FROM m""")
def item_labels(spark, d):
    """Size of every item, pictures too, an unknown one as 0 B; no duration label where there is no duration."""
    size, duration = F.coalesce("file_size", F.lit(0)), F.when(~F.isnan("duration_secs"), F.col("duration_secs"))
    return _media(spark, d).select("id", text.format_bytes(size).alias("size_label"), text.format_duration(duration).alias("duration_label"))


_HASH_SQL = r"""digits AS (SELECT id, burst_group_id, regexp_replace(regexp_replace(lower(perceptual_hash), '[\s-]', '', 'g'), '^0x', '') AS x FROM media_items)
, hashed AS (SELECT id, burst_group_id AS burst, ('0x' || x)::UBIGINT AS h FROM digits WHERE regexp_full_match(x, '[0-9a-f]{1,16}') AND lpad(x, 16, '0') <> repeat(left(lpad(x, 16, '0'), 1), 16))"""


@query(f"WITH {_HASH_SQL} SELECT id, lpad(lower(to_hex(h)), 16, '0') AS hash, (h >> 48)::BIGINT AS bucket, bit_count(h)::INT AS bits FROM hashed")
def hash_forms(spark, d):
    m = _media(spark, d).select("id", hashes.read_hash(F.col("perceptual_hash")).alias("h")).filter("h IS NOT NULL")
    return m.select("id", hashes.write_hash(F.col("h")).alias("hash"), hashes.prefix_bucket(F.col("h")).alias("bucket"), F.bit_count("h").alias("bits"))


@query("""SELECT id, CASE WHEN json_valid(image_flags) AND json_type(image_flags) = 'ARRAY' THEN list_filter(list_transform(from_json(image_flags, '["VARCHAR"]'), lambda x: trim(x)), lambda x: x <> '') ELSE [] END AS flags,
 CASE WHEN json_valid(image_flags) AND json_type(image_flags) = 'ARRAY' THEN array_to_string(from_json(image_flags, '["VARCHAR"]'), ', ') ELSE '' END AS label FROM media_items""")
def flag_lists(spark, d):
    f = payloads.string_list(F.col("image_flags"))
    return _media(spark, d).select("id", payloads.trimmed_list(f).alias("flags"), F.array_join(f, ", ").alias("label"))


_SIZES = ", ".join(f"'{min(s)}x{max(s)}'" for s in media.SCREEN_SIZES)
_RATIO = "greatest(width, height) / nullif(least(width, height), 0)::DOUBLE"


@query(f"""SELECT id, coalesce(least(width, height)::VARCHAR || 'x' || greatest(width, height)::VARCHAR IN ({_SIZES}), false) AS screen_size,
 coalesce(width > 0 AND height > 0 AND (abs({_RATIO} - 4/3.0::DOUBLE) < 0.03 OR abs({_RATIO} - 1.5) < 0.03 OR abs({_RATIO} - 16/9.0::DOUBLE) < 0.03 OR abs({_RATIO} - 1.0) < 0.03), false) AS camera_ratio FROM media_items WHERE width IS NOT NULL AND height IS NOT NULL""")
def picture_shapes(spark, d):
    w, h = F.col("width"), F.col("height")
    m = _media(spark, d).filter("width IS NOT NULL AND height IS NOT NULL")
    return m.select("id", media.is_screen_size(w, h).alias("screen_size"), media.is_camera_ratio(w, h).alias("camera_ratio"))


@query("""SELECT s_suppkey AS a, n_nationkey AS b, round(2 * 3958.8 * asin(sqrt(pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))), 3) AS miles
 FROM (SELECT s_suppkey, n_nationkey, s_acctbal / 200.0 AS lat1, s_acctbal / 100.0 AS lon1, n_nationkey * 3.0 AS lat2, n_regionkey * 30.0 AS lon2 FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def haversine(spark, d):
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    lat, lon = F.col("s_acctbal") / 200.0, F.col("s_acctbal") / 100.0
    miles = geo.haversine_miles(lat, lon, F.col("n_nationkey") * 3.0, F.col("n_regionkey") * 30.0)
    return s.select(F.col("s_suppkey").alias("a"), F.col("n_nationkey").alias("b"), F.round(miles, 3).alias("miles"))


@query("""SELECT s_suppkey, printf('%.2f', s_acctbal / 100.0) || ':' || printf('%.2f', -s_acctbal / 50.0) AS coord_key FROM supplier""")
def geocode_keys(spark, d):
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", geo.geocode_key(F.col("s_acctbal") / 100.0, -F.col("s_acctbal") / 50.0).alias("coord_key"))


@query("""SELECT record_id, CASE WHEN ok THEN create_date END AS create_date, CASE WHEN ok THEN width END AS width, CASE WHEN ok THEN height END AS height, CASE WHEN ok THEN mime_type END AS mime_type,
 CASE WHEN ok AND NOT isnan(duration_secs) AND record_id % 5 <> 0 THEN duration_secs END AS duration_secs, CASE WHEN ok THEN video_codec END AS video_codec, CASE WHEN ok THEN content_identifier END AS content_identifier,
 CASE WHEN ok THEN camera_make END AS camera_make FROM (SELECT *, record_id % 11 <> 0 AS ok FROM metadata_info)""")
def exif_records(spark, d):
    """Records written as exif JSON and read back: durations as numbers, as texts or not readable, the codec under any of its three names, the content
    identifier under either of its two; some texts are cut short and give nothing."""
    m, i = table(spark, d, "metadata_info"), F.col("record_id")
    duration = F.when(~F.isnan("duration_secs"), F.col("duration_secs"))
    only = lambda c, k, n: F.when(i % n == k, F.col(c))
    json = F.to_json(F.struct(
        F.col("create_date").alias("CreateDate"), F.col("width").alias("ImageWidth"), F.col("height").alias("ImageHeight"), F.col("mime_type").alias("MIMEType"),
        F.when(i % 5 == 0, "12 s (approx)").otherwise(duration.cast("string")).alias("Duration"), only("video_codec", 0, 3).alias("VideoCodec"), only("video_codec", 1, 3).alias("CompressorName"),
        only("video_codec", 2, 3).alias("CodecID"), only("content_identifier", 0, 2).alias("ContentIdentifier"), only("content_identifier", 1, 2).alias("ComAppleQuickTimeContentIdentifier"),
        F.col("camera_make").alias("Make"),
    ))
    json = F.when(i % 5 == 1, F.regexp_replace(json, '"Duration":"([0-9.eE+-]+)"', '"Duration":$1')).otherwise(json)
    json = F.when(i % 11 == 0, F.substring(json, 1, 7)).otherwise(json)
    e = m.select("record_id", payloads.exif_record(json).alias("e"))
    return e.select("record_id", *[f"e.{c}" for c in ("create_date", "width", "height", "mime_type", "duration_secs", "video_codec", "content_identifier", "camera_make")])


@query("SELECT record_id, nullif(trim(camera_make), '') AS camera_make, nullif(trim(camera_model), '') AS camera_model FROM metadata_info WHERE trim(camera_make) <> '' OR trim(camera_model) <> ''")
def camera_records(spark, d):
    """Make and model of the records that name either."""
    c = payloads.camera(F.col("camera_make"), F.col("camera_model"))
    return table(spark, d, "metadata_info").select("record_id", c.alias("c")).filter("c IS NOT NULL").select("record_id", "c.*")


@query("""SELECT s_suppkey, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lat END AS lat, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN lon END AS lon
 FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN s_acctbal / 100.0 END AS lat, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal / 50.0 END AS lon FROM supplier)""")
def gps_points(spark, d):
    """Coordinates, where both are known."""
    s, i = table(spark, d, "supplier"), F.col("s_suppkey")
    p = geo.gps_point(F.when(i % 3 != 0, F.col("s_acctbal") / 100.0), F.when(i % 4 != 0, F.col("s_acctbal") / 50.0))
    return s.select("s_suppkey", p["lat"].alias("lat"), p["lon"].alias("lon"))


@query("""SELECT n_nationkey, CASE WHEN k NOT IN (3, 4) THEN n_name END AS city, CASE WHEN k NOT IN (3, 4) THEN r_name END AS country,
 CASE WHEN k NOT IN (3, 4) THEN 'GPS data suggests these photos were taken in: ' || n_name || ', ' || r_name END AS hint FROM (SELECT *, n_nationkey % 6 AS k FROM nation) JOIN region ON n_regionkey = r_regionkey""")
def geocode_answers(spark, d):
    """Answers of either form: a list of results, an address with a city, town or village; without a country, or broken, they name no place."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k, name, country = F.col("n_nationkey") % 6, F.concat(F.lit(" "), "n_name"), F.col("r_name")
    address = lambda c: F.to_json(F.struct(F.struct(name.alias(c), country.alias("country")).alias("address")))
    results = F.struct(F.array(F.struct(name.alias("name"), country.alias("country"))).alias("results"), F.struct(F.lit("elsewhere").alias("city"), F.lit("X").alias("country")).alias("address"))
    json = (
        F.when(k == 0, F.to_json(results)).when(k == 1, address("city")).when(k == 2, address("village"))
        .when(k == 3, F.to_json(F.struct(F.struct(name.alias("city"), F.lit(" ").alias("country")).alias("address")))).when(k == 4, F.lit('{"address": {')).otherwise(address("town"))
    )
    at = payloads.city_country(json)
    return n.select("n_nationkey", at["city"].alias("city"), at["country"].alias("country"), text.location_hint(at["city"], at["country"]).alias("hint"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 > 2 THEN s_acctbal END AS lat, CASE WHEN s_suppkey % 5 > 2 THEN -s_acctbal END AS lon, CASE WHEN s_suppkey % 5 > 2 THEN s_name END AS display_name FROM supplier")
def forward_geocode(spark, d):
    """The first hit; an empty list, a coordinate that is no number, or a broken text give no place."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey") % 5
    hit = lambda lat: F.struct(lat.alias("lat"), (-F.col("s_acctbal")).cast("string").alias("lon"), F.col("s_name").alias("display_name"))
    good, odd = hit(F.col("s_acctbal").cast("string")), hit(F.lit("north"))
    json = F.when(k == 0, F.lit("[]")).when(k == 1, F.to_json(F.array(odd))).when(k == 2, F.lit('[{"lat": "1"')).when(k == 3, F.to_json(F.array(good, odd))).otherwise(F.to_json(F.array(good)))
    p = payloads.first_place(json)
    return s.select("s_suppkey", p["lat"].alias("lat"), p["lon"].alias("lon"), p["display_name"].alias("display_name"))


@query("""SELECT id, CASE WHEN coalesce(file_size, 0) <= 26214400 THEN 'data:' || mime_type || ';base64,' || to_base64(filename::BLOB) END AS url FROM media_items WHERE mime_type IS NOT NULL""")
def preview_urls(spark, d):
    m = _media(spark, d).filter("mime_type IS NOT NULL")
    return m.select("id", text.data_url(F.col("mime_type"), F.encode("filename", "UTF-8"), F.coalesce("file_size", F.lit(0))).alias("url"))


# -- clusters, names and samples ---------------------------------------------------------------------------------------


@query(f"WITH {_CLUSTERS} SELECT id, event_year, cluster_no FROM clustered")
def day_clusters(spark, d):
    return clusters.day_clusters(_items(spark, d), "at").select("id", "event_year", "cluster_no")


@query(f"""WITH {_CLUSTERS} SELECT event_year, min(ts::DATE) AS first_day, max(ts::DATE) AS last_day, count(*) AS item_count FROM clustered GROUP BY event_year, cluster_no""")
def day_clusters_by_session_window(spark, d):
    """The same clusters by Spark's own session window over days."""
    rows = _items(spark, d).filter("at IS NOT NULL").select(F.year("at").alias("event_year"), F.to_date("at").alias("day"))
    days = rows.groupBy("event_year", "day").agg(F.count("*").alias("n"))
    w = F.session_window(F.col("day").cast("timestamp"), "2 days")
    return days.groupBy("event_year", w).agg(F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.sum("n").alias("item_count")).drop("session_window")


@query(f"WITH {_SPLIT} SELECT id, event_year, cluster_no, part_no FROM parts")
def split_long_spans(spark, d):
    return _parts(spark, d).select("id", *_GROUP)


@query(f"WITH {_STATS} SELECT * FROM stats")
def cluster_stats(spark, d):
    return clusters.cluster_stats(_parts(spark, d), _GROUP, "at")


def _named(spark, d):
    named = naming.cluster_names(clusters.cluster_stats(_parts(spark, d, True), _GROUP, "at"))
    return naming.resolve_collisions(named, ["event_year"], "base_name", [F.desc("cluster_no"), F.desc("part_no")])


@query(f"WITH {_NAMES} SELECT event_year, folder_name, item_count, start_date, end_date, duration_days, distinct_days, confidence, is_misc FROM folders")
def offline_event_names(spark, d):
    """The flagship: items ready to be grouped to clusters, cut, described, named, and told apart."""
    return _named(spark, d).select("event_year", "folder_name", "item_count", "start_date", "end_date", "duration_days", "distinct_days", "confidence", "is_misc")


@query(f"WITH {_NAMES} SELECT p.id, f.folder_name FROM parts p JOIN folders f USING (event_year, cluster_no, part_no)")
def regrouped_items(spark, d):
    """Every item ready to be grouped with its event's folder."""
    names = _named(spark, d).select(*_GROUP, "folder_name")
    return _parts(spark, d, True).join(names, _GROUP).select("id", "folder_name")


_DESCRIBED = f"""{_STATS}
, described AS (SELECT s.*, g.id IS NOT NULL AS has_s, g.ai_suggested_name AS s_name, g.ai_confidence AS s_confidence, CASE WHEN g.id % 7 = 0 THEN 'misc' ELSE g.ai_event_type END AS s_type,
  s.cluster_no % 3 = 0 AS away, n.n_name AS place FROM stats s LEFT JOIN event_groups g ON g.id = s.cluster_no AND s.part_no = 0 LEFT JOIN nation n ON n.n_nationkey = s.item_count % 40)
, {_NAMING}"""


def _suggested(spark, d):
    """Clusters named with suggestions: those of the event group with the cluster's number stand in for outside ones, nations for places."""
    g = table(spark, d, "event_groups")
    kind = F.when(F.col("id") % 7 == 0, "misc").otherwise(F.col("ai_event_type"))
    said = F.struct(F.col("ai_suggested_name").alias("folder_name"), F.col("ai_confidence").alias("confidence"), kind.alias("event_type"), F.lit(None).cast("string").alias("reasoning"))
    g = g.select(F.col("id").cast("int").alias("cluster_no"), F.lit(0).alias("part_no"), said.alias("said"))
    c = clusters.cluster_stats(_parts(spark, d), _GROUP, "at").withColumn("k", F.col("item_count") % 40)
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("place"))
    c = c.join(g, ["cluster_no", "part_no"], "left").join(places, "k", "left")
    return naming.cluster_names(c, F.col("said"), F.col("cluster_no") % 3 == 0, F.col("place"))


@query(f"WITH {_DESCRIBED} SELECT event_year, cluster_no, part_no, suggested_name, base_name, confidence, event_type, is_misc FROM named")
def suggested_event_names(spark, d):
    return _suggested(spark, d).select(*_GROUP, "suggested_name", "base_name", "confidence", "event_type", "is_misc")


@query(f"WITH {_DESCRIBED} SELECT NULL::BIGINT AS media_item_id, 'event_name_low_confidence' AS action_name, suggested_name AS old_value, base_name AS new_value, 'ai_event_naming' AS source FROM named WHERE lower(confidence) = 'low'")
def low_confidence_audit(spark, d):
    return naming.low_confidence_audit(_suggested(spark, d)).drop("details")


_POS = f"""{_CLUSTERS}
, ranked AS (SELECT *, row_number() OVER (PARTITION BY event_year, cluster_no ORDER BY ts, id) - 1 AS pos, count(*) OVER (PARTITION BY event_year, cluster_no) AS n FROM clustered)"""


@query(f"""WITH {_POS} SELECT event_year, cluster_no, id FROM ranked r WHERE n <= 10 OR pos IN (SELECT floor(i * (n - 1) / 9.0 + 0.5)::BIGINT FROM range(10) t(i))""")
def even_samples(spark, d):
    """At most ten items of each cluster, evenly spread in time, near duplicates among them; cluster_samples is without those."""
    ranked = ordering.position_in_group(clusters.day_clusters(_items(spark, d), "at").select("event_year", "cluster_no", "at", "id"), ["event_year", "cluster_no"], ["at", "id"])
    return ranked.filter(ordering.is_even_sample(F.col("pos"), F.col("size"), F.least(F.col("size"), F.lit(10)))).select("event_year", "cluster_no", "id")


def _thinned(spark, d):
    c = clusters.day_clusters(_items(spark, d), "at")
    return clusters.thin_near_duplicates(c, ["event_year", "cluster_no"], "at", "id", text.filename_prefix(F.col("filename")))


_THINNED = rf"""{_CLUSTERS}
, prefixed AS (SELECT event_year, cluster_no, id, epoch_us(ts) AS t, regexp_replace(regexp_replace(lower(filename), '\.[^.]*$', ''), '[0-9_\- ]+$', '') AS p FROM clustered)
, r AS (SELECT *, row_number() OVER (PARTITION BY event_year, cluster_no, p ORDER BY t, id) - 1 AS pos FROM prefixed WHERE p IS NOT NULL)
, walk AS (SELECT event_year, cluster_no, p, pos, t FROM r WHERE pos = 0
  UNION ALL SELECT w.event_year, w.cluster_no, w.p, min(r.pos), arg_min(r.t, r.pos) FROM walk w JOIN r ON r.event_year = w.event_year AND r.cluster_no = w.cluster_no AND r.p = w.p AND (r.t - w.t) // 1000000 > 5 AND r.pos > w.pos GROUP BY w.event_year, w.cluster_no, w.p)
, thinned AS (SELECT event_year, cluster_no, id, r.t FROM r JOIN walk USING (event_year, cluster_no, p, pos) UNION ALL SELECT event_year, cluster_no, id, t FROM prefixed WHERE p IS NULL)"""


@query(f"WITH RECURSIVE {_THINNED} SELECT event_year, cluster_no, id FROM thinned")
def near_dup_thinning(spark, d):
    """Items of each cluster without those within five seconds of a kept one with the same name prefix."""
    return _thinned(spark, d).select("event_year", "cluster_no", "id")


@query(f"""WITH RECURSIVE {_THINNED}
, ranked AS (SELECT *, row_number() OVER (PARTITION BY event_year, cluster_no ORDER BY t, id) - 1 AS pos, count(*) OVER (PARTITION BY event_year, cluster_no) AS n FROM thinned)
SELECT event_year, cluster_no, id FROM ranked WHERE n <= 10 OR pos IN (SELECT floor(i * (n - 1) / 9.0 + 0.5)::BIGINT FROM range(10) t(i))""")
def cluster_samples(spark, d):
    """The sampler as a whole: near duplicates thinned, then at most ten items of each cluster, evenly spread over what is left."""
    ranked = ordering.position_in_group(_thinned(spark, d).select("event_year", "cluster_no", "at", "id"), ["event_year", "cluster_no"], ["at", "id"])
    return ranked.filter(ordering.is_even_sample(F.col("pos"), F.col("size"), F.least(F.col("size"), F.lit(10)))).select("event_year", "cluster_no", "id")


_BY_DEVICE = f"""{_ITEMS}
, steps AS (SELECT *, CASE WHEN date_sub('second', lag(ts) OVER w, ts) > 600 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS f FROM items WHERE ts IS NOT NULL AND source_device IS NOT NULL
  WINDOW w AS (PARTITION BY source_device ORDER BY ts, id))
, runs AS (SELECT *, sum(f) OVER (PARTITION BY source_device ORDER BY ts, id) AS run FROM steps)"""


@query(f"WITH {_BY_DEVICE} SELECT source_device, epoch_us(min(ts)) AS start_micros, count(*) AS item_count FROM runs GROUP BY source_device, run HAVING count(*) > 1")
def burst_runs(spark, d):
    """Runs of pictures of one device with at most ten minutes between neighbours."""
    return bursts.burst_runs(_items(spark, d).filter("source_device IS NOT NULL"), ["source_device"], "at", "id", 600)


_PICTURES = f"""{_HASH_SQL}, {_ITEMS}
, shots AS (SELECT id, source_device, epoch_us(ts) AS t, h, coalesce(CASE WHEN NOT isnan(blur_score) THEN blur_score END, 0.0) AS s FROM items JOIN hashed USING (id) WHERE ts IS NOT NULL)"""


def _bursts_sql(by: str, distance: int) -> str:
    """The greedy rule step by step: from an anchor, each row is compared with the last member."""
    return f"""WITH RECURSIVE {_PICTURES}
, marked AS (SELECT *, {by} AS dev, CASE WHEN (t - lag(t) OVER w) // 1000000 <= 3 THEN 0 ELSE 1 END AS f FROM shots WHERE {by} IS NOT NULL WINDOW w AS (PARTITION BY {by} ORDER BY t, id))
, runs AS (SELECT *, sum(f) OVER (PARTITION BY dev ORDER BY t, id) AS run FROM marked)
, r AS (SELECT *, row_number() OVER (PARTITION BY dev, run ORDER BY t, id) - 1 AS pos, count(*) OVER (PARTITION BY dev, run) AS n FROM runs)
, walk AS (SELECT dev, run, 0::BIGINT AS i, 0::BIGINT AS last, 1::BIGINT AS j, 1::BIGINT AS size, n FROM r WHERE pos = 0 AND n > 1
  UNION ALL SELECT * FROM (
    SELECT dev, run, CASE WHEN near THEN i WHEN size > 1 THEN j ELSE i + 1 END AS i, CASE WHEN near THEN CASE WHEN alike THEN j ELSE last END WHEN size > 1 THEN j ELSE i + 1 END AS last,
      CASE WHEN near THEN j + 1 WHEN size > 1 THEN j + 1 ELSE i + 2 END AS j, CASE WHEN near THEN size + alike::INT ELSE 1 END AS size, n
    FROM (SELECT w.*, coalesce((x.t - c.t) // 1000000 <= 3, false) AS near, coalesce(bit_count(xor(x.h, c.h)) <= {distance}, false) AS alike
      FROM walk w JOIN r c ON c.dev = w.dev AND c.run = w.run AND c.pos = w.last LEFT JOIN r x ON x.dev = w.dev AND x.run = w.run AND x.pos = w.j)) WHERE i < n)
, members AS (SELECT DISTINCT dev, run, i, last AS pos FROM walk)
, sized AS (SELECT m.*, r.id, r.s, count(*) OVER (PARTITION BY m.dev, m.run, m.i) AS k FROM members m JOIN r USING (dev, run, pos))
SELECT s.id AS record_id, a.id AS burst_id, row_number() OVER (PARTITION BY s.dev, s.run, s.i ORDER BY s.s DESC, s.pos DESC) = 1 AS is_primary FROM sized s JOIN r a ON a.dev = s.dev AND a.run = s.run AND a.pos = s.i WHERE k > 1"""


def _shots(spark, d):
    return _items(spark, d).withColumn("h", hashes.read_hash(F.col("perceptual_hash")))


@query(_bursts_sql("0", 10))
def burst_groups(spark, d):
    """Bursts of like pictures, each within three seconds of the one before, over the whole library."""
    return bursts.bursts(_shots(spark, d), [], "at", "id", "h", "blur_score")


@query(_bursts_sql("0", 64))
def burst_chains(spark, d):
    """Bursts by time alone: no two hashes differ in more than 64 bits."""
    return bursts.bursts(_shots(spark, d), [], "at", "id", "h", "blur_score", distance=64)


@query(_bursts_sql("source_device", 10))
def device_bursts(spark, d):
    """Bursts of each device by itself."""
    return bursts.bursts(_shots(spark, d).filter("source_device IS NOT NULL"), ["source_device"], "at", "id", "h", "blur_score")


_B = "lower(trim(burst_group_id))"


@query(f"""WITH m AS (SELECT {_B} AS burst, id, coalesce(CASE WHEN NOT isnan(blur_score) THEN blur_score END, 0.0) AS s FROM media_items WHERE trim(burst_group_id) <> '')
, chosen AS (SELECT burst, min(id) AS c FROM m WHERE id IN (SELECT media_item_id FROM date_estimate) GROUP BY 1)
SELECT burst, coalesce(any_value(c), arg_max(id, (s, id))) AS primary_id FROM m LEFT JOIN chosen USING (burst) GROUP BY 1""")
def burst_best_shots(spark, d):
    """The best shot of each burst: a chosen one (items with a date estimate stand in for outside answers), else the sharpest."""
    members = _media(spark, d).filter("trim(burst_group_id) <> ''").select(F.lower(F.trim("burst_group_id")).alias("burst"), F.col("id").alias("primary_id"))
    chosen = members.join(table(spark, d, "date_estimate").select(F.col("media_item_id").alias("primary_id")), "primary_id", "left_semi")
    return bursts.best_shots(burst_primaries(spark, d), members, chosen, "burst", "primary_id")


_CLASS_SQL = f"{_HASH_SQL}, classes AS (SELECT h, burst, min(id) AS rep, count(*) AS size FROM hashed GROUP BY ALL)"
_PAIR = "a.h >> 48 = b.h >> 48 AND bit_count(xor(a.h, b.h)) <= 5 AND coalesce(a.burst <> b.burst, true)"


@query(f"WITH {_CLASS_SQL} SELECT a.rep AS rep_a, b.rep AS rep_b, bit_count(xor(a.h, b.h))::INT AS bits FROM classes a JOIN classes b ON a.rep < b.rep AND {_PAIR}")
def hash_pairs(spark, d):
    m = _media(spark, d).select("id", hashes.read_hash(F.col("perceptual_hash")).alias("h"), F.col("burst_group_id").alias("burst"))
    return duplicates.hash_pairs(duplicates.hash_classes(m, "id", "h", "burst"))


@query(f"""WITH RECURSIVE {_HASH_SQL}
, links AS (SELECT a.id AS a, b.id AS b FROM hashed a JOIN hashed b ON a.id <> b.id AND {_PAIR})
, reach AS (SELECT a AS node, a AS other FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT node AS record_id, 'dup-' || min(other)::VARCHAR AS duplicate_group FROM reach GROUP BY node""")
def duplicate_components(spark, d):
    m = _media(spark, d).select("id", hashes.read_hash(F.col("perceptual_hash")).alias("h"), F.col("burst_group_id").alias("burst"))
    return duplicates.duplicate_groups(m, "id", "h", "burst")


# -- places ------------------------------------------------------------------------------------------------------------

_GPS = """gps AS (SELECT c.*, CASE WHEN c.source_device IS NOT NULL THEN 36.0 + k * 0.25 END AS lat, CASE WHEN c.source_device IS NOT NULL THEN -86.0 - k * 0.125 END AS lon, n.n_name AS city
 FROM (SELECT *, length(filename) + length(coalesce(source_device, '')) + year(ts) % 12 - 20 AS k FROM clustered) c LEFT JOIN nation n ON n.n_nationkey = c.k AND c.source_device IS NOT NULL)"""


def _gps(spark, d):
    """Clustered items with stand-in coordinates (the tables have none), missing for items without a device, and the place there."""
    c = clusters.day_clusters(_items(spark, d), "at")
    k = F.length("filename") + F.length(F.coalesce("source_device", F.lit(""))) + F.year("at") % 12 - 20
    c = c.withColumn("k", F.when(F.col("source_device").isNotNull(), k))
    places = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("city"))
    return c.withColumns({"lat": 36.0 + F.col("k") * 0.25, "lon": -86.0 - F.col("k") * 0.125}).join(places, "k", "left")


_MILES = "2 * 3958.8 * asin(sqrt(pow(sin(radians(lat - 36.5) / 2), 2) + cos(radians(36.5)) * cos(radians(lat)) * pow(sin(radians(lon + 86.0) / 2), 2)))"


@query(f"""WITH {_CLUSTERS}, {_GPS}
, located AS (SELECT *, {_MILES} AS miles, row_number() OVER (PARTITION BY event_year, cluster_no ORDER BY ts, id) - 1 AS pos, count(*) OVER (PARTITION BY event_year, cluster_no) AS n FROM gps WHERE lat IS NOT NULL)
, dist AS (SELECT event_year, cluster_no, list_sort(list(miles))[count(*) // 2 + 1] AS miles, avg(CASE WHEN miles > 25 THEN 1.0 ELSE 0.0 END) AS outside FROM located GROUP BY ALL)
, sampled AS (SELECT * FROM located WHERE n <= 5 OR pos IN (SELECT floor(i * (n - 1) / 4.0 + 0.5)::BIGINT FROM range(5) t(i)))
, votes AS (SELECT event_year, cluster_no, lower(city) AS k, count(*) AS v, min(pos) AS p, arg_min(city, pos) AS c FROM sampled WHERE city IS NOT NULL GROUP BY ALL)
, place AS (SELECT event_year, cluster_no, arg_max(c, (v, -p)) AS dominant, max(v) / sum(v) AS ratio, count(*) AS cities FROM votes GROUP BY ALL)
, facts AS (SELECT event_year, cluster_no, round(100.0 * count(lat) / count(*), 6) AS coverage, (max(ts::DATE) - min(ts::DATE) + 1)::BIGINT AS duration_days, count(DISTINCT ts::DATE) AS distinct_days FROM gps GROUP BY ALL)
, joined AS (SELECT f.*, round(miles, 4) AS median_miles, dominant, CASE WHEN ratio > 0.7 THEN 'high' WHEN ratio > 0.4 THEN 'medium' WHEN ratio IS NOT NULL THEN 'low' END AS place_confidence,
  CASE WHEN cities = 1 THEN 'consistent' WHEN cities > 1 THEN 'mixed' ELSE 'none' END AS consistency,
  CASE WHEN miles IS NOT NULL THEN (miles > 25 AND outside >= 0.6) OR coalesce(ratio > 0.7 AND lower(dominant) <> 'canada', false) END AS away
  FROM facts f LEFT JOIN dist USING (event_year, cluster_no) LEFT JOIN place USING (event_year, cluster_no))
SELECT event_year, cluster_no, coverage AS gps_coverage_percent, dominant AS dominant_location, place_confidence, median_miles, away AS away_from_home, consistency AS location_consistency, duration_days, distinct_days,
 coalesce(away, false) AND duration_days >= 2 AND consistency <> 'none' AS maybe_travel FROM joined""")
def location_facts(spark, d):
    out = locations.location_facts(_gps(spark, d), ["event_year", "cluster_no"], ["at", "id"], "at", "lat", "lon", "city", (36.5, -86.0, 25.0, "Canada"))
    return out.withColumn("median_miles", F.round("median_miles", 4)).withColumn("gps_coverage_percent", F.round("gps_coverage_percent", 6))


@query(f"WITH {_CLUSTERS}, {_GPS} SELECT event_year, cluster_no, list_sort(list({_MILES}))[count(*) // 2 + 1].round(4) AS miles FROM gps WHERE lat IS NOT NULL GROUP BY ALL")
def upper_median_distance(spark, d):
    g = _gps(spark, d).withColumn("miles", geo.haversine_miles(F.lit(36.5), F.lit(-86.0), F.col("lat"), F.col("lon")))
    return ordering.upper_median(g, ["event_year", "cluster_no"], "miles", ["at", "id"]).withColumn("miles", F.round("miles", 4))


@query(f"""WITH {_CLUSTERS}, {_GPS} SELECT event_year, cluster_no, arg_min(city, (ts, id)) AS first_city FROM gps WHERE city IS NOT NULL GROUP BY ALL""")
def first_places(spark, d):
    """The place of the first located item of each cluster."""
    return _gps(spark, d).filter("city IS NOT NULL").groupBy("event_year", "cluster_no").agg(F.min_by("city", F.struct("at", "id")).alias("first_city"))


_SUPPLIERS = [1, 2, 3, 4, 5, 6, 8, 9]


def _settings(spark, d, supplier: int):
    """Settings made from a supplier: some unreadable, blank or missing."""
    i, x = F.col("s_suppkey"), F.col("s_acctbal")
    values = {
        "home_latitude": (x / 200).cast("string"), "home_longitude": F.when(i % 5 == 0, "west").otherwise((x / 100).cast("string")),
        "home_radius_miles": F.when(i % 2 == 0, i.cast("string")).otherwise("far"), "home_label": F.when(i % 3 == 0, "  ").otherwise(F.col("s_name")),
        "home_address_raw": F.concat("s_name", F.lit(" Street")), "blur_threshold": F.when(i % 4 != 0, x.cast("string")), "burst_window": F.when(i % 3 == 0, i.cast("string")).otherwise("x"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in values.items()])
    return table(spark, d, "supplier").filter(i == supplier).select(F.inline(rows))


@query(f"""SELECT s_suppkey AS supplier, round(s_acctbal / 200, 6) AS lat, round(s_acctbal / 100, 6) AS lon, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE 25 END::DOUBLE AS radius,
 CASE WHEN s_suppkey % 3 = 0 THEN s_name || ' Street' ELSE s_name END AS label FROM supplier WHERE s_suppkey IN ({str(_SUPPLIERS)[1:-1]}) AND s_suppkey % 5 <> 0""")
def home_settings(spark, d):
    """Home by the settings of a few suppliers: none without both coordinates, the default radius, the address for a blank label."""
    found = [locations.home_config(_settings(spark, d, k)).withColumn("supplier", F.lit(k).cast("bigint")) for k in _SUPPLIERS]
    return reduce(DataFrame.unionByName, found).select("supplier", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "radius", "label")


@query(f"""SELECT s_suppkey AS supplier, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal ELSE 50 END::DOUBLE AS blur_threshold, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey ELSE 3 END::BIGINT AS burst_window, 0.6::DOUBLE AS screenshot_threshold
 FROM supplier WHERE s_suppkey IN ({str(_SUPPLIERS)[1:-1]})""")
def typed_settings(spark, d):
    """Settings as numbers, the default for what is missing or unreadable."""
    defaults = {"blur_threshold": 50.0, "burst_window": 3, "screenshot_threshold": 0.6}
    found = [lifecycle.typed_settings(_settings(spark, d, k), defaults).withColumn("supplier", F.lit(k).cast("bigint")) for k in _SUPPLIERS]
    return reduce(DataFrame.unionByName, found)


@query("""SELECT CASE key WHEN 'burst_window' THEN 'burst_window' ELSE key END AS key, CASE key WHEN 'burst_window' THEN '9' WHEN 'home_label' THEN NULL ELSE value END AS value
 FROM (SELECT unnest(['blur_threshold', 'burst_window', 'home_address_raw', 'home_latitude', 'home_longitude', 'home_radius_miles']) AS key, unnest([s_acctbal::VARCHAR, '', s_name || ' Street', (s_acctbal / 200)::VARCHAR, (s_acctbal / 100)::VARCHAR, 'far']) AS value FROM supplier WHERE s_suppkey = 1)""")
def changed_settings(spark, d):
    """The settings after one is written and one is cleared."""
    return lifecycle.changed_settings(_settings(spark, d, 1), {"burst_window": "9"}, ["home_label", "unknown"])


# -- rules -------------------------------------------------------------------------------------------------------------


@query("""SELECT id, list_filter([CASE WHEN file_size < 512000 THEN 'small_file' END, CASE WHEN blur < 50 THEN 'blurry' END, CASE WHEN dark > 0.6 OR bright > 0.6 THEN 'poor_exposure' END,
 CASE WHEN CASE WHEN cls IS NOT NULL THEN cls IN ('screenshot','meme','graphic','document') ELSE shot >= 0.8 END THEN 'screenshot_or_meme' END,
 CASE WHEN burst IS NOT NULL AND prim IS DISTINCT FROM 1 THEN 'burst_shot' END, CASE WHEN dup IS NOT NULL THEN 'duplicate' END], lambda x: x IS NOT NULL) AS flags
 FROM (SELECT id, coalesce(file_size, 0) AS file_size, CASE WHEN isnan(blur_score) THEN NULL ELSE blur_score END AS blur, 1 - least(exposure_mean / 60.0, 1) AS dark, greatest(exposure_mean - 195.0, 0) / 60.0 AS bright,
 CASE WHEN isnan(screenshot_heuristic) THEN NULL ELSE screenshot_heuristic END AS shot, ai_content_class AS cls, burst_group_id AS burst, is_burst_primary AS prim, duplicate_group_id AS dup FROM media_items WHERE mime_type ILIKE 'image/%' AND coalesce(NOT isnan(exposure_mean), true))""")
def image_flags(spark, d):
    """The ordered quality flags of pictures (dark and bright shares are stand-ins from the mean brightness)."""
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%") & F.coalesce(~F.isnan("exposure_mean"), F.lit(True)))
    number = lambda c: F.when(~F.isnan(c), F.col(c))
    dark = 1 - F.least(F.col("exposure_mean") / 60.0, F.lit(1))
    bright = F.greatest(F.col("exposure_mean") - 195.0, F.lit(0)) / 60.0
    shot = F.when(F.col("ai_content_class").isNotNull(), F.col("ai_content_class").isin("screenshot", "meme", "graphic", "document")).otherwise(number("screenshot_heuristic") >= 0.8)
    rules = {
        "small_file": F.coalesce("file_size", F.lit(0)) < 500 * 1024, "blurry": number("blur_score") < 50, "poor_exposure": (dark > 0.6) | (bright > 0.6), "screenshot_or_meme": shot,
        "burst_shot": F.col("burst_group_id").isNotNull() & ~F.col("is_burst_primary").eqNullSafe(1), "duplicate": F.col("duplicate_group_id").isNotNull(),
    }
    return m.select("id", F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull()).alias("flags"))


@query(r"""WITH n AS (SELECT id, event_year, trim(coalesce(ai_suggested_name, 'Misc')) AS g, lower(ai_confidence) AS c, lower(ai_event_type) AS t FROM event_groups)
, x AS (SELECT *, event_year::VARCHAR || ' - ' || trim(regexp_replace(CASE WHEN g = '' THEN 'Misc' ELSE g END, '[<>:"/\\|?*]', '-', 'g')) AS f, CASE WHEN c IN ('high','medium','low') THEN c ELSE 'medium' END AS lv FROM n)
, y AS (SELECT *, lower(substr(f, 8)) IN ('family gathering','weekend moments','family time','special memories','good times','fun times','daily life','everyday moments') AS banned FROM x)
SELECT id, f AS folder_name, CASE WHEN banned THEN 'low' ELSE lv END AS confidence, CASE WHEN t IN ('holiday','birthday','vacation','sports','school','family','anniversary','graduation','travel','day_trip','misc','other') THEN t END AS event_type,
 banned OR lv = 'low' AS needs_fallback FROM y""")
def validated_names(spark, d):
    g = table(spark, d, "event_groups")
    v = naming.validated_name(F.col("ai_suggested_name"), F.col("ai_confidence"), F.col("ai_event_type"), F.col("event_year"))
    return g.select("id", v.alias("v")).select("id", "v.*")


@query("""WITH last AS (SELECT media_item_id, arg_min(coalesce(create_date, date_time_original), record_id) AS exif FROM metadata_info WHERE coalesce(create_date, date_time_original) IS NOT NULL AND media_item_id IS NOT NULL GROUP BY 1)
, c AS (SELECT id, coalesce(exif, date_taken) AS t FROM media_items LEFT JOIN last ON media_item_id = id)
, v AS (SELECT id, t, t IS NULL OR trim(t) = '' OR starts_with(t, '1970:01:01') OR starts_with(t, '0000:00:00') AS bad FROM c)
SELECT id, CASE WHEN bad THEN NULL WHEN substr(t, 5, 1) = ':' THEN replace(substr(t, 1, 10), ':', '-') ELSE t END AS day, bad AS needs_review FROM v""")
def date_enforcement(spark, d):
    """The record's own date else the stored one; bad ones need review."""
    m = table(spark, d, "metadata_info").select("media_item_id", "record_id", F.coalesce("create_date", "date_time_original").alias("t")).filter("t IS NOT NULL AND media_item_id IS NOT NULL")
    exif = m.groupBy(F.col("media_item_id").alias("id")).agg(F.min_by("t", "record_id").alias("exif"))
    t = F.col("t")
    bad = t.isNull() | (F.trim(t) == "") | dates.is_invalid_date(t)
    rows = _media(spark, d).select("id", "date_taken").join(exif, "id", "left").select("id", F.coalesce("exif", "date_taken").alias("t"))
    return rows.select("id", F.when(~bad, dates.exif_day(t)).alias("day"), bad.alias("needs_review"))


@query("""WITH best AS (SELECT media_item_id, arg_max(ai_date, (confidence, estimate_id)) AS day FROM date_estimate WHERE ai_date IS NOT NULL AND confidence >= 0.5 GROUP BY 1)
SELECT id, coalesce(day, date_taken) AS date_taken, CASE WHEN day IS NOT NULL THEN 'user_override' ELSE date_taken_source END AS date_taken_source FROM media_items LEFT JOIN best ON media_item_id = id WHERE date_needs_review = 1""")
def date_approval(spark, d):
    """Review rows with the surest estimate taken over."""
    e = table(spark, d, "date_estimate").filter("ai_date IS NOT NULL AND confidence >= 0.5").groupBy(F.col("media_item_id").alias("id")).agg(F.max_by("ai_date", F.struct("confidence", "estimate_id")).alias("day"))
    m = _media(spark, d).filter("date_needs_review = 1").join(e, "id", "left")
    return m.select("id", F.coalesce("day", "date_taken").alias("date_taken"), F.when(F.col("day").isNotNull(), "user_override").otherwise(F.col("date_taken_source")).alias("date_taken_source"))


# -- changes -----------------------------------------------------------------------------------------------------------


@query("""SELECT icloud_id, min(id) AS id FROM media_items WHERE icloud_id IS NOT NULL AND created_at < '2024-03-01' GROUP BY 1
 UNION ALL SELECT icloud_id, min(id) FROM media_items WHERE icloud_id IS NOT NULL AND icloud_id NOT IN (SELECT icloud_id FROM media_items WHERE created_at < '2024-03-01' AND icloud_id IS NOT NULL) GROUP BY 1""")
def insert_or_ignore(spark, d):
    """A re-index: the records known before March 2024, and of the others the first of each key."""
    m = _media(spark, d).filter("icloud_id IS NOT NULL")
    known = m.filter("created_at < '2024-03-01'").groupBy("icloud_id").agg(F.min("id").alias("id"))
    return lifecycle.insert_or_ignore(known, m.select("icloud_id", "id"), "icloud_id", ["id"])


@query("""WITH base AS (SELECT id AS media_item_id, status FROM media_items), ch AS (SELECT media_item_id, arg_max(action_name, (logged_at, id, action_name)) AS status FROM audit_log WHERE media_item_id IS NOT NULL GROUP BY 1)
 SELECT * FROM ch UNION ALL SELECT * FROM base WHERE media_item_id NOT IN (SELECT media_item_id FROM ch)""")
def last_write_wins(spark, d):
    base = _media(spark, d).select(F.col("id").alias("media_item_id"), "status")
    ch = table(spark, d, "audit_log").filter("media_item_id IS NOT NULL").select("media_item_id", F.col("action_name").alias("status"), "logged_at", "id")
    last = ch.groupBy("media_item_id").agg(F.max_by("status", F.struct("logged_at", "id", "status")).alias("status"))
    return lifecycle.upsert(base, last, ["media_item_id"], ["status"])


@query("""SELECT media_item_id, action_name, old_value, new_value, source, details FROM audit_log
 UNION ALL SELECT id, 'excluded', status, 'excluded', 'keep_best', '{"burst":"' || lower(trim(burst_group_id)) || '"}' FROM media_items WHERE trim(burst_group_id) <> '' AND is_burst_primary = 0 AND status <> 'excluded'""")
def keep_best_only(spark, d):
    """Non-primary members of bursts are excluded: the log with a row for each."""
    b = F.lower(F.trim("burst_group_id"))
    out = _media(spark, d).filter((b != "") & (F.col("is_burst_primary") == 0) & (F.col("status") != "excluded"))
    rows = lifecycle.audit_rows(out, "id", "excluded", F.col("status"), F.lit("excluded"), "keep_best", F.to_json(F.struct(b.alias("burst"))))
    return table(spark, d, "audit_log").select(rows.columns).unionByName(rows)


@query("""SELECT id, CASE WHEN id IN (SELECT media_item_id FROM date_estimate WHERE confidence < 0.2) AND status IN ('indexed', 'image_reviewed', 'grouped') THEN 'excluded' ELSE status END AS status FROM media_items""")
def exclude_items(spark, d):
    wanted = table(spark, d, "date_estimate").filter("confidence < 0.2").select("media_item_id")
    return lifecycle.change_where(_media(spark, d).select("id", "status"), wanted, "id", {"status": F.lit("excluded")}, F.col("status").isin("indexed", "image_reviewed", "grouped"))


@query("""WITH moved AS (SELECT id, CASE WHEN id IN (SELECT media_item_id FROM date_estimate) THEN 1 ELSE event_group_id END AS g, status FROM media_items)
 SELECT e.id AS group_id, count(m.id) AS item_count FROM event_groups e LEFT JOIN moved m ON m.g = e.id AND m.status <> 'excluded' GROUP BY 1""")
def move_items(spark, d):
    """Items with estimates moved to group 1, and all groups counted again."""
    wanted = table(spark, d, "date_estimate").select("media_item_id")
    moved = lifecycle.change_where(_media(spark, d).select("id", "event_group_id", "status"), wanted, "id", {"event_group_id": F.lit(1).cast("bigint")})
    g = table(spark, d, "event_groups").select(F.col("id").alias("group_id"))
    return lifecycle.with_counts(g, moved, "group_id", "event_group_id", F.col("status") != "excluded", "item_count")


@query("""WITH r AS (SELECT media_item_id, arg_min(width, record_id) AS w, arg_min(video_codec, record_id) AS c FROM metadata_info WHERE media_item_id IS NOT NULL AND width IS NOT NULL AND video_codec IS NOT NULL GROUP BY 1)
SELECT id, coalesce(video_width, w) AS video_width, coalesce(video_codec, c) AS video_codec, coalesce(duration_secs, 0.0) AS duration_secs FROM media_items LEFT JOIN r ON media_item_id = id WHERE mime_type ILIKE 'video/%'""")
def video_backfill(spark, d):
    """Missing width and codec from the item's first metadata record that has both, as the SQL has them; video_fields takes each field by itself."""
    m = table(spark, d, "metadata_info").filter("media_item_id IS NOT NULL AND width IS NOT NULL AND video_codec IS NOT NULL")
    r = m.groupBy(F.col("media_item_id").alias("id")).agg(F.min_by("width", "record_id").alias("w"), F.min_by("video_codec", "record_id").alias("c"))
    v = _media(spark, d).filter(F.col("mime_type").ilike("video/%")).select("id", "video_width", "video_codec", "duration_secs").join(r, "id", "left")
    return v.select("id", F.coalesce("video_width", "w").alias("video_width"), F.coalesce("video_codec", "c").alias("video_codec"), F.coalesce("duration_secs", F.lit(0.0)).alias("duration_secs"))


@query("""WITH r AS (SELECT media_item_id, arg_min(width, record_id) FILTER (WHERE width IS NOT NULL) AS w, arg_min(height, record_id) FILTER (WHERE height IS NOT NULL) AS h,
 arg_min(video_codec, record_id) FILTER (WHERE video_codec IS NOT NULL) AS c, arg_min(duration_secs, record_id) FILTER (WHERE NOT isnan(duration_secs)) AS s FROM metadata_info WHERE media_item_id IS NOT NULL GROUP BY 1)
SELECT id, coalesce(video_width, w) AS video_width, coalesce(video_height, h) AS video_height, coalesce(video_codec, c) AS video_codec, coalesce(CASE WHEN NOT isnan(duration_secs) THEN duration_secs END, s, 0.0) AS duration_secs
 FROM media_items LEFT JOIN r ON media_item_id = id WHERE mime_type ILIKE 'video/%'""")
def video_fields(spark, d):
    """Missing fields of videos, each from the item's first metadata record that has it; a duration that none has is 0."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("record_id")))
    number = F.when(~F.isnan("duration_secs"), F.col("duration_secs"))
    m = table(spark, d, "metadata_info").filter("media_item_id IS NOT NULL").withColumn("duration_secs", number)
    r = m.groupBy(F.col("media_item_id").alias("id")).agg(first("width").alias("w"), first("height").alias("h"), first("video_codec").alias("c"), first("duration_secs").alias("s"))
    v = _media(spark, d).filter(F.col("mime_type").ilike("video/%")).select("id", "video_width", "video_height", "video_codec", number.alias("duration_secs")).join(r, "id", "left")
    return v.select(
        "id", F.coalesce("video_width", "w").alias("video_width"), F.coalesce("video_height", "h").alias("video_height"),
        F.coalesce("video_codec", "c").alias("video_codec"), F.coalesce("duration_secs", "s", F.lit(0.0)).alias("duration_secs"),
    )


_P = "list_transform(embedding, lambda x: greatest(0, least(255, floor((x::DOUBLE + 0.5) * 255)))::DOUBLE)"
_AT_9 = [[max(0.0, 1 - abs(i + 0.5 - (x + 0.5) * 8 / 9)) for i in range(8)] for x in range(9)]
_SCALED = "[" + ", ".join("[" + ", ".join(repr(w / sum(ws)) for w in ws) + "]" for ws in _AT_9) + "]"


@query(f"""WITH px AS (SELECT vec_id, {_P} AS p FROM embeddings)
, small AS (SELECT *, [[floor(round(list_sum([p[8 * y + i + 1] * w[i + 1] FOR i IN range(8)]), 6) + 0.5) FOR w IN {_SCALED}] FOR y IN range(8)] AS q FROM px)
, bits AS (SELECT vec_id, p, list_sum([CASE WHEN q[k // 8 + 1][k % 8 + 1] > q[k // 8 + 1][k % 8 + 2] THEN (1::HUGEINT << k::INT) ELSE 0 END FOR k IN range(64)])::HUGEINT AS b,
  [p[k - 7] + p[k + 9] + p[k] + p[k + 2] - 4 * p[k + 1] FOR k IN range(64) IF k // 8 BETWEEN 1 AND 6 AND k % 8 BETWEEN 1 AND 6] AS lap FROM small)
SELECT vec_id AS record_id, round(list_var_pop(lap), 4) AS blur_score, (CASE WHEN b >= 9223372036854775808 THEN b - 18446744073709551616 ELSE b END)::BIGINT AS dhash,
 round(list_avg(p), 6) AS brightness, round(list_stddev_pop(p), 6) AS contrast, len([x FOR x IN p IF x <= 30]) / 64.0::DOUBLE AS dark_share, len([x FOR x IN p IF x >= 225]) / 64.0::DOUBLE AS bright_share FROM bits""")
def picture_measures(spark, d):
    """Measures of 8 x 8 grey pictures made from the embeddings."""
    pixel = lambda x: F.floor(F.least(F.greatest((x.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0)))
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", pixel).alias("p"))
    out = kernels.picture_measures(e.withColumns({"w": F.lit(8), "h": F.lit(8)}), "vec_id", "p", "w", "h")
    return out.withColumns({"blur_score": F.round("blur_score", 4), "brightness": F.round("brightness", 6), "contrast": F.round("contrast", 6)})


@query("""WITH c AS (SELECT vec_id, label % 2 = 0 AS even, [greatest(0, least(255, floor((x::DOUBLE + 0.5) * 255))) FOR x IN embedding[1:6]] AS c FROM embeddings)
, s AS (SELECT vec_id, CASE WHEN even OR greatest(abs(c[1] - c[4]), abs(c[2] - c[5]), abs(c[3] - c[6])) < 10 THEN 1.0 ELSE 0.5 END::DOUBLE AS flat_share FROM c)
SELECT vec_id AS record_id, flat_share, true AS has_bars, CASE WHEN flat_share > 0.6 THEN 0.75 ELSE 0.6 END::DOUBLE AS screenshot_score FROM s""")
def picture_signals(spark, d):
    """Signals of 64 x 64 RGB pictures in two colours made from the embeddings: one above the other, the middle in stripes of both where the label is odd."""
    pixel = lambda x: F.floor(F.least(F.greatest((x.cast("double") + 0.5) * 255, F.lit(0.0)), F.lit(255.0)))
    e = table(spark, d, "embeddings").withColumn("c", F.transform("embedding", pixel))
    first = lambda y: F.when(F.col("label") % 2 == 0, y < 32).otherwise((y < 16) | ((y < 48) & (y % 16 < 8)))
    line = lambda y: F.flatten(F.array_repeat(F.when(first(y), F.slice("c", 1, 3)).otherwise(F.slice("c", 4, 3)), 64))
    e = e.withColumn("p", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(63)), line)))
    out = kernels.picture_signals(e.withColumns({"w": F.lit(64), "h": F.lit(64)}), "vec_id", "p", "w", "h")
    score = media.screenshot_score(F.lit(64), F.lit(64), F.lit(False), F.col("flat_share"), F.col("has_bars"))
    return out.withColumn("screenshot_score", F.round(score, 6))


# -- candidates, places and groups -------------------------------------------------------------------------------------


@query(f"WITH {_ITEMS.replace('FROM media_items)', f'FROM media_items WHERE {_READY})')} SELECT id, ts::DATE AS day FROM items WHERE ts IS NOT NULL")
def grouping_candidates(spark, d):
    """Items ready to be grouped: date verified, not up for review, and readable."""
    return _items(spark, d, True).filter("at IS NOT NULL").select("id", F.to_date("at").alias("day"))


@query("SELECT id, current_path FROM media_items WHERE status = 'video_reviewed' AND coalesce(trim(current_path), '') <> ''")
def date_check_candidates(spark, d):
    return _media(spark, d).filter("status = 'video_reviewed' AND coalesce(trim(current_path), '') <> ''").select("id", "current_path")


@query("""WITH m AS (SELECT id, lower(trim(burst_group_id)) AS b FROM media_items WHERE trim(burst_group_id) <> '') SELECT m.id, m.b AS burst FROM m WHERE b = (SELECT b FROM m ORDER BY id LIMIT 1)""")
def burst_filmstrip(spark, d):
    """The items of the burst of the first item that has one."""
    m = _media(spark, d).filter("trim(burst_group_id) <> ''").select("id", F.lower(F.trim("burst_group_id")).alias("burst"))
    return m.join(F.broadcast(m.agg(F.min_by("burst", "id").alias("burst"))), "burst", "left_semi").select("id", "burst")


@query("SELECT id, group_name FROM event_groups WHERE id <> 1")
def move_targets(spark, d):
    """Groups that items of group 1 can be moved to."""
    return table(spark, d, "event_groups").filter("id <> 1").select("id", "group_name")


@query("SELECT DISTINCT lower(trim(group_name)) AS name FROM event_groups WHERE group_name IS NOT NULL")
def distinct_names(spark, d):
    return table(spark, d, "event_groups").filter("group_name IS NOT NULL").select(text.normalise_name(F.col("group_name")).alias("name")).distinct()


_COORDS = "SELECT s_suppkey, printf('%.2f', s_acctbal / 100.0) || ':' || printf('%.2f', -s_acctbal / 50.0) AS k, s_nationkey FROM supplier"


@query(f"""WITH c AS ({_COORDS}), cache AS (SELECT k, min(CASE WHEN s_nationkey < 8 THEN n_name END) AS city FROM c JOIN nation ON n_nationkey = s_nationkey WHERE s_nationkey < 12 GROUP BY k)
SELECT s_suppkey, c.k AS coord_key, city, cache.k IS NOT NULL AS cached FROM c LEFT JOIN cache USING (k)""")
def cached_places(spark, d):
    """Places of coordinates from a cache that also holds coordinates without a place (suppliers of the first nations stand in for it)."""
    lat, lon = F.col("s_acctbal") / 100.0, -F.col("s_acctbal") / 50.0
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    cache = s.filter("s_nationkey < 12").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    # per key the place that sorts first, as the cache is written once a key
    city = F.when(F.col("s_nationkey") < 8, F.col("n_name"))
    cache = cache.groupBy(geo.geocode_key(lat, lon).alias("coord_key")).agg(F.min(city).alias("city"), F.lit(None).cast("string").alias("country"))
    return locations.with_cached_places(s, lat, lon, cache).select("s_suppkey", "coord_key", "city", "cached")


@query("""WITH w AS (SELECT event_year, trim(ai_suggested_name) AS n FROM event_groups WHERE trim(ai_suggested_name) <> '' UNION ALL SELECT 2030, n_name FROM nation)
SELECT min(event_year)::INT AS event_year, arg_min(n, (event_year, n)) AS group_name, min(event_year)::VARCHAR || ' - ' || arg_min(n, (event_year, n)) AS folder_name FROM w
WHERE lower(n) NOT IN (SELECT lower(trim(group_name)) FROM event_groups WHERE group_name IS NOT NULL) GROUP BY lower(n)""")
def created_groups(spark, d):
    """Groups created of suggested names and nations, as far as their names are new."""
    g = table(spark, d, "event_groups")
    wanted = g.select("event_year", F.col("ai_suggested_name").alias("group_name"))
    wanted = wanted.unionByName(table(spark, d, "nation").select(F.lit(2030).alias("event_year"), F.col("n_name").alias("group_name")))
    return lifecycle.created_groups(g, wanted)


@query("""WITH w AS (SELECT id, trim(ai_suggested_name) AS n FROM event_groups WHERE trim(ai_suggested_name) <> '')
, ok AS (SELECT w.id, w.n FROM w WHERE lower(n) IN (SELECT lower(n) FROM w GROUP BY 1 HAVING count(*) = 1) AND NOT EXISTS (SELECT 1 FROM event_groups g WHERE lower(trim(g.group_name)) = lower(w.n) AND g.id <> w.id))
SELECT g.id, coalesce(n, group_name) AS group_name, CASE WHEN n IS NOT NULL THEN event_year::VARCHAR || ' - ' || n ELSE folder_name END AS folder_name FROM event_groups g LEFT JOIN ok USING (id)""")
def renamed_groups(spark, d):
    """Groups renamed to their suggested names where nobody else has or gets them."""
    g = table(spark, d, "event_groups").select("id", "event_year", "group_name", "folder_name", "ai_suggested_name")
    return lifecycle.renamed_groups(g, g.select("id", F.col("ai_suggested_name").alias("new_name"))).select("id", "group_name", "folder_name")


@query("SELECT id FROM event_groups WHERE NOT (id % 2 = 0 AND id NOT IN (SELECT event_group_id FROM media_items WHERE event_group_id IS NOT NULL AND status <> 'excluded'))")
def deleted_groups(spark, d):
    """Groups left when those of even id are deleted if they are empty."""
    g = table(spark, d, "event_groups").select("id")
    return lifecycle.deleted_groups(g, _media(spark, d), g.filter("id % 2 = 0"))


@query("""SELECT id, CASE status WHEN 'indexed' THEN 'image_reviewed' WHEN 'image_reviewed' THEN 'video_reviewed' ELSE status END AS status FROM media_items""")
def completed_reviews(spark, d):
    """Statuses after the image review, and after the video review of what had been through the other before, are completed."""
    s = F.col("status")
    return _media(spark, d).select("id", F.when(s == "indexed", "image_reviewed").when(s == "image_reviewed", "video_reviewed").otherwise(s).alias("status"))


@query("SELECT id, CASE WHEN status = 'indexed' AND coalesce(image_flags, '') IN ('', '[]') THEN 'image_reviewed' ELSE status END AS status FROM media_items")
def promoted_items(spark, d):
    """Indexed items without flags need no review."""
    plain = (F.col("status") == "indexed") & F.coalesce("image_flags", F.lit("")).isin("", "[]")
    return _media(spark, d).select("id", F.when(plain, "image_reviewed").otherwise(F.col("status")).alias("status"))


@query("""SELECT id, CASE WHEN k THEN 'image_reviewed' ELSE status END AS status, CASE WHEN k THEN '[]' ELSE image_flags END AS image_flags
 FROM (SELECT *, coalesce(trim(burst_group_id) <> '', false) AND status = 'indexed' AS k FROM media_items)""")
def keep_all_bursts(spark, d):
    """All indexed members of bursts are kept: reviewed, their flags cleared."""
    kept = F.coalesce((F.trim("burst_group_id") != "") & (F.col("status") == "indexed"), F.lit(False))
    return _media(spark, d).select("id", F.when(kept, "image_reviewed").otherwise(F.col("status")).alias("status"), F.when(kept, "[]").otherwise(F.col("image_flags")).alias("image_flags"))


_TARGETS = """targets AS (SELECT m.id, 'organized/' || g.event_year::VARCHAR || '/' || g.folder_name || '/' || CASE WHEN row_number() OVER (PARTITION BY g.event_year, g.folder_name, m.filename ORDER BY m.id) > 1
 THEN m.id::VARCHAR || '_' ELSE '' END || m.filename AS p FROM media_items m JOIN event_groups g ON g.id = m.event_group_id WHERE m.status = 'grouped')"""


@query(f"WITH {_TARGETS} SELECT m.id, coalesce(p, final_path) AS final_path, coalesce(p, current_path) AS current_path, CASE WHEN p IS NOT NULL THEN 'filed' ELSE status END AS status FROM media_items m LEFT JOIN targets t ON t.id = m.id")
def finalised_items(spark, d):
    """Items after grouped ones are filed at their target paths."""
    m = _media(spark, d).select("id", "final_path", "current_path", "status").join(target_paths(spark, d), "id", "left")
    p = F.col("target_path")
    return m.select("id", F.coalesce(p, "final_path").alias("final_path"), F.coalesce(p, "current_path").alias("current_path"), F.when(p.isNotNull(), "filed").otherwise(F.col("status")).alias("status"))


@query(f"WITH {_TARGETS} SELECT id AS media_item_id, 'filed' AS action_name, NULL::VARCHAR AS old_value, p AS new_value, 'system' AS source, NULL::VARCHAR AS details FROM targets")
def filing_audit(spark, d):
    return lifecycle.audit_rows(target_paths(spark, d), "id", "filed", F.lit(None), F.col("target_path"), "system")


_ANSWERS = """answers AS (SELECT media_item_id AS id, arg_min(CASE WHEN confidence < 0.3 THEN 'low' WHEN confidence < 0.7 THEN 'Medium' ELSE 'high' END, estimate_id) AS sure, arg_min(CASE WHEN estimate_id % 3 = 0 THEN 'meme' WHEN estimate_id % 3 = 1 THEN 'photo' ELSE 'Screenshot' END, estimate_id) AS cls,
 arg_min(estimate_id % 2 = 0, estimate_id) AS blurry FROM date_estimate GROUP BY 1)"""


@query(f"""WITH {_ANSWERS} SELECT m.id, CASE WHEN m.blur_score BETWEEN 40 AND 60 AND a.blurry IS NOT NULL THEN a.blurry ELSE coalesce(m.blur_score < 50 AND NOT isnan(m.blur_score), false) END AS blurry,
 CASE WHEN m.screenshot_heuristic >= 0.6 AND NOT isnan(m.screenshot_heuristic) AND a.cls IS NOT NULL THEN lower(cls) IN ('screenshot', 'meme', 'graphic', 'document') AND lower(sure) IN ('high', 'medium')
 ELSE coalesce(m.screenshot_heuristic >= 0.8 AND NOT isnan(m.screenshot_heuristic), false) END AS not_a_photo FROM media_items m LEFT JOIN answers a USING (id) WHERE m.mime_type ILIKE 'image/%'""")
def picture_overrides(spark, d):
    """Blurry and not a photo, by outside answers for the images that are asked about (date estimates stand in), else by the scores."""
    e, n = table(spark, d, "date_estimate"), F.col("estimate_id") % 3
    sure = F.when(F.col("confidence") < 0.3, "low").when(F.col("confidence") < 0.7, "Medium").otherwise("high")
    said = F.struct(sure.alias("sure"), F.when(n == 0, "meme").when(n == 1, "photo").otherwise("Screenshot").alias("cls"), (F.col("estimate_id") % 2 == 0).alias("blurry"))
    answers = e.groupBy(F.col("media_item_id").alias("id")).agg(F.min_by(said, "estimate_id").alias("a")).select("id", "a.*")
    m = _media(spark, d).filter(F.col("mime_type").ilike("image/%")).select("id", "blur_score", "screenshot_heuristic").join(answers, "id", "left")
    blur, shot = F.col("blur_score"), F.when(~F.isnan("screenshot_heuristic"), F.col("screenshot_heuristic"))
    asked_blur, asked_shot = blur.between(40, 60) & F.col("blurry").isNotNull(), (shot >= 0.6) & F.col("cls").isNotNull()
    return m.select(
        "id", F.when(asked_blur, F.col("blurry")).otherwise(F.coalesce((blur < 50) & ~F.isnan(blur), F.lit(False))).alias("blurry"),
        F.when(asked_shot, media.is_not_a_photo(F.col("cls"), F.col("sure"))).otherwise(F.coalesce(shot >= 0.8, F.lit(False))).alias("not_a_photo"),
    )


# -- outside answers ---------------------------------------------------------------------------------------------------


@query("""WITH m AS (SELECT n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN 'Password MISSING for ' WHEN 1 THEN 'no password entered ' WHEN 2 THEN 'Invalid email/password ' WHEN 3 THEN 'Advanced Data Protection ' WHEN 4 THEN 'ADP on ' WHEN 5 THEN 'missing apple_id field '
 WHEN 6 THEN 'SRP error ' ELSE 'timeout ' END || n_name AS t FROM nation) SELECT n_nationkey, CASE WHEN n_nationkey % 8 IN (0, 1) THEN 'session_required' WHEN n_nationkey % 8 = 2 THEN 'invalid_credentials' WHEN n_nationkey % 8 IN (3, 4) THEN 'adp_unsupported' ELSE 'error' END AS status FROM m""")
def auth_statuses(spark, d):
    """Statuses named by the texts of sign-in errors."""
    said = ["Password MISSING for ", "no password entered ", "Invalid email/password ", "Advanced Data Protection ", "ADP on ", "missing apple_id field ", "SRP error ", "timeout "]
    at = F.element_at(F.array(*[F.lit(x) for x in said]), (F.col("n_nationkey") % 8 + 1).cast("int"))
    return table(spark, d, "nation").select("n_nationkey", text.auth_status(F.concat(at, "n_name")).alias("status"))


@query(r"""SELECT id, CASE WHEN regexp_full_match(date_taken, '\d{4}-\d{2}-\d{2}( |T)\d{2}:\d{2}:\d{2}') THEN try_cast(date_taken AS TIMESTAMP) WHEN regexp_full_match(date_taken, '\d{4}-\d{2}-\d{2}') THEN try_cast(date_taken AS TIMESTAMP) + INTERVAL 12 HOUR END AS at FROM media_items""")
def whole_second_times(spark, d):
    """Capture times of the forms without a fraction."""
    return _media(spark, d).select("id", dates.capture_time(F.col("date_taken"), fraction=False).alias("at"))


@query("""WITH f AS (SELECT id, 'provider-' || (id % 3)::VARCHAR AS p, coalesce(folder_name, '') || repeat('x', (id % 300)::INT) AS path FROM event_groups)
SELECT id, p || ':' || 'm' || id::VARCHAR AS model, CASE WHEN strlen(path) > 240 THEN '\\\\?\\' || path ELSE path END AS path FROM f""")
def model_ids_and_long_paths(spark, d):
    g, i = table(spark, d, "event_groups"), F.col("id")
    path = F.concat(F.coalesce("folder_name", F.lit("")), F.repeat(F.lit("x"), (i % 300).cast("int")))
    provider = F.concat(F.lit("provider-"), (i % 3).cast("string"))
    return g.select("id", text.model_id(provider, F.concat(F.lit("m"), i.cast("string"))).alias("model"), text.long_path(path).alias("path"))


@query("""WITH s AS (SELECT id, ai_suggested_name AS n, lower(ai_confidence) AS c, ai_needs_fallback AS f FROM event_groups)
SELECT a.id, CASE WHEN (a.n IS NULL OR coalesce(a.f = 1, false) OR coalesce(a.c = 'low', false)) AND b.n IS NOT NULL THEN b.n ELSE a.n END AS name FROM s a LEFT JOIN s b ON b.id = a.id + 1""")
def routed_names(spark, d):
    """The suggestion, or a second one (the next group's stands in) where it is missing, of low confidence or needs a fallback."""
    g = table(spark, d, "event_groups")
    said = F.struct(F.col("ai_suggested_name").alias("name"), F.col("ai_confidence").alias("confidence"), (F.col("ai_needs_fallback") == 1).alias("needs_fallback"))
    s = g.select("id", F.when(F.col("ai_suggested_name").isNotNull(), said).alias("s"))
    pairs = s.join(s.select((F.col("id") - 1).alias("id"), F.col("s").alias("t")), "id", "left")
    return pairs.select("id", naming.routed(F.col("s"), F.col("t"))["name"].alias("name"))


@query("""WITH g AS (SELECT id, item_count, trim(group_name) AS n, lower(ai_event_type) AS t, lower(ai_confidence) AS c, id % 9 = 0 AS broken FROM event_groups WHERE item_count >= 5)
SELECT id, CASE WHEN broken OR n IS NULL OR n = '' THEN [] ELSE [n] END AS scene_signals, CASE WHEN NOT broken AND t IN ('holiday','birthday','vacation','sports','school','family','anniversary','graduation','travel','day_trip','misc','other') THEN t END AS dominant_context,
 CASE WHEN NOT broken AND c IN ('high','medium','low') THEN c END AS naming_confidence, CASE WHEN broken OR id % 2 = 0 THEN 'No reasoning provided.' ELSE 'seen' END AS reasoning, NOT broken AND id % 3 = 0 AS needs_fallback FROM g""")
def cluster_clues(spark, d):
    """Clues about clusters of five items or more (the groups' own columns stand in for outside answers, some of them broken)."""
    g, i = table(spark, d, "event_groups").filter(F.col("item_count") >= payloads.CLUES_FROM), F.col("id")
    json = F.to_json(F.struct(
        F.array(F.concat(F.lit(" "), "group_name"), F.lit("  ")).alias("scene_signals"), F.col("ai_event_type").alias("dominant_context"), F.col("ai_confidence").alias("naming_confidence"),
        F.when(i % 2 != 0, "seen").alias("reasoning"), F.when(i % 3 == 0, True).alias("needs_fallback"),
    ))
    c = payloads.cluster_clues(F.when(i % 9 == 0, F.substring(json, 1, 5)).otherwise(json))
    return g.select("id", *[c[k].alias(k) for k in ("scene_signals", "dominant_context", "naming_confidence", "reasoning", "needs_fallback")])
