"""JSON payloads with defaults for what is missing or malformed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fotomill.functions.text import CONFIDENCES, EVENT_TYPES, PEOPLE_FOCUS

EXIF = (
    "DateTimeOriginal string, CreateDate string, ModifyDate string, ImageWidth bigint, ImageHeight bigint, MIMEType string, Duration string, "
    "VideoCodec string, CompressorName string, CodecID string, ContentIdentifier string, ComAppleQuickTimeContentIdentifier string, Make string, Model string"
)
CLUES = [
    "scene_signals", "event_candidates", "location_candidates", "holiday_candidates", "activity_candidates", "travel_indicators", "destination_candidates",
]

#: Clusters of fewer items are named without clues.
CLUES_FROM = 5


def filled(c: Column) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(c), F.lit(""))


def exif_record(json: Column) -> Column:
    """One exif record; a duration may be a number or a text, the codec has three names."""
    e = F.from_json(json, EXIF)
    return F.struct(
        e["DateTimeOriginal"].alias("date_time_original"), e["CreateDate"].alias("create_date"), e["ModifyDate"].alias("modify_date"),
        e["ImageWidth"].alias("width"), e["ImageHeight"].alias("height"), e["MIMEType"].alias("mime_type"),
        e["Duration"].try_cast("double").alias("duration_secs"),
        F.coalesce(e["VideoCodec"], e["CompressorName"], e["CodecID"]).alias("video_codec"),
        F.coalesce(e["ContentIdentifier"], e["ComAppleQuickTimeContentIdentifier"]).alias("content_identifier"),
        e["Make"].alias("camera_make"), e["Model"].alias("camera_model"),
    )


def camera(make: Column, model: Column) -> Column:
    """struct(camera_make, camera_model), trimmed; null if both are blank."""
    return F.when(filled(make).isNotNull() | filled(model).isNotNull(), F.struct(filled(make).alias("camera_make"), filled(model).alias("camera_model")))


def date_estimate(json: Column) -> Column:
    """(ai_date, confidence, reasoning) of a date estimate; no JSON gives no date, confidence 0 and a waiting note."""
    e = F.from_json(json, "ai_date string, confidence double, reasoning string")
    return F.struct(
        e["ai_date"].alias("ai_date"),
        F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(e["reasoning"], F.lit("Awaiting AI estimation")).alias("reasoning"),
    )


def string_list(json: Column) -> Column:
    """A JSON array of texts; anything else is an empty list."""
    return F.coalesce(F.from_json(json, "array<string>"), F.array().cast("array<string>"))


def trimmed_list(items: Column) -> Column:
    """Texts trimmed, blanks dropped, null as an empty list."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x != "")


def one_of(value: Column, allowed: list[str]) -> Column:
    """Lower-case value if it is allowed, else null."""
    v = F.lower(value)
    return F.when(v.isin(allowed), v)


def cluster_clues(json: Column) -> Column:
    """Clues about a cluster: lists trimmed, vocabularies checked."""
    schema = ", ".join(f"{c} array<string>" for c in CLUES) + ", dominant_context string, people_focus string, naming_confidence string, reasoning string, needs_fallback boolean"
    e = F.from_json(json, schema)
    return F.struct(
        *[trimmed_list(e[c]).alias(c) for c in CLUES],
        one_of(e["dominant_context"], EVENT_TYPES).alias("dominant_context"),
        one_of(e["people_focus"], PEOPLE_FOCUS).alias("people_focus"),
        one_of(e["naming_confidence"], CONFIDENCES).alias("naming_confidence"),
        F.coalesce(e["reasoning"], F.lit("No reasoning provided.")).alias("reasoning"),
        F.coalesce(e["needs_fallback"], F.lit(False)).alias("needs_fallback"),
    )


def city_country(json: Column) -> Column:
    """struct(city, country) of a reverse geocoding answer, null unless both are there."""
    e = F.from_json(json, "results array<struct<name:string,country:string>>, address struct<city:string,town:string,village:string,country:string>")
    r, a = F.get(e["results"], F.lit(0)), e["address"]
    first = F.when(filled(r["name"]).isNotNull() & filled(r["country"]).isNotNull(), F.struct(filled(r["name"]).alias("city"), filled(r["country"]).alias("country")))
    city = filled(F.coalesce(a["city"], a["town"], a["village"]))
    second = F.when(city.isNotNull() & filled(a["country"]).isNotNull(), F.struct(city.alias("city"), filled(a["country"]).alias("country")))
    return F.coalesce(first, second)


def first_place(json: Column) -> Column:
    """struct(lat, lon, display_name) of the first forward geocoding hit, null without readable coordinates."""
    hit = F.get(F.from_json(json, "array<struct<lat:string,lon:string,display_name:string>>"), F.lit(0))
    lat, lon = hit["lat"].try_cast("double"), hit["lon"].try_cast("double")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon"), hit["display_name"].alias("display_name")))
