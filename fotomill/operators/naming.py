"""Names of events by ordered rules, and unique folder names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotomill.functions.dates import month_name
from fotomill.functions.text import BANNED_NAMES, CONFIDENCES, EVENT_TYPES, sanitize_folder_name, with_year, without_year


#: A name suggested for a cluster: from outside, or by offline_suggestion().
SUGGESTION = "struct<folder_name:string,confidence:string,event_type:string,reasoning:string>"


def offline_suggestion(year: Column, start_date: Column, away: Column, place: Column) -> Column:
    """What a cluster is called without any outside help: a trip if away with a known place, else the month's activities; of low confidence."""
    name = F.when(away & place.isNotNull(), F.concat(place, F.lit(" Trip"))).otherwise(F.concat(month_name(start_date), F.lit(" Activities")))
    return F.struct(
        F.concat(year.cast("string"), F.lit(" - "), name).alias("folder_name"), F.lit("low").alias("confidence"), F.lit("misc").alias("event_type"),
        F.lit("Named from dates and places alone.").alias("reasoning"),
    )


def cluster_names(clusters: DataFrame, suggestion: Column | None = None, away: Column | None = None, place: Column | None = None) -> DataFrame:
    """clusters (event_year, item_count, start_date, is_holiday) with suggested_name, base_name, confidence, event_type, reasoning and is_misc.

    First the size: fewer than three items are Misc, whatever the date. Then the suggestion (SUGGESTION; offline_suggestion() where there is
    none); a cluster touching the December holidays is Family Christmas unless the suggestion is of high confidence; a blank name is Misc.
    A name of low confidence and type misc is rewritten: a trip if away with a known place, else the month's memories; one of
    another type stays. is_misc goes by the type, by the name where there is no type.
    """
    no = F.lit(None).cast("string")
    away, place = (F.coalesce(away, F.lit(False)) if away is not None else F.lit(False)), (place if place is not None else no)
    year = F.col("event_year")
    titled = lambda name: F.concat(year.cast("string"), F.lit(" - "), name)
    given = lambda name, confidence, kind, why: F.struct(
        titled(F.lit(name)).alias("folder_name"), F.lit(confidence).alias("confidence"), F.lit(kind).alias("event_type"), F.lit(why).alias("reasoning")
    )
    offline = offline_suggestion(year, F.col("start_date"), away, place)
    said = offline if suggestion is None else F.coalesce(suggestion.cast(SUGGESTION), offline)
    sure = F.coalesce(F.lower(said["confidence"]) == "high", F.lit(False))
    chosen = (
        F.when(F.col("item_count") < 3, given("Misc", "medium", "misc", "Small cluster."))
        .when(F.col("is_holiday") & ~sure, given("Family Christmas", "high", "holiday", "Taken in the December holidays."))
        .otherwise(said)
    )
    out = clusters.withColumn("__c", chosen).select(*clusters.columns, "__c.*")
    name = F.when(F.coalesce(F.trim("folder_name"), F.lit("")) == "", titled(F.lit("Misc"))).otherwise(F.col("folder_name"))
    out = out.withColumn("suggested_name", name).drop("folder_name")
    low = F.coalesce(F.lower("confidence") == "low", F.lit(False))
    misc = F.lower("event_type") == "misc"
    rewritten = titled(F.when(away & place.isNotNull(), F.concat(place, F.lit(" Trip"))).otherwise(F.concat(month_name(F.col("start_date")), F.lit(" Memories"))))
    out = out.withColumn("base_name", F.when(low & F.coalesce(misc, F.lit(False)), rewritten).otherwise(F.trim("suggested_name")))
    return out.withColumn("is_misc", F.coalesce(misc, F.lower(without_year(F.col("base_name"), year)) == "misc").cast("int"))


def low_confidence_audit(named: DataFrame) -> DataFrame:
    """A row for the audit log of every name of low confidence: the suggested one, the one used instead (or kept), and why it was suggested."""
    return named.filter(F.lower("confidence") == "low").select(
        F.lit(None).cast("bigint").alias("media_item_id"), F.lit("event_name_low_confidence").alias("action_name"), F.col("suggested_name").alias("old_value"),
        F.col("base_name").alias("new_value"), F.lit("ai_event_naming").alias("source"), F.col("reasoning").alias("details"),
    )


def resolve_collisions(named: DataFrame, scope: list[str], name: str, order: list[Column]) -> DataFrame:
    """named with folder_name: in each scope the first of equal names (case and outer blanks ignored) keeps it, the second becomes
    '… (Early)', the third '… (Late)', later ones '… 2', '… 3' and so on, in the given order."""
    n = F.row_number().over(Window.partitionBy(*scope, F.lower(F.trim(name))).orderBy(*order))
    base = F.trim(name)
    folder = F.when(n == 1, base).when(n == 2, F.concat(base, F.lit(" (Early)"))).when(n == 3, F.concat(base, F.lit(" (Late)")))
    return named.withColumn("folder_name", folder.otherwise(F.concat(base, F.lit(" "), (n - 2).cast("string"))))


def validated_name(name: Column, confidence: Column, event_type: Column, year: Column) -> Column:
    """struct(folder_name, confidence, event_type, needs_fallback) of a suggested name: cleaned, with the year in front; unknown
    confidences are medium, unknown types null; a banned generic name has low confidence and needs a fallback."""
    given = F.trim(F.coalesce(name, F.lit("Misc")))
    clean = with_year(sanitize_folder_name(F.when(given == "", "Misc").otherwise(given)), year)
    known = F.lower(confidence)
    level = F.when(known.isin(CONFIDENCES), known).otherwise("medium")
    banned = F.lower(without_year(clean, year)).isin(BANNED_NAMES)
    kind = F.lower(event_type)
    return F.struct(
        clean.alias("folder_name"),
        F.when(banned, "low").otherwise(level).alias("confidence"),
        F.when(kind.isin(EVENT_TYPES), kind).alias("event_type"),
        (banned | (level == "low")).alias("needs_fallback"),
    )


def routed(primary: Column, fallback: Column) -> Column:
    """The fallback suggestion where the primary one is missing, needs one or is of low confidence, and a fallback is there."""
    weak = primary.isNull() | F.coalesce(primary["needs_fallback"], F.lit(False)) | F.coalesce(F.lower(primary["confidence"]) == "low", F.lit(False))
    return F.when(weak & fallback.isNotNull(), fallback).otherwise(primary)
