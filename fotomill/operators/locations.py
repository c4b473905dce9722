"""Where clusters were taken, and whether that is away from home."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotomill.functions.geo import geocode_key, haversine_miles
from fotomill.operators.ordering import is_even_sample, position_in_group, upper_median


def home_config(settings: DataFrame) -> DataFrame:
    """One row (lat, lon, radius, label) from key/value settings, none unless both coordinates are numbers; radius 25 by default."""
    value = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    keys = ("home_latitude", "home_longitude", "home_radius_miles", "home_label", "home_address_raw")
    row = settings.agg(*[value(k).alias(k) for k in keys])
    text = lambda k: F.when(F.trim(k) != "", F.col(k))
    return row.select(
        F.col("home_latitude").try_cast("double").alias("lat"),
        F.col("home_longitude").try_cast("double").alias("lon"),
        F.coalesce(F.col("home_radius_miles").try_cast("double"), F.lit(25.0)).alias("radius"),
        F.coalesce(text("home_label"), text("home_address_raw")).alias("label"),
    ).filter("lat IS NOT NULL AND lon IS NOT NULL")


def dominant_places(places: DataFrame, group: list[str], city: str, pos: str) -> DataFrame:
    """(group, dominant_location, place_confidence, location_consistency) by votes of rows with a city, case ignored.

    The spelling seen first counts; of cities with equal votes the one seen first.
    """
    named = places.filter(F.col(city).isNotNull())
    votes = named.groupBy(*group, F.lower(city).alias("__k")).agg(F.count("*").alias("n"), F.min(F.struct(F.col(pos).alias("p"), F.col(city).alias("c"))).alias("f"))
    best = votes.groupBy(*group).agg(F.max_by("f.c", F.struct("n", -F.col("f.p"))).alias("dominant_location"), F.max("n").alias("top"), F.sum("n").alias("all"), F.count("*").alias("cities"))
    ratio = F.col("top") / F.col("all")
    return best.select(
        *group, "dominant_location",
        F.when(ratio > 0.7, "high").when(ratio > 0.4, "medium").otherwise("low").alias("place_confidence"),
        F.when(F.col("cities") == 1, "consistent").otherwise("mixed").alias("location_consistency"),
    )


def with_cached_places(items: DataFrame, lat: Column, lon: Column, cache: DataFrame) -> DataFrame:
    """items with coord_key, city, country and cached: whether the cache (coord_key, city, country) knows the rounded coordinates.

    An answer without a place is cached too: city is null then and cached true, so that nobody asks again. A key with several entries has the
    one that sorts first. Items without coordinates have no key and are not cached.
    """
    known = cache.filter("coord_key IS NOT NULL").groupBy("coord_key").agg(F.min(F.struct("city", "country")).alias("__p"), F.lit(True).alias("cached"))
    out = items.withColumn("coord_key", geocode_key(lat, lon)).join(known, "coord_key", "left")
    return out.select(*items.columns, "coord_key", "__p.city", "__p.country", F.coalesce("cached", F.lit(False)).alias("cached"))


def cache_with_answers(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with the answers (coord_key, city, country) to keys it did not have, those without a place included."""
    fresh = answers.filter("coord_key IS NOT NULL").groupBy("coord_key").agg(F.min(F.struct("city", "country")).alias("p")).select("coord_key", "p.city", "p.country")
    return cache.unionByName(fresh.join(cache, "coord_key", "left_anti"))


def location_facts(items: DataFrame, group: list[str], order: list[str], at: str, lat: str, lon: str, city: str, home: tuple[float, float, float, str | None], votes: int = 5) -> DataFrame:
    """Facts of each cluster: GPS coverage, dominant place among an even sample of `votes` located items, median distance from
    home (upper median), away and travel marks, duration. `city` is the item's looked-up place.

    away: median beyond the radius and at least 60 % outside, or a confidently dominant place other than the home label.
    travel: away for two days or more. Without any coordinates both are null and false.
    """
    h_lat, h_lon, radius, label = home
    day = F.to_date(at)
    facts = items.groupBy(*group).agg(
        (100.0 * F.count(lat) / F.count("*")).alias("gps_coverage_percent"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("duration_days"),
        F.count_distinct(day).alias("distinct_days"),
    )
    miles = haversine_miles(F.lit(h_lat), F.lit(h_lon), F.col(lat), F.col(lon))
    located = items.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(*group, *order, city, miles.alias("miles"))
    outside = located.groupBy(*group).agg(F.avg(F.when(F.col("miles") > radius, 1.0).otherwise(0.0)).alias("outside"))
    ranked = position_in_group(located.select(*group, *order, city), group, order)
    sampled = ranked.filter(is_even_sample(F.col("pos"), F.col("size"), F.least(F.col("size"), F.lit(votes))))
    places = dominant_places(sampled, group, city, "pos")
    by_miles = upper_median(located, group, "miles", order)
    joined = facts.join(outside, group, "left").join(by_miles.select(*group, "miles"), group, "left").join(places, group, "left")
    far = (F.col("miles") > radius) & (F.col("outside") >= 0.6)
    elsewhere = F.coalesce((F.col("place_confidence") == "high") & (F.lower("dominant_location") != F.lower(F.lit(label))), F.lit(False))
    away = F.when(F.col("miles").isNotNull(), far | elsewhere)
    consistency = F.coalesce("location_consistency", F.lit("none"))
    return joined.select(
        *group, "gps_coverage_percent", "dominant_location", "place_confidence", F.col("miles").alias("median_miles"),
        away.alias("away_from_home"), consistency.alias("location_consistency"), "duration_days", "distinct_days",
        (F.coalesce(away, F.lit(False)) & (F.col("duration_days") >= 2) & (consistency != "none")).alias("maybe_travel"),
    )
