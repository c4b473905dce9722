"""Problem 3: mixed timestamp formats and time zones, brought to one UTC instant per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotomill.functions.timestamps import with_instant
from fotomill.session import hot_split_join, lookup


def device_zones(devices: DataFrame) -> DataFrame:
    """(device, zone, date_order), one row per device id; of repeated devices the least values count."""
    return devices.groupBy(F.col("device_id").alias("device")).agg(
        F.min("time_zone").alias("zone"), F.min("date_order").alias("date_order")
    )


def with_zones(rows: DataFrame, total: int, devices: DataFrame, device: str, spread: str) -> DataFrame:
    """rows (`total` of them at most) with zone and date_order of their device, null for null and unknown ones. A device may hold a third of all rows."""
    zones = device_zones(devices).withColumnRenamed("device", device)
    return lookup(rows, zones, device, F.col(spread), total, devices.count())


def normalise(rows: DataFrame, keep: list[str]) -> DataFrame:
    """(record_id BIGINT, utc_micros BIGINT, has_time BOOLEAN, *keep) of each record whose value names a day or instant.

    rows: (record_id, value, as_utc, zone, date_order, *keep). zone and date_order hold for values without their own; null zones mean UTC, and null
    orders day first. as_utc: rows for which UTC takes the zone's place.
    Values that are null, blank, partial or impossible give no row. Repeated records are kept as they come. Empty tables give no rows.
    """
    zone = F.when(~F.coalesce("as_utc", F.lit(False)), F.col("zone"))
    return with_instant(rows, "value", zone, F.col("date_order")).select("record_id", "utc_micros", "has_time", *keep)


def _readable(df: DataFrame) -> DataFrame:
    """Rows whose value is long enough to name a day."""
    return df.filter(F.length(F.trim("value")) >= 8)


def item_zones(media: DataFrame, devices: DataFrame) -> DataFrame:
    """(media_item_id, zone, date_order), one row per item with a device; of repeated ids the least device counts."""
    items = media.filter("id IS NOT NULL AND source_device IS NOT NULL").groupBy(F.col("id").alias("media_item_id")).agg(F.min("source_device").alias("device"))
    return with_zones(items, media.count(), devices, "device", "media_item_id").drop("device")


def _by_item(rows: DataFrame, total: int, media: DataFrame, devices: DataFrame) -> DataFrame:
    """rows (record_id, media_item_id, …), `total` of them at most, with the zone of their item; an item may hold a third of all rows."""
    uses = rows.groupBy("media_item_id").agg(F.count("*").alias("uses"))
    zones = item_zones(media, devices)
    return hot_split_join(rows, zones.join(uses, "media_item_id"), "media_item_id", "uses", total, F.col("record_id"), "left", uses)


def capture_times(media: DataFrame, devices: DataFrame, keep: dict[str, Column] | None = None) -> DataFrame:
    """normalise() of media_items.date_taken: the source `fixture` (in any case, outer blanks ignored) means UTC."""
    rows = media.select(
        F.col("id").alias("record_id"), F.col("date_taken").alias("value"), (F.lower(F.trim("date_taken_source")) == "fixture").alias("as_utc"),
        F.col("source_device").alias("__device"), *[c.alias(k) for k, c in (keep or {}).items()],
    )
    return normalise(with_zones(_readable(rows), media.count(), devices, "__device", "record_id"), list(keep or {}))


def created_times(metadata: DataFrame, media: DataFrame, devices: DataFrame) -> DataFrame:
    """normalise() of metadata_info.create_date by the device of the record's item; a video's own type means UTC.

    Records delivered twice count once.
    """
    video = F.lower(F.trim("mime_type")).startswith("video/").alias("as_utc")
    rows = metadata.select(F.col("record_id"), "media_item_id", F.col("create_date").alias("value"), video).dropDuplicates()
    return normalise(_by_item(_readable(rows), metadata.count(), media, devices), [])


def estimated_times(estimates: DataFrame, media: DataFrame, devices: DataFrame) -> DataFrame:
    """normalise() of date_estimate.ai_date by the device of the estimate's item. Equal rows count once."""
    rows = estimates.select(F.col("estimate_id").alias("record_id"), "media_item_id", F.col("ai_date").alias("value"), F.lit(False).alias("as_utc")).dropDuplicates()
    return normalise(_by_item(_readable(rows), estimates.count(), media, devices), [])
