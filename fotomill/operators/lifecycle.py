"""Changes of the library as transforms from one version of a table to the next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotomill.operators.ordering import numbered_in_group


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, key: str, order: list[str]) -> DataFrame:
    """existing plus the rows of incoming with new keys, the first by `order` of each; null keys are never equal."""
    rest = [c for c in incoming.columns if c != key]
    nulls = incoming.filter(F.col(key).isNull())
    first = incoming.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    fresh = first.select(key, *[F.col(f"__r.{c}").alias(c) for c in rest]).join(existing.select(key), key, "left_anti")
    return existing.unionByName(fresh.select(existing.columns)).unionByName(nulls.select(existing.columns))


def upsert(base: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """base with the last change by `order` of each key in place of its row, and new keys added. base and changes have equal columns."""
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])
    return base.join(last.select(*key), key, "left_anti").unionByName(last.select(base.columns))


def with_counts(groups: DataFrame, items: DataFrame, group_key: str, item_key: str, counted: Column, name: str) -> DataFrame:
    """groups with the number of their items for which `counted` holds, 0 without any; aggregated before the join."""
    n = items.filter(counted & F.col(item_key).isNotNull()).groupBy(F.col(item_key).alias(group_key)).agg(F.count("*").alias("__n"))
    return groups.drop(name).join(n, group_key, "left").withColumn(name, F.coalesce("__n", F.lit(0).cast("bigint"))).drop("__n")


def change_where(items: DataFrame, wanted: DataFrame, item_key: str, changes: dict[str, Column], guard: Column | None = None) -> DataFrame:
    """items with `changes` applied to the rows whose key is in `wanted` (and for which guard holds); other rows as they are."""
    ids = wanted.select(F.col(wanted.columns[0]).alias(item_key)).distinct().withColumn("__hit", F.lit(True))
    hit = F.coalesce("__hit", F.lit(False)) & (guard if guard is not None else F.lit(True))
    out = items.join(ids, item_key, "left")
    return out.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in changes.items()}).drop("__hit").select(items.columns)


def all_or_nothing(items: DataFrame, wanted: DataFrame, item_key: str, allowed: Column) -> bool:
    """Whether every wanted key names an item for which `allowed` holds: the guard of a change that must not be partial."""
    ids = wanted.select(F.col(wanted.columns[0]).alias(item_key)).distinct()
    return ids.join(items.filter(allowed).select(item_key), item_key, "left_anti").limit(1).count() == 0


def target_paths(items: DataFrame, folder: Column, name: str, record_id: str, taken: DataFrame | None = None) -> DataFrame:
    """items with target_path `folder/name`; where that is taken, by another item of less id or in `taken`, `folder/<id>_name`."""
    rows = items.withColumn("__path", F.concat(folder, F.lit("/"), F.col(name)))
    rows = numbered_in_group(rows, ["__path"], [record_id], "__n")
    busy = F.col("__n") > 0
    if taken is not None:
        rows = rows.join(taken.select(F.col(taken.columns[0]).alias("__path")).distinct().withColumn("__t", F.lit(True)), "__path", "left")
        busy = busy | F.coalesce("__t", F.lit(False))
    other = F.concat(folder, F.lit("/"), F.col(record_id).cast("string"), F.lit("_"), F.col(name))
    return rows.withColumn("target_path", F.when(busy, other).otherwise(F.col("__path"))).select(*items.columns, "target_path")


def numbered_paths(items: DataFrame, name: str, record_id: str, most: int = 9999) -> DataFrame:
    """items with unique_name: the first of equal names keeps it, the others get _1, _2 … before the extension, `_overflow` past `most`."""
    rows, n = numbered_in_group(items, [name], [record_id], "__n"), F.col("__n")
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    suffix = F.when(n <= most, n.cast("string")).otherwise("overflow")
    return rows.withColumn("unique_name", F.when(n == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), suffix, ext))).select(*items.columns, "unique_name")


def resolve_paths(items: DataFrame, candidates: list[Column], listing: DataFrame) -> DataFrame:
    """items with resolved_path: the first candidate that is in the listing, else the first one."""
    files = listing.select(F.col(listing.columns[0]).alias("__f")).distinct()
    out = items
    for i, c in enumerate(candidates):
        out = out.withColumn(f"__c{i}", c).join(files.withColumnRenamed("__f", f"__f{i}"), F.col(f"__c{i}") == F.col(f"__f{i}"), "left")
    return out.withColumn("resolved_path", F.coalesce(*[F.col(f"__f{i}") for i in range(len(candidates))], F.col("__c0"))).select(*items.columns, "resolved_path")


def audit_rows(items: DataFrame, record_id: str, action: str, old: Column, new: Column, source: str, details: Column | None = None) -> DataFrame:
    """Rows for the audit log, to be appended with unionByName."""
    return items.select(
        F.col(record_id).alias("media_item_id"), F.lit(action).alias("action_name"), old.cast("string").alias("old_value"),
        new.cast("string").alias("new_value"), F.lit(source).alias("source"), (details if details is not None else F.lit(None).cast("string")).alias("details"),
    )


def created_groups(groups: DataFrame, wanted: DataFrame) -> DataFrame:
    """(event_year, group_name, folder_name) of the wanted groups (event_year, group_name) whose name, case and outer blanks ignored, no group has yet; of
    equal wanted names the one of the earliest year. Blank names are none."""
    key = F.lower(F.trim("group_name"))
    new = wanted.select("event_year", F.trim("group_name").alias("group_name"), key.alias("__k")).filter("__k <> ''")
    new = new.groupBy("__k").agg(F.min(F.struct("event_year", "group_name")).alias("g")).join(groups.select(key.alias("__k")), "__k", "left_anti")
    return new.select("g.*").withColumn("folder_name", F.concat(F.col("event_year").cast("string"), F.lit(" - "), "group_name"))


def renamed_groups(groups: DataFrame, names: DataFrame) -> DataFrame:
    """groups (id, event_year, group_name, folder_name, …) with the new names (id, new_name) that no other group has and no other is given."""
    key = lambda c: F.lower(F.trim(c))
    wanted = names.select("id", F.trim("new_name").alias("__n"), key("new_name").alias("__k")).filter("__k <> ''").dropDuplicates(["id"])
    once = wanted.groupBy("__k").agg(F.count("*").alias("__c")).filter("__c = 1").select("__k")
    holders = groups.select(key("group_name").alias("__k"), F.col("id").alias("__h"))
    held = wanted.join(holders, "__k").filter("id <> __h").select("id").distinct()
    good = wanted.join(once, "__k", "left_semi").join(held, "id", "left_anti").select("id", "__n")
    out = groups.join(good, "id", "left")
    folder = F.concat(F.col("event_year").cast("string"), F.lit(" - "), "__n")
    return out.withColumns({"group_name": F.coalesce("__n", "group_name"), "folder_name": F.coalesce(folder, "folder_name")}).select(groups.columns)


def deleted_groups(groups: DataFrame, items: DataFrame, wanted: DataFrame) -> DataFrame:
    """groups without the wanted ones (id) that have no item that is not excluded."""
    used = items.filter("event_group_id IS NOT NULL AND status <> 'excluded'").select(F.col("event_group_id").alias("id")).distinct()
    return groups.join(wanted.select("id").join(used, "id", "left_anti"), "id", "left_anti")


def typed_settings(settings: DataFrame, defaults: dict[str, float | int | str]) -> DataFrame:
    """One row with a column a setting: its value read as the default's type, else the default."""
    kinds = {float: "double", int: "bigint", str: "string"}
    read = [F.coalesce(F.max(F.when(F.col("key") == k, F.col("value").try_cast(kinds[type(v)]))), F.lit(v).cast(kinds[type(v)])).alias(k) for k, v in defaults.items()]
    return settings.agg(*read)


def changed_settings(settings: DataFrame, written: dict[str, str], cleared: list[str]) -> DataFrame:
    """settings (key, value) with some written and some cleared; clearing what is not there changes nothing."""
    spark = settings.sparkSession
    kept = settings.filter(~F.col("key").isin([*written, *cleared]))
    return kept.unionByName(spark.createDataFrame(list(written.items()), "key string, value string")) if written else kept
