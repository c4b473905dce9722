"""Positions, pages and samples of ordered rows, without one task seeing them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotomill.session import cut_lineage


def global_ordinal(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """df with each row's position, from 1, in the order of `order` (ascending, nulls first; should be unique).

    Rows are sorted across all tasks; each partition counts its own, and only the partitions' counts are summed up in one place.
    """
    parts = cut_lineage(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    counts = parts.groupBy("__part").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    # one row a partition: as small as the number of tasks
    return parts.withColumn("__own", own).join(F.broadcast(before.drop("__n")), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")


def position_in_group(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """df with pos, from 0, of each row in its group, and size of the group; a group may hold most rows."""
    ordered = cut_lineage(global_ordinal(df, [*group, *order], "__ord"))
    keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(group)]
    sizes = ordered.groupBy(*group).agg(F.min("__ord").alias("__first"), F.count("*").alias("size")).select(*keys, "__first", "size")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(group)])
    return ordered.join(sizes, same).drop(*[f"__k{i}" for i in range(len(group))]).withColumn("pos", F.col("__ord") - F.col("__first")).drop("__ord", "__first")


def numbered_in_group(df: DataFrame, group: list[str], order: list[str], name: str = "pos", parts: int = 500) -> DataFrame:
    """df with each row's position, from 0, in its group in the order of `order` (should be unique within a group).

    Groups are numbered by a window each; those of more than a `parts`-th of all rows (at most `parts`, whose keys alone are
    broadcast) by position_in_group(), which spreads them over many tasks.
    """
    sizes = df.groupBy(*group).agg(F.count("*").alias("__n"))
    total, largest = sizes.agg(F.sum("__n"), F.max("__n")).first()
    by_window = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    hot_at = max(100_000, (total or 0) // parts)
    if (largest or 0) <= hot_at:
        return df.withColumn(name, by_window)
    hot = sizes.filter(F.col("__n") > hot_at).select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(group)])
    hot = cut_lineage(hot)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(group)])
    cold = df.join(F.broadcast(hot), same, "left_anti").withColumn(name, by_window)
    large = position_in_group(df.join(F.broadcast(hot), same, "left_semi"), group, order).drop("size")
    return cold.unionByName(large.withColumn(name, F.col("pos").cast("int")).select(cold.columns))


def even_positions(size: Column, target: Column) -> Column:
    """Positions round(i (size-1) / (target-1)) of an even sample: all if target >= size, the first if target is 1; distinct."""
    last = size - 1
    picked = F.transform(F.sequence(F.lit(0), F.greatest(target - 1, F.lit(0)).cast("int")), lambda i: F.floor(i * last / F.greatest(target - 1, F.lit(1)) + 0.5).cast("bigint"))
    every = F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"))
    return F.when((size <= 0) | (target <= 0), F.array().cast("array<bigint>")).when(target >= size, every).otherwise(F.array_distinct(picked))


def is_even_sample(pos: Column, size: Column, target: Column) -> Column:
    """Whether a position belongs to the even sample; without building the positions of large groups."""
    t1 = F.greatest(target - 1, F.lit(1))
    # the only index that can round to pos is near pos (t-1) / (size-1)
    i = F.floor(pos * t1 / F.greatest(size - 1, F.lit(1)) + 0.5)
    hit = lambda k: k.between(0, t1) & (F.floor(k * (size - 1) / t1 + 0.5) == pos)
    return F.when(target >= size, F.lit(True)).when(target == 1, pos == 0).otherwise(hit(i) | hit(i - 1) | hit(i + 1))


def first_by_order(df: DataFrame, order: list[Column], n: int, skip: int = 0) -> DataFrame:
    """Rows skip … skip+n-1 in the given order: a page, a work window or the top n."""
    out = df.orderBy(*order)
    return (out.offset(skip) if skip else out).limit(n)


def work_window(items: DataFrame, done: DataFrame, record_id: str, order: list[Column], n: int) -> DataFrame:
    """The first n items, in the given order, whose record_id is not in `done`."""
    return first_by_order(items.join(done.select(record_id), record_id, "left_anti"), order, n)


def upper_median(df: DataFrame, group: list[str], value: str, tie: list[str]) -> DataFrame:
    """(group, value): of each group the element at floor(n/2) of its sorted non-null values, without interpolation.

    tie: columns that tell rows of equal value apart, so that a group with one value alone can be spread over tasks.
    """
    ranked = position_in_group(df.filter(F.col(value).isNotNull()).select(*group, value, *tie), group, [value, *tie])
    return ranked.filter("pos = floor(size / 2)").select(*group, value)
