"""Events from capture times: clusters split at gaps between days, long clusters cut at their largest gap."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotomill.operators.bursts import fold_runs, islands
from fotomill.session import cut_lineage


def day_clusters(items: DataFrame, at: str, gap_days: int = 2, by: list[str] | None = None) -> DataFrame:
    """items with event_year and cluster_no (from 1 in each year, and `by`): a cluster ends where more than gap_days calendar days
    lie between one item's day and the next's. Rows without a time are dropped.

    Only distinct days matter, so windows run over one row per day (at most 366 a year) and the items get
    their cluster by a join on the day; a year of any size is one small window.
    """
    by = by or []
    rows = items.filter(F.col(at).isNotNull()).withColumn("event_year", F.year(at)).withColumn("__day", F.to_date(at))
    days = rows.select(*by, "event_year", "__day").distinct()
    w = Window.partitionBy(*by, "event_year").orderBy("__day")
    starts = F.coalesce((F.datediff("__day", F.lag("__day").over(w)) > gap_days).cast("int"), F.lit(1))
    days = days.withColumn("__starts", starts).withColumn("cluster_no", F.sum("__starts").over(w).cast("int")).drop("__starts")
    keys = [*by, "event_year", "__day"]
    d = days.select(*[F.col(c).alias(f"__{c}") for c in keys], "cluster_no")
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in keys]
    return rows.join(d, on).drop(*[f"__{c}" for c in keys], "__day")


def gaps_between_times(items: DataFrame, group: list[str], at: str) -> DataFrame:
    """(group, at, gap_micros): the distinct times of each group and the time since the one before; null for the first.

    Rows of one instant are one row here, by partial aggregation. The order is built in two levels, so that a group of any size is
    spread over its hours: within an hour by a window, across hours by the last time of the hour before, from a table of one row an hour.
    """
    times = items.filter(F.col(at).isNotNull()).select(*group, F.col(at).alias("at")).distinct()
    times = times.withColumn("__at", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at")))
    times = times.withColumn("__hour", F.floor(F.col("__at") / 3_600_000_000))
    hours = times.groupBy(*group, "__hour").agg(F.max("__at").alias("__last"))
    hours = hours.withColumn("__before", F.lag("__last").over(Window.partitionBy(*group).orderBy("__hour"))).drop("__last")
    own = F.lag("__at").over(Window.partitionBy(*group, "__hour").orderBy("__at"))
    joined = times.withColumn("__own", own).join(hours, [*group, "__hour"])
    return joined.select(*group, "at", (F.col("__at") - F.coalesce("__own", "__before")).alias("gap_micros"))


def split_long_spans(clustered: DataFrame, at: str, max_days: int = 14, by: list[str] | None = None) -> DataFrame:
    """clustered with part_no: 1 for the items from the first largest gap (in seconds) on, of clusters spanning more than max_days; else 0.

    Each cluster is cut at most once.
    """
    group = [*(by or []), "event_year", "cluster_no"]
    marked = _after_largest_gap(clustered, group, at)
    part = F.when((F.col("__days") > max_days) & F.col("__after"), 1).otherwise(0)
    return marked.withColumn("part_no", part).drop("__after", "__days", "__top")


def _after_largest_gap(items: DataFrame, group: list[str], at: str) -> DataFrame:
    """items with __after: at or after the first largest gap (in whole seconds, __top) of the group, and __days: the days it spans.

    A gap lies between two times, so the rows of one instant are all on the same side of it.
    """
    gap = F.coalesce(F.floor(F.col("gap_micros") / 1_000_000), F.lit(-1))
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("at"))
    cuts = gaps_between_times(items, group, at).groupBy(*group).agg(
        F.max_by("at", F.struct(gap.alias("g"), (-micros).alias("t"))).alias("__cut"),
        F.coalesce(F.max(F.floor(F.col("gap_micros") / 1_000_000)), F.lit(0)).alias("__top"),
        F.datediff(F.max(F.to_date("at")), F.min(F.to_date("at"))).alias("__days"),
    )
    return items.join(cuts, group).withColumn("__after", F.coalesce(F.col(at) >= F.col("__cut"), F.lit(False))).drop("__cut")


def resplit_generic(
    items: DataFrame, cluster: str, at: str, generic: Callable[[DataFrame], DataFrame], more_than: int = 20, max_rounds: int = 100
) -> DataFrame:
    """items whose clusters (a STRING column) of more than `more_than` items were cut at their largest gap for as long as their name is generic.

    generic: given cluster_stats() by cluster, the rows of the clusters whose name says nothing. The parts of 'c' are 'c.0' and 'c.1',
    named and cut again in the next round; clusters all of one second can't be cut. Only clusters still being cut are
    computed again; each round is written to the checkpoint folder.
    """
    open_, done = items, None
    for _ in range(max_rounds):
        stats = cluster_stats(open_, [cluster], at).filter(F.col("item_count") > more_than)
        vague = generic(stats).select(cluster).distinct()
        marked = _after_largest_gap(open_.join(vague, cluster, "left_semi"), [cluster], at).filter("__top > 0")
        cut = marked.withColumn("__new", F.concat(cluster, F.when(F.col("__after"), ".1").otherwise(".0")))
        cut = cut_lineage(cut.withColumn(cluster, F.col("__new")).drop("__new", "__after", "__top", "__days").select(items.columns))
        parents = cut.select(F.regexp_replace(cluster, r"\.[01]$", "").alias(cluster)).distinct()
        settled = open_.join(parents, cluster, "left_anti")
        done = settled if done is None else done.unionByName(settled)
        if not cut.limit(1).count():
            return done
        open_ = cut
    raise RuntimeError(f"clusters did not settle in {max_rounds} rounds")


def cluster_stats(clustered: DataFrame, group: list[str], at: str) -> DataFrame:
    """Size, first and last day, inclusive duration, distinct days and the December-holiday mark of each cluster."""
    day = F.to_date(at)
    return clustered.groupBy(*group).agg(
        F.count("*").alias("item_count"),
        F.min(day).alias("start_date"),
        F.max(day).alias("end_date"),
        (F.datediff(F.max(day), F.min(day)) + 1).cast("bigint").alias("duration_days"),
        F.count_distinct(day).alias("distinct_days"),
        F.bool_or((F.month(day) == 12) & (F.dayofmonth(day) >= 20)).alias("is_holiday"),
    )


def thin_near_duplicates(items: DataFrame, group: list[str], at: str, record_id: str, prefix: Column, seconds: int = 5) -> DataFrame:
    """items without those within `seconds` of an item kept before, in the same group and with the same prefix.

    Whether an item is kept depends on the last kept one, so each run of items whose neighbours are within `seconds` is
    folded in order, many runs at a time; a run ends wherever the camera paused. An item without a prefix is like no other and is kept; one
    without a time is dropped.
    """
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))
    runs = islands(items.withColumn("__prefix", prefix).filter("__prefix IS NOT NULL"), [*group, "__prefix"], at, record_id, seconds)
    runs = runs.select(*group, "__prefix", "island", micros.alias("t"), F.col(record_id).alias("i"))
    kernel = lambda starts, t, i: (i[kept_times(starts, t, seconds)],)
    kept = fold_runs(runs, [*group, "__prefix", "island"], ["t", "i"], kernel, f"{record_id} bigint")
    alone = items.filter(prefix.isNull() & F.col(at).isNotNull()).select(F.col(record_id).cast("bigint").alias(record_id))
    return items.filter(F.col(at).isNotNull()).join(kept.unionByName(alone), record_id, "left_semi").select(items.columns)


def kept_times(starts: np.ndarray, t: np.ndarray, seconds: int) -> np.ndarray:
    """Positions of the items kept in runs given by their starts: the first of each, then always the next more than `seconds` whole seconds later."""
    n = len(t)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    ends = np.append(starts[1:], n)
    # times moved apart by run, so that one search serves all
    span = int(t.max() - t.min()) + (seconds + 2) * 1_000_000 if n else 0
    moved = t - t.min() + run * span if n else t
    following = np.searchsorted(moved, moved + (seconds + 1) * 1_000_000)
    front, found = starts, []
    while len(front):
        found.append(front)
        nxt = following[front]
        front = nxt[nxt < ends[run[front]]]
    return np.sort(np.concatenate(found)) if found else np.zeros(0, np.int64)
