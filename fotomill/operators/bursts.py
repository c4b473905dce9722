"""Bursts: pictures taken within seconds of one another that look alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Defaults of the library.
WINDOW_SECONDS, HASH_DISTANCE = 3, 10


def islands(items: DataFrame, by: list[str], at: str, record_id: str, seconds: int) -> DataFrame:
    """items with island: a time at which its run of items, none more than `seconds` whole seconds after the one before, began.

    No burst crosses an island's border. Slots as long as the gap are pre-aggregated to one row each; windows run within a
    day, and days are tied together by a table of one row a day.
    """
    gap, day = (seconds + 1) * 1_000_000, 86_400_000_000
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))
    rows = items.filter(F.col(at).isNotNull()).withColumn("__t", micros).withColumn("__slot", F.floor(F.col("__t") / gap))
    slots = rows.groupBy(*by, "__slot").agg(F.min("__t").alias("a"), F.max("__t").alias("b")).withColumn("__day", F.floor(F.col("a") / day))
    w, wd = Window.partitionBy(*by, "__day").orderBy("a"), Window.partitionBy(*by).orderBy("__day")
    days = slots.groupBy(*by, "__day").agg(F.max("b").alias("b")).withColumn("__before", F.lag("b").over(wd)).drop("b")
    slots = slots.withColumn("__own", F.lag("b").over(w)).join(days, [*by, "__day"])
    before = F.coalesce("__own", "__before")
    slots = slots.withColumn("start", F.when(before.isNull() | (F.col("a") - before >= gap), F.col("a")))
    carried = slots.groupBy(*by, "__day").agg(F.max("start").alias("s"))
    carried = carried.withColumn("__carry", F.last("s", True).over(wd.rowsBetween(Window.unboundedPreceding, -1))).drop("s")
    slots = slots.withColumn("__run", F.last("start", True).over(w)).join(carried, [*by, "__day"])
    slots = slots.select(*by, "__slot", F.coalesce("__run", "__carry").alias("island"))
    return rows.join(slots, [*by, "__slot"]).drop("__slot", "__t")


def fold_runs(rows: DataFrame, keys: list[str], columns: list[str], kernel: Callable, schema: str) -> DataFrame:
    """What `kernel` makes of runs of rows, each run whole and in the order of `columns`, many runs at a time.

    keys: the run of a row. columns: BIGINT or DOUBLE columns, of which the first two give the order within a run. kernel: (start of each run, arrays) to
    arrays as in `schema`. Runs are spread over tasks by key and pass as Arrow batches; a task keeps the rows of the run that is not over yet.
    """
    run = F.xxhash64(*keys).alias("__run")
    sorted_ = rows.select(run, *columns).repartition("__run").sortWithinPartitions("__run", *columns[:2])
    names = [f.split()[0] for f in schema.split(", ")]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            now = now if kept is None else [np.concatenate(x) for x in zip(kept, now, strict=True)]
            whole = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            kept = [c[whole:] for c in now]
            if whole:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in _kernel([c[:whole] for c in now])], names)
        if kept is not None and len(kept[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _kernel(kept)], names)

    def _kernel(arrays):
        ids = arrays[0]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return kernel(starts, *arrays[1:])

    return sorted_.mapInArrow(fold, schema)


def chains(starts: np.ndarray, t: np.ndarray, ids: np.ndarray, h: np.ndarray, blur: np.ndarray, seconds: int, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first ids, whether best) of the burst members of runs given by their starts, in time order.

    Which item follows a member depends on that member alone: the first later one within `seconds` of it that looks like it. So all
    followers are found at once, by distance in the order. A burst starts at the first item that has a follower, and after it the next
    one is looked for beyond all items within `seconds` of its last member; those passed over are used up.
    """
    n = len(t)
    end_of_run = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n)))
    follower, beyond = np.full(n, -1), np.arange(1, n + 1)
    open_, d = np.arange(n), 0
    while len(open_):
        d += 1
        open_ = open_[open_ + d < end_of_run[open_]]
        open_ = open_[(t[open_ + d] - t[open_]) // 1_000_000 <= seconds]
        beyond[open_] = open_ + d + 1
        like = (follower[open_] < 0) & (np.bitwise_count(h[open_].view(np.uint64) ^ h[open_ + d].view(np.uint64)) <= distance)
        follower[open_[like]] = open_[like] + d
    last = np.arange(n)
    for i in np.flatnonzero(follower >= 0)[::-1]:
        last[i] = last[follower[i]]
    has = np.append(np.flatnonzero(follower >= 0), n)
    anchors, at = [], 0
    while (i := int(has[np.searchsorted(has, at)])) < n:
        anchors.append(i)
        at = int(beyond[last[i]])
    first = np.full(n, -1)
    front = np.array(anchors, np.int64)
    first[front] = front
    while len(front):
        front = front[follower[front] >= 0]
        first[follower[front]] = first[front]
        front = follower[front]
    members = np.flatnonzero(first >= 0)
    order = members[np.lexsort((members, blur[members], first[members]))]  # within a burst the last of the sharpest comes last
    best = np.zeros(n, bool)
    if len(order):
        best[order[np.append(first[order][1:] != first[order][:-1], True)]] = True
    return ids[members], ids[first[members]], best[members]


def bursts(items: DataFrame, by: list[str], at: str, record_id: str, hash_col: str, blur: str, seconds: int = WINDOW_SECONDS, distance: int = HASH_DISTANCE) -> DataFrame:
    """(record_id, burst_id, is_primary) of the items in bursts of two or more. Items without time or hash take no part.

    by: columns within which bursts are looked for; none means the whole library. burst_id is the burst's first record. Islands of one item
    are dropped before Python sees any; the greedy rule needs each island in one task, which passes it as a stream of numbers, and
    an island is as long as pictures follow one another without a pause.
    """
    blur_or_0 = F.when(F.isnan(blur), 0.0).otherwise(F.coalesce(F.col(blur), F.lit(0.0)))
    rows = islands(items.filter(F.col(hash_col).isNotNull()), by, at, record_id, seconds)
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))
    slim = rows.select(*by, "island", micros.alias("t"), F.col(record_id).alias("i"), F.col(hash_col).alias("h"), blur_or_0.alias("s"))
    sizes = slim.groupBy(*by, "island").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    slim = slim.join(sizes, [*by, "island"], "left_semi")
    kernel = lambda starts, t, i, h, s: chains(starts, t, i, h, s, seconds, distance)
    return fold_runs(slim, [*by, "island"], ["t", "i", "h", "s"], kernel, "record_id bigint, burst_id bigint, is_primary boolean")


def best_shots(primaries: DataFrame, members: DataFrame, answers: DataFrame, group: str, record_id: str) -> DataFrame:
    """primaries (group, record_id) with the chosen shot in place of the sharpest where answers (group, record_id) has one that is a member;
    of several answers the least id counts."""
    known = answers.join(members.select(group, record_id), [group, record_id], "left_semi").groupBy(group).agg(F.min(record_id).alias("__a"))
    return primaries.join(known, group, "left").withColumn(record_id, F.coalesce("__a", record_id)).drop("__a")


def burst_runs(items: DataFrame, by: list[str], at: str, record_id: str, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """(by, start_micros, item_count) of the islands of two or more: bursts by time alone, without Python."""
    rows = islands(items, by, at, record_id, seconds)
    return rows.groupBy(*by, F.col("island").alias("start_micros")).agg(F.count("*").alias("item_count")).filter("item_count > 1")


def best_of_groups(items: DataFrame, group: str, record_id: str, order: list[str]) -> DataFrame:
    """(group, record_id): the record with the greatest order columns, of equals the greatest id."""
    return items.filter(F.col(group).isNotNull()).groupBy(group).agg(F.max_by(record_id, F.struct(*order, record_id)).alias(record_id))
