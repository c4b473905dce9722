"""Problem 2: references to records that do not exist, or that came later than the row that names them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotomill.session import hot_split_join


@dataclass(frozen=True)
class Reference:
    """Column `key` of `child` refers to `parent_key` of `parent`.

    child_id names the referring row, child_time is when it referred, parent_time when the parent came to be
    (text `YYYY-MM-DD HH:MM:SS`, UTC).
    """

    child_table: str
    child: DataFrame
    child_id: str
    key: str
    child_time: str
    parent_table: str
    parent: DataFrame
    parent_key: str
    parent_time: str


def _time(name: str):
    return F.try_to_timestamp(F.trim(F.col(name)), F.lit("yyyy-MM-dd HH:mm:ss"))


def _children(refs: list[Reference]) -> DataFrame:
    return reduce(
        DataFrame.unionByName,
        [
            r.child.filter(F.col(r.key).isNotNull()).select(
                F.lit(r.child_table).alias("table_name"),
                F.lit(r.parent_table).alias("parent_table"),
                F.col(r.child_id).alias("record_id"),
                F.col(r.key).alias("missing_key"),
                _time(r.child_time).alias("at"),
            )
            for r in refs
        ],
    )


def suspect_keys(refs: list[Reference]) -> DataFrame:
    """(parent_table, missing_key, parent_at, uses) of the keys that some row refers to too early or in vain, with the number of such rows.

    Parents and children are united in one tagged long form and grouped by parent table and key, with partial
    aggregation before the shuffle, so that a key held by a third of all rows is as cheap as any. Groups without
    the parent flag are missing keys (parent_at null); groups whose first reference lies before the parent's
    creation are kept with its time. Of parents delivered twice the earliest time counts; a parent without a
    readable time was always there.
    """
    parents = reduce(
        DataFrame.unionByName,
        [
            p.filter(F.col(k).isNotNull()).select(
                F.lit(name).alias("parent_table"),
                F.col(k).alias("missing_key"),
                F.lit(1).alias("is_parent"),
                _time(t).alias("parent_at"),
                F.lit(None).cast("timestamp").alias("child_at"),
            )
            for name, p, k, t in {r.parent_table: (r.parent_table, r.parent, r.parent_key, r.parent_time) for r in refs}.values()
        ],
    )
    children = _children(refs).select(
        "parent_table",
        "missing_key",
        F.lit(0).alias("is_parent"),
        F.lit(None).cast("timestamp").alias("parent_at"),
        F.col("at").alias("child_at"),
    )
    grouped = (
        parents.unionByName(children)
        .groupBy("parent_table", "missing_key")
        .agg(
            F.max("is_parent").alias("has_parent"),
            F.min("parent_at").alias("parent_at"),
            F.min("child_at").alias("first_at"),
            F.min("is_parent").alias("unreferred"),
            F.sum(1 - F.col("is_parent")).alias("uses"),
        )
    )
    return grouped.filter("unreferred = 0 AND (has_parent = 0 OR first_at < parent_at)").select(
        "parent_table", "missing_key", F.when(F.col("has_parent") == 1, F.col("parent_at")).alias("parent_at"), "uses"
    )


def orphan_references(refs: list[Reference]) -> DataFrame:
    """(table_name, record_id, missing_key, orphan_kind, period) of every reference to a missing or later record.

    orphan_kind: `missing`, the key is not null and has no row; `late`, it has one that was created after the
    referring row's time. period: year and month (YYYY-MM) of that time, null if it can't be read (such a row
    can be missing but not late). Null keys refer to nothing. Rows delivered twice come out once. Extra columns
    don't matter; empty tables give no rows, and an empty parent makes every reference missing.

    The rows meet the suspect keys in a join in which the rows of a hot key are spread over many tasks by record; how many rows a key has is known from
    the grouping before.
    """
    total = sum(r.child.count() for r in refs)
    rows = hot_split_join(_children(refs), suspect_keys(refs), ["parent_table", "missing_key"], "uses", total, F.col("record_id"))
    late = F.col("parent_at").isNotNull()
    return (
        rows.filter(~late | (F.col("parent_at") > F.col("at")))
        .select(
            "table_name",
            "record_id",
            "missing_key",
            F.when(late, "late").otherwise("missing").alias("orphan_kind"),
            F.date_format("at", "yyyy-MM").alias("period"),
        )
        .distinct()
    )


def orphan_counts(refs: list[Reference]) -> DataFrame:
    """(table_name, orphan_kind, period, orphans, missing_keys): the references of orphan_references() per table and month."""
    per_key = orphan_references(refs).groupBy("table_name", "orphan_kind", "period", "missing_key").agg(F.count("*").alias("n"))
    return per_key.groupBy("table_name", "orphan_kind", "period").agg(
        F.sum("n").alias("orphans"), F.count("*").alias("missing_keys")
    )
