"""Problem 4: the best representative of each group of duplicates, and the values that survive.

Fields are unpivoted to long rows (group, field, candidate, votes). Each row votes for its candidate with its source's trust times
a decay by age; votes are summed per candidate, max_by picks the winner of each field, and the winners of a group are
pivoted back into one row. All steps are partial aggregates: a group holding a third of all rows never comes
together in one task.

A candidate is a normalised value, for which all records that have it vote, or, where the question is whose value survives, the
value of one record.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ballot:
    """A vote that a row casts if `when` holds: trust times decay.

    level: votes of a higher number only decide between candidates whose votes of all lower numbers are equal.
    """

    trust: Column
    decay: Column | None = None
    level: int = 0
    when: Column | None = None

    @property
    def weight(self) -> Column:
        w = self.trust.cast("double") if self.decay is None else self.trust.cast("double") * self.decay
        return F.when(F.coalesce(self.when, F.lit(False)), w) if self.when is not None else w


@dataclass(frozen=True)
class Field:
    """A field of the merged record.

    usable: whether a row's value may survive (null values never do). value: the form in which values are equal (default:
    the column of that name). by_record: equal values of different records are different candidates. ballots: the votes
    that a row with a usable value casts.
    """

    name: str
    usable: Column
    value: Column | None = None
    by_record: bool = False
    ballots: list[Ballot] = field(default_factory=lambda: [Ballot(F.lit(1.0))])


def unpivot(df: DataFrame, group: Column, record_id: str, fields: list[Field]) -> DataFrame:
    """Long rows (grp, record_id, field, value, holder, level, vote), one a ballot, of the usable values; other columns don't matter.

    holder: the record whose value it is, null where equal values of all records are one candidate.
    """
    rows = [
        F.struct(
            F.lit(f.name).alias("field"),
            F.when(f.usable, (f.value if f.value is not None else F.col(f.name)).cast("double")).alias("value"),
            F.when(F.lit(f.by_record), F.col(record_id)).alias("holder"),
            F.lit(b.level).alias("level"),
            b.weight.alias("vote"),
        )
        for f in fields
        for b in f.ballots
    ]
    long = df.select(group.alias("grp"), F.col(record_id).alias("record_id"), F.explode(F.array(*rows)).alias("r"))
    return long.select("grp", "record_id", "r.*").filter("grp IS NOT NULL AND record_id IS NOT NULL AND value IS NOT NULL AND vote IS NOT NULL")


def field_winners(df: DataFrame, group: Column, record_id: str, fields: list[Field], digits: int | None = None) -> DataFrame:
    """(grp, one struct(value, votes, record_id) a field, records): the pivoted winners of each group.

    The winner of a field is the candidate with the most votes of level 0, then of level 1 and so on (a candidate without votes of a
    level comes after all that have some), then the one with the least record id; that is also the record named. digits:
    votes are compared rounded to so many digits, so that sums of equal votes in another order stay equal.
    records: how many records the group has, counted up to two. Fields without a usable value are null.
    Rows delivered twice vote once. Groups of one record survive as they are; null groups and records take no part.
    Empty tables give no rows.
    """
    levels = 1 + max(b.level for f in fields for b in f.ballots)
    long = unpivot(df, group, record_id, fields).distinct()
    votes = [F.sum(F.when(F.col("level") == k, F.col("vote"))) for k in range(levels)]
    votes = votes if digits is None else [F.round(v, digits) for v in votes]
    counted = long.groupBy("grp", "field", "value", "holder").agg(
        F.array(*votes).alias("votes"), F.min("record_id").alias("first"), F.max("record_id").alias("last")
    )
    order = F.struct(*[F.get("votes", F.lit(k)).alias(f"v{k}") for k in range(levels)], (-F.col("first")).alias("neg"))
    won = F.struct("value", "votes", F.col("first").alias("record_id"))
    return counted.groupBy("grp").agg(
        *[F.max_by(won, F.when(F.col("field") == f.name, order)).alias(f.name) for f in fields],
        F.when(F.min("first") < F.max("last"), 2).otherwise(1).alias("records"),
    )


def merged_records(winners: DataFrame, fields: list[Field]) -> DataFrame:
    """(grp, one column a field): the surviving values of field_winners(), one merged record a group."""
    return winners.select("grp", *[F.col(f"{f.name}.value").alias(f.name) for f in fields])


def surviving_records(winners: DataFrame, fields: list[Field]) -> DataFrame:
    """(grp, field, record_id): of each group of two or more the record that each field's winner comes from."""
    rows = F.array(*[F.struct(F.lit(f.name).alias("field"), F.col(f"{f.name}.record_id").alias("record_id")) for f in fields])
    return winners.filter("records > 1").select("grp", F.inline(rows)).filter("record_id IS NOT NULL")


def decayed(age: Column, half_life: float) -> Column:
    """What is left of a vote of that age: half after every half_life; nothing of one whose age is unknown."""
    return F.coalesce(F.pow(F.lit(0.5), age.cast("double") / half_life), F.lit(0.0))


def group_of(name: str) -> Column:
    """A group id without outer blanks, in lower case; blank ids are no group."""
    g = F.lower(F.trim(F.col(name), F.lit(" \t\r\n")))
    return F.when(g != "", g)
