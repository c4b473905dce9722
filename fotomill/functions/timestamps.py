"""Written times of many forms as one UTC instant.

An ordered cascade of anchored patterns names the form of a value; its parts are then read strictly
(an impossible day, hour or offset gives no value) and the local time is moved to UTC by the offset
or zone written in the value, else by the zone given beside it.

All of it is built-in column arithmetic: nothing depends on the session's time zone, and no value raises
an error in ANSI mode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
_ZONE = r"[zZ]|UTC|GMT|utc|gmt|[+-]\d{2}:?\d{2}|[A-Za-z]+(?:/[A-Za-z0-9_+-]+)+"
_CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"

#: The cascade, most common form first: a pattern that covers the whole trimmed value, and the order of its parts
#: as year|month|day|clock|half of day|zone. Slash dates are rearranged by the date order afterwards.
PATTERNS: dict[str, tuple[str, str]] = {
    "iso": (
        rf"^(\d{{4}})([:-])(\d{{2}})\2(\d{{2}})(?:[ T](\d{{2}}:\d{{2}}(?::\d{{2}}(?:[.,]\d+)?)?) ?({_ZONE})?)?$",
        "$1|$3|$4|$5||$6",
    ),
    "compact": (
        rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[_T ]?(\d{{2}})(\d{{2}})(\d{{2}}) ?({_ZONE})?)?$",
        "$1|$2|$3|$4:$5:$6||$7",
    ),
    "seconds": (r"^\d{10}$", "$0"),
    "millis": (r"^\d{13}$", "$0"),
    "slash": (
        rf"^(\d{{1,2}})/(\d{{1,2}})/(\d{{4}})(?:,? ({_CLOCK})(?: ?([AaPp][Mm]))? ?({_ZONE})?)?$",
        "$3|$1|$2|$4|$5|$6",
    ),
    "words": (
        r"^(?:[A-Za-z]{3}, )?(\d{1,2}) (?i:(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec))[a-z]* (\d{4})"
        rf"(?:,? ({_CLOCK})(?: ?([AaPp][Mm]))? ?({_ZONE})?)?$",
        "$3|$2|$1|$4|$5|$6",
    ),
}

_BLANK = " \t\r\n\f\v"
_MICRO = 1_000_000


def known_zones(spark: SparkSession) -> list[str]:
    """The zone names this JVM knows (about 600); a written zone outside them makes a value unreadable."""
    said = spark.sql("SELECT reflect('java.time.ZoneId', 'getAvailableZoneIds') z").first()[0]
    return sorted(z.strip() for z in said.strip("[]").split(",") if "/" in z)


def _int(c: Column) -> Column:
    return c.try_cast("int")


def with_instant(df: DataFrame, value: str, zone: Column, date_order: Column) -> DataFrame:
    """The rows of df whose written time `value` names a full, existing day, with utc_micros BIGINT and has_time BOOLEAN.

    value: the text; outer blanks do not count. zone: IANA name for values without a zone of their own (null or
    unknown: UTC). date_order: 'MDY' or else day first, for dates with slashes.
    Digits after the microsecond are cut off, missing seconds are 0, a day without a time means 12:00.
    Ten digits are seconds, thirteen are milliseconds since 1970 in UTC.
    A local time that occurs twice means the first; one that was skipped counts with the offset before the change.

    Each step is a projection of its own, so that no pattern is evaluated twice for a row.
    """
    zones = known_zones(df.sparkSession)
    kind = parts = F.lit(None).cast("string")
    for name, (pattern, order) in reversed(PATTERNS.items()):
        kind = F.when(F.col("__t").rlike(pattern), F.lit(name)).otherwise(kind)
        parts = F.when(F.col("__k") == name, F.regexp_replace("__t", pattern, order)).otherwise(parts)
    p = lambda i: F.get("__p", F.lit(i))
    c = lambda i: F.get("__c", F.lit(i))
    swap = (F.col("__k") == "slash") & ~F.col("__mdy")
    month = F.when(F.col("__k") == "words", (F.instr(F.lit(_MONTHS), F.lower(p(1))) + 2) / 3).otherwise(_int(p(1)))
    first, second = month.cast("int"), _int(p(2))
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    day = F.concat_ws("-", p(0), pad(F.when(swap, second).otherwise(first)), pad(F.when(swap, first).otherwise(second)))
    hour = F.when(p(4) == "", _int(c(0))).when(
        _int(c(0)).between(1, 12), _int(c(0)) % 12 + F.when(F.lower(p(4)) == "pm", 12).otherwise(0)
    )
    own, mine = F.col("__own"), F.col("__z")
    h, m = _int(F.substring(own, 2, 2)), _int(F.substring(own, -2, 2))
    sign = F.when(own.startswith("-"), -_MICRO).otherwise(_MICRO)
    shift = F.when((h <= 18) & (m < 60), (h * 3600 + m * 60).cast("bigint") * sign)
    at_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros("__local"), F.col("__by")))
    utc = (
        F.when(F.col("__k") == "seconds", F.col("__t").try_cast("bigint") * _MICRO)
        .when(F.col("__k") == "millis", F.col("__t").try_cast("bigint") * 1000)
        .when(F.col("__by") == "UTC", F.col("__local"))
        .when(F.col("__by").isNotNull(), at_zone)
        .otherwise(F.col("__local") - shift)
    )
    steps = [
        {"__t": F.trim(value, F.lit(_BLANK)), "__z": zone, "__mdy": F.coalesce(F.upper(date_order) == "MDY", F.lit(False))},
        {"__k": kind},
        {"__p": F.split(parts, r"\|")},
        {"__c": F.split(p(3), "[:.,]"), "__timed": ~F.coalesce(p(3), F.lit("")).isin("", "::"), "__own": F.coalesce(p(5), F.lit(""))},
        {
            "__days": F.unix_date(day.try_cast("date")),
            "__h": hour,
            "__m": _int(c(1)),
            "__s": F.coalesce(_int(c(2)), F.lit(0)),
            "__f": F.coalesce(_int(F.rpad(F.substring(c(3), 1, 6), 6, "0")), F.lit(0)),
            # The zone that decides; null where a written offset does, or a name that no zone has.
            "__by": F.when(own == "", F.when(mine.isin(zones), mine).otherwise("UTC"))
            .when(F.lower(own).isin("z", "utc", "gmt"), "UTC")
            .when(own.isin(zones), own),
        },
        {
            "__local": F.col("__days").cast("bigint") * (86400 * _MICRO)
            + F.when(~F.col("__timed"), F.lit(12 * 3600 * _MICRO).cast("bigint")).when(
                F.col("__h").between(0, 23) & F.col("__m").between(0, 59) & F.col("__s").between(0, 59),
                (F.col("__h") * 3600 + F.col("__m") * 60 + F.col("__s")).cast("bigint") * _MICRO + F.col("__f"),
            )
        },
        {"utc_micros": utc, "has_time": F.col("__timed") | F.col("__k").isin("seconds", "millis")},
    ]
    kept = df.columns
    for step in steps:
        df = df.withColumns(step)
    # explode() also keeps the optimiser from moving this test below the steps, which would write each of them out anew.
    known = F.when(F.col("utc_micros").isNotNull(), F.array(F.struct("utc_micros", "has_time")))
    kept = [c for c in kept if c not in ("utc_micros", "has_time")]
    return df.select(*kept, F.explode(known).alias("__at")).select(*kept, "__at.utc_micros", "__at.has_time")


def utc_text(micros: Column) -> Column:
    """Microseconds since 1970 as YYYY-MM-DDTHH:MM:SS.ffffffZ, whatever the session's zone."""
    rest = F.pmod(micros, F.lit(86400 * _MICRO))
    day = F.round((micros - rest) / (86400 * _MICRO))
    two = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat(
        F.date_from_unix_date(day.cast("int")).cast("string"), F.lit("T"),
        two(rest / (3600 * _MICRO)), F.lit(":"),
        two(F.pmod(rest, F.lit(3600 * _MICRO)) / (60 * _MICRO)), F.lit(":"),
        two(F.pmod(rest, F.lit(60 * _MICRO)) / _MICRO), F.lit("."),
        F.lpad(F.pmod(rest, F.lit(_MICRO)).cast("string"), 6, "0"), F.lit("Z"),
    )
