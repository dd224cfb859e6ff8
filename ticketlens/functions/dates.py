"""Date parsing and date parts of tickets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.text import strip_whitespace

# --- Fixed values: accepted layouts, in order of preference -----------------
PRIMARY_FORMAT = "M/d/yyyy H:m"
FALLBACK_FORMATS = ["yyyy-MM-dd HH:mm", "d/MMM/yy h:mm a", "M/d/yyyy"]
#: Parts of a day that may follow any date below, seconds and halves of the day included.
_DAYS = [
    (r"^\d{1,2}/\d{1,2}/\d{4}\b", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{2}\b", "M/d/yy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}\b", "yyyy/M/d"),
    (r"^\d{8}\b", "yyyyMMdd"),
    (r"^\d{1,2}[-/ ][A-Za-z]{3,9}[-/ ]\d{4}\b", "d MMM yyyy"),
    (r"^\d{1,2}[-/ ][A-Za-z]{3,9}[-/ ]\d{2}\b", "d MMM yy"),
    (r"^[A-Za-z]{3,9} \d{1,2} \d{4}\b", "MMM d yyyy"),
]
_HOURS = [
    (r"^\d{1,2}:\d{2}$", "H:m"),
    (r"^\d{1,2}:\d{2}:\d{2}$", "H:m:s"),
    (r"^\d{1,2}:\d{2}:\d{2}\.\d{1,9}$", "H:m:s.[SSSSSSSSS][SSSSSS][SSS]"),
    (r"(?i)^\d{1,2}:\d{2} ?[ap]m$", "h:m a"),
    (r"(?i)^\d{1,2}:\d{2}:\d{2} ?[ap]m$", "h:m:s a"),
]
_DAY_HOUR = (
    r"^(\d{1,4}/\d{1,2}/\d{1,4}|\d{8}|\d{1,2}[-/ ][A-Za-z]+[-/ ]\d{2,4}|[A-Za-z]+ \d{1,2} \d{4})"
    r"(?:[ T,]+(.*))?$"
)
_ZONE = r"(?i) ?(?:Z|UTC|GMT|[+-]\d{2}:?\d{2})$"


def parse_ticket_ts(text: Column) -> Column:
    """Timestamp from `M/d/yyyy H:mm`, else ISO, else the other layouts; null if none fits.

    Days may be written with slashes, without separators, with a year of two digits or with
    the English name of the month; hours with seconds, in halves of the day, or not at all. A zone
    offset shifts the time to the session's zone; names of week days are skipped.
    """
    value = strip_whitespace(text)
    iso = F.when(value.rlike(r"^\d{4}-\d"), F.try_to_timestamp(value))
    return F.coalesce(
        F.try_to_timestamp(value, F.lit(PRIMARY_FORMAT)),
        iso,
        *[F.try_to_timestamp(value, F.lit(fmt)) for fmt in FALLBACK_FORMATS],
        _by_parts(value),
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _by_parts(value: Column) -> Column:
    """A day in one of the known layouts, then an hour in one of theirs, then a zone."""
    plain = F.regexp_replace(value, r"(?i)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? +", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"^([A-Za-z]+)\.? (\d{1,2}),", "$1 $2"), " +", " ")

    def split(text: Column) -> Column:
        day, hour = (F.regexp_extract(text, _DAY_HOUR, i) for i in (1, 2))
        return F.struct(day.alias("day"), hour.alias("hour"))

    return _let(plain, lambda text: _let(split(text), lambda x: _shifted(x["day"], x["hour"])))


def _shifted(day: Column, hour: Column) -> Column:
    offset = F.regexp_extract(hour, r"([+-]\d{2}):?\d{2}$", 1)
    minutes = F.regexp_extract(hour, r"[+-]\d{2}:?(\d{2})$", 1)
    size = F.abs(offset.try_cast("long")) * 60 + minutes.try_cast("long")
    shift = F.when(offset == "", F.lit(0).cast("long")).when(offset.startswith("-"), -size).otherwise(size)
    clock = F.upper(F.regexp_replace(F.regexp_replace(hour, _ZONE, ""), r"(?i)(\d)([ap]m)$", "$1 $2"))
    since = _let(clock, _microseconds)
    return F.timestamp_add("MICROSECOND", since - shift * 60_000_000, _let(_named_month(day), _day))


def _named_month(day: Column) -> Column:
    """Month names by their first three letters, in the case that the layouts want."""
    name = F.initcap(F.substring(F.regexp_extract(day, r"([A-Za-z]+)", 1), 1, 3))
    before, after = (F.regexp_extract(day, p, 1) for p in (r"^([^A-Za-z]*)", r"([^A-Za-z]*)$"))
    named = F.regexp_replace(F.concat(before, name, after), "[-/]", " ")
    return F.when(day.rlike("[A-Za-z]"), named).otherwise(day)


def _day(day: Column) -> Column:
    return F.coalesce(*[F.when(day.rlike(p), F.try_to_timestamp(day, F.lit(f))) for p, f in _DAYS])


def _microseconds(clock: Column) -> Column:
    """Since midnight; null when the text is not an hour."""
    midnight = F.lit("1970-01-01 00:00:00").cast("timestamp")
    found = [F.when(clock == "", midnight)]
    for pattern, layout in _HOURS:
        stamp = F.try_to_timestamp(
            F.concat(F.lit("1970-01-01 "), clock), F.lit("yyyy-MM-dd " + layout)
        )
        found.append(F.when(clock.rlike(pattern), stamp))
    return F.timestamp_diff("MICROSECOND", midnight, F.coalesce(*found))


def day_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def with_date_parts(df: DataFrame) -> DataFrame:
    """Adds `Date`, `ResolvedDate` (both yyyy-MM-dd) and `DayOfWeek` (`Mon`...)."""
    return df.withColumns(
        {
            "Date": day_text(F.col("Created_dt")),
            "ResolvedDate": day_text(F.col("Resolution_dt")),
            "DayOfWeek": F.date_format("Created_dt", "E"),
        }
    )


def hours_between(start: Column, end: Column) -> Column:
    """Hours from `start` to `end`; null when either is missing or the span is negative."""
    hours = F.timestamp_diff("MICROSECOND", start, end) / F.lit(3.6e9)
    return F.when(hours >= 0, hours)
