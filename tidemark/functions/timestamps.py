"""Timestamps: provider values, calendar days in a named zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidemark.functions.bind import let

_DATE = r"(\d{4})-?(\d{2})-?(\d{2})"
_WEEK = r"(\d{4})-?W(\d{2})(?:-?(\d))?"
_CLOCK = r"(\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d+))?)?)?"
_ZONE = r"(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2}(?:\.\d+)?)?)?)?"
# Separators must be used throughout or not at all within the date and within the clock.
_SHAPE = (
    r"(?s)^(?:\d{4}-\d{2}-\d{2}|\d{8}|\d{4}-W\d{2}(?:-\d)?|\d{4}W\d{2}\d?)"
    r"(?:.(?:\d{2}|\d{2}:\d{2}|\d{2}:\d{2}:\d{2}(?:[.,]\d+)?|\d{4}|\d{6}(?:[.,]\d+)?)"
    r"(?:Z|[+-]\d{2}|[+-]\d{2}:\d{2}|[+-]\d{2}:\d{2}:\d{2}(?:\.\d+)?|[+-]\d{4}|[+-]\d{6}(?:\.\d+)?)?)?$"
)

# The extended form with T or a blank, which a cast reads (naive texts in the session zone, UTC).
_USUAL = (
    r"^(?!0000)\d{4}-\d{2}-\d{2}(?:[T ](?:[01]\d|2[0-3]):\d{2}:\d{2}(?:\.\d{1,6})?(?:Z|[+-](?:0\d|1[0-7]):[0-5]\d)?)?$"
)


def parse_iso(text: Column) -> Column:
    """ISO-8601 date or date-time, else null. A text without an offset is read as UTC."""
    usual = text.rlike(_USUAL)
    return F.when(usual, text.try_cast("timestamp")).when(
        text.rlike(_SHAPE), let(F.when(~usual, text), _parse_shaped)
    )


def _parse_shaped(text: Column) -> Column:
    tail = f"^{_CLOCK}{_ZONE}$"

    def number(column: Column, pattern: str, group: int) -> Column:
        return F.coalesce(F.regexp_extract(column, pattern, group).try_cast("int"), F.lit(0))

    def clock(rest: Column) -> Column:
        return F.struct(
            *[number(rest, tail, i).alias(n) for i, n in ((1, "hh"), (2, "mm"), (3, "ss"))],
            F.rpad(F.substring(F.regexp_extract(rest, tail, 4), 1, 6), 6, "0").cast("int").alias("micros"),
            let(F.regexp_extract(rest, tail, 5), _zone_offset).alias("offset"),
        )

    def assembled(x: Column) -> Column:
        day, c = x["day"], x["clock"]
        seconds = F.unix_date(day).cast("bigint") * 86400 + c["hh"] * 3600 + c["mm"] * 60 + c["ss"] - c["offset"]
        valid = (c["hh"] < 24) & (c["mm"] < 60) & (c["ss"] < 60) & (F.abs(c["offset"]) < 86400)
        return F.when(valid & day.isNotNull(), F.timestamp_micros(seconds * 1_000_000 + c["micros"]))

    date_part = F.regexp_extract(text, f"^(?:{_WEEK}|{_DATE})", 0)
    day = F.when(text.rlike(r"^\d{4}-?W"), _week_day(text)).otherwise(
        F.try_to_date(F.nullif(F.regexp_replace(date_part, f"^{_DATE}$", "$1-$2-$3"), F.lit("0000-00-00")))
    )
    rest = let(F.length(date_part) + 2, lambda start: F.substring(text, start, F.length(text)))
    parts = F.struct(F.when(~text.startswith("0000"), day).alias("day"), let(rest, clock).alias("clock"))
    return let(parts, assembled)


def _week_day(text: Column) -> Column:
    """Date of an ISO week text: year, week, and day of the week (Monday where it is left out)."""
    year = F.substring(text, 1, 4)
    week = F.regexp_extract(text, f"^{_WEEK}", 2).try_cast("int")
    weekday = F.coalesce(F.regexp_extract(text, f"^{_WEEK}", 3).try_cast("int"), F.lit(1))
    monday = F.trunc(F.try_to_date(F.concat(year, F.lit("-01-04"))), "week")
    weeks = F.weekofyear(F.try_to_date(F.concat(year, F.lit("-12-28"))))
    return F.when(week.between(1, weeks) & weekday.between(1, 7), F.date_add(monday, (week - 1) * 7 + weekday - 1))


def _zone_offset(zone: Column) -> Column:
    digits = F.regexp_replace(F.substring(zone, 2, 20), r":|\..*$", "")

    def seconds(d: Column) -> Column:
        def pair(start: int) -> Column:
            return F.coalesce(F.substring(d, start, 2).try_cast("int"), F.lit(0))

        return pair(1) * 3600 + pair(3) * 60 + pair(5)

    return F.when(zone.startswith("-"), -1).otherwise(1) * let(digits, seconds)


def from_epoch(number: Column, unit: str = "auto") -> Column:
    """Epoch number to timestamp. `unit` is s, ms, or auto (above 1e12 means milliseconds)."""
    value = number.cast("double")
    seconds = {
        "s": value,
        "ms": value / 1000.0,
        "auto": F.when(value > 1e12, value / 1000.0).otherwise(value),
    }[unit]
    return let(seconds, _from_seconds)


def _from_seconds(seconds: Column) -> Column:
    in_range = seconds.between(-62135596800.0, 253402300799.0)
    return F.when(in_range, F.timestamp_micros(F.bround(seconds * 1_000_000).cast("bigint")))


def day_start(day: Column, zone: str) -> Column:
    """Instant at which the calendar day begins in `zone` (session zone is UTC)."""
    return F.to_utc_timestamp(day.cast("timestamp"), zone)


def local_day(instant: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(instant, zone))


def within_local_day(instant: Column, day: Column, zone: str) -> Column:
    return (instant >= day_start(day, zone)) & (instant < day_start(F.date_add(day, 1), zone))
