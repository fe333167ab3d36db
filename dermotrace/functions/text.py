"""Labels, names, clock times, durations and distances as text: Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a recording start before the second day of the epoch is no clock time.
CLOCK_SET_S = 86_400
#: Fixed value: the first year that a set clock can show.
FIRST_YEAR = 2020
TICKS_PER_SECOND = 10.0


def _two(n: Column) -> Column:
    return F.lpad(n.cast("string"), 2, "0")


def _part(n: Column, unit: int, of: int | None = None) -> Column:
    """Whole units in n seconds, within the next larger unit."""
    return F.floor((n % of if of else n) / unit).cast("long")


def clean_label(label: Column) -> Column:
    """Without line breaks, trimmed; a null is empty."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s*[\r\n]+\s*", " "), r"^\s+|\s+$", "")


def safe_name(name: Column) -> Column:
    """A file name without its extension and with unsafe characters replaced."""
    given = F.when(F.coalesce(name, F.lit("")) == "", "track").otherwise(name)
    return F.regexp_replace(F.regexp_replace(given, r"\.[^/.]+$", ""), "[^a-zA-Z0-9._-]", "_")


def csv_cell(value: Column) -> Column:
    """A quoted cell; a null is nothing."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def is_relative(start: Column) -> Column:
    return F.coalesce(start, F.lit(0)) < CLOCK_SET_S


def ordinal_suffix(day: Column) -> Column:
    ten = F.pmod(day, F.lit(10))
    teens = F.pmod(day, F.lit(100)).between(11, 13)
    return F.when(teens, "th").when(ten == 1, "st").when(ten == 2, "nd").when(ten == 3, "rd").otherwise("th")


def _at(start: Column, seconds: Column) -> Column:
    return F.timestamp_seconds(F.floor(start + seconds))


def clock_time(start: Column, seconds: Column) -> Column:
    """HH:MM:SS of the day, or H:MM:SS or M:SS since a start that isn't known. The session's time zone is UTC."""
    n = F.floor(seconds + 0.5).cast("long")
    h, m, s = _part(n, 3600), _part(n, 60, 3600), n % 60
    since = F.when(h > 0, F.concat(h.cast("string"), F.lit(":"), _two(m), F.lit(":"), _two(s))).otherwise(F.concat(m.cast("string"), F.lit(":"), _two(s)))
    return F.when(is_relative(start), since).otherwise(F.date_format(_at(start, seconds), "HH:mm:ss"))


def date_long(start: Column, seconds: Column) -> Column:
    """As in 30th Dec 2026."""
    at = _at(start, seconds)
    day = F.dayofmonth(at)
    return F.when(is_relative(start), clock_time(start, seconds)).otherwise(F.concat(day.cast("string"), ordinal_suffix(day), F.date_format(at, " MMM yyyy")))


def date_short(start: Column, seconds: Column) -> Column:
    return F.when(is_relative(start), clock_time(start, seconds)).otherwise(F.date_format(_at(start, seconds), "dd.MM.yyyy"))


def duration_compact(seconds: Column) -> Column:
    """As in 49s, 18m 49s, 6h 05m."""
    n = F.greatest(F.lit(0), F.floor(seconds)).cast("long")
    h, m, s = _part(n, 3600), _part(n, 60, 3600), n % 60
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), _two(m), F.lit("m"))).when(m > 0, F.concat(m.cast("string"), F.lit("m "), _two(s), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def duration(seconds: Column) -> Column:
    """As in 38m 12s or 1h 14m, rounded; nothing under zero."""
    n = F.when(seconds >= 0, F.floor(seconds + 0.5)).otherwise(0).cast("long")
    n = F.coalesce(n, F.lit(0).cast("long"))
    h, m, s = _part(n, 3600), _part(n, 60, 3600), n % 60
    text = lambda a, x, b, y: F.concat(a.cast("string"), F.lit(x), b.cast("string"), F.lit(y))
    return F.when(h > 0, text(h, "h ", m, "m")).when(m > 0, text(m, "m ", s, "s")).otherwise(F.concat(s.cast("string"), F.lit("s")))


def distance(metres: Column) -> Column:
    """Whole metres, or kilometres with one decimal, that of the number as it is stored: 10.85 lies under its half."""
    far = F.concat(F.call_function("format_number", metres / 1000, F.lit("0.0")), F.lit(" km"))
    near = F.concat(F.floor(metres + 0.5).cast("string"), F.lit(" m"))
    return F.when(metres.isNull() | F.isnan(metres) | (metres <= 0), "0 m").when(metres >= 1000, far).otherwise(near)


def unix_epoch(year: Column, month: Column, day: Column, hour: Column, minute: Column, second: Column) -> Column:
    """Seconds since the epoch; 0 if the clock isn't set. A day past its month's end runs on into the next month."""
    first = F.unix_seconds(F.make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)))
    known = (year >= FIRST_YEAR) & month.between(1, 12) & day.between(1, 31)
    return F.when(known, first + (day - 1) * 86_400 + hour * 3600 + minute * 60 + second).otherwise(F.lit(0)).cast("long")


def file_stamp(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd_HH-mm-ss")


def tick_seconds(ticks: Column) -> Column:
    return ticks / TICKS_PER_SECOND
