"""Dates, times and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: 100 ns ticks from 1601 to 1970, in microseconds (fixed value).
FILETIME_EPOCH = 11644473600000000


def micros(t: Column) -> Column:
    """Microseconds since 1970 of a timestamp with or without a zone, the latter read in the session's zone."""
    return F.unix_micros(t.cast("timestamp"))


def from_ymd(y: Column, m: Column, d: Column) -> Column:
    return F.make_date(y, m, d)


def from_year_day(y: Column, day: Column) -> Column:
    """Day 0 is the first of January."""
    return F.date_add(F.make_date(y, F.lit(1), F.lit(1)), day)


def day_number(d: Column) -> Column:
    """Days since the start of 1970."""
    return F.unix_date(d)


def add_micros(t: Column, span: Column) -> Column:
    return F.timestamp_micros(micros(t) + span)


def difference_micros(a: Column, b: Column) -> Column:
    return micros(a) - micros(b)


def whole_seconds(span: Column) -> Column:
    return _div(span, 1_000_000)


def whole_minutes(span: Column) -> Column:
    return _div(span, 60_000_000)


def whole_hours(span: Column) -> Column:
    return _div(span, 3_600_000_000)


def whole_days(span: Column) -> Column:
    return _div(span, 86_400_000_000)


def _div(c: Column, by: int) -> Column:
    """Integer division towards zero."""
    return (F.sign(c).cast("long") * ((F.abs(c) - F.pmod(F.abs(c), F.lit(by))) / F.lit(by)).cast("long")).cast("long")


def duration(days: int = 0, hours: int = 0, minutes: int = 0, seconds: float = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(seconds))


def day_of_week(d: Column) -> Column:
    """0 is Sunday."""
    return F.dayofweek(d) - 1


def is_leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def days_in_month(y: Column, m: Column) -> Column:
    return F.dayofmonth(F.last_day(F.make_date(y, m, F.lit(1))))


def to_unix(t: Column) -> Column:
    return micros(t)


def from_unix(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def from_filetime(ticks: Column) -> Column:
    return F.timestamp_micros(F.floor(ticks / F.lit(10)).cast("long") - F.lit(FILETIME_EPOCH))


def to_filetime(t: Column) -> Column:
    return (micros(t) + F.lit(FILETIME_EPOCH)) * F.lit(10)


#: Forms of a date, that is of what stands before a T; those of less than a day have no time.
_DATE = {
    "day": r"^\d{4}-?\d{2}-?\d{2}\z",
    "ordinal": r"^\d{4}-?\d{3}\z",
    "week": r"^\d{4}-?W\d{2}-?\d\z",
    "week_only": r"^\d{4}-?W\d{2}\z",
    "month": r"^\d{4}-\d{2}\z",
    "year": r"^\d{4}\z",
    "century": r"^\d{2}\z",
}
_TIME = r"^\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?\z"


def parse_iso(c: Column) -> tuple[Column, Column]:
    """(timestamp, precision) of an ISO-8601 text: century, year, month, week, day, hour, minute, second or fraction; nulls if it is none.

    Calendar, ordinal (YYYY-DDD) and week (YYYY-Www-D) dates are read, with a
    time, a fraction and an offset if there are any; without an offset it is UTC.
    One regular expression decides on a form, and its numbers are cut out by place.
    """
    date = F.substring_index(c, "T", 1)
    is_ = {k: date.rlike(p) for k, p in _DATE.items()}
    digits = F.translate(date, "-W", "")
    num = lambda text, at, n: F.substring(text, at, n).try_cast("int")
    year = num(digits, 1, 4)
    new_year = F.make_date(year, F.lit(1), F.lit(1))
    two = num(digits, 5, 2)
    week = lambda day: F.date_add(F.trunc(F.make_date(year, F.lit(1), F.lit(4)), "week"), (two - 1) * 7 + day - 1)
    timed = F.instr(c, "T") > 0
    day = F.when(is_["day"], F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)).try_cast("date"))
    day = day.when(is_["ordinal"] & num(digits, 5, 3).between(1, 366), F.date_add(new_year, num(digits, 5, 3) - 1))
    day = day.when(is_["week"] & two.between(1, 53) & num(digits, 7, 1).between(1, 7), week(num(digits, 7, 1)))
    short = F.when(is_["year"], new_year)
    short = short.when(is_["month"] & two.between(1, 12), F.make_date(year, two, F.lit(1)))
    short = short.when(is_["week_only"] & two.between(1, 53), week(F.lit(1)))
    short = short.when(is_["century"] & (year > 0), F.make_date(year * 100, F.lit(1), F.lit(1)))
    day = day.when(~timed, short)

    time = F.substr(c, F.instr(c, "T") + 1)
    clock = F.substring_index(F.substring_index(F.substring_index(time, "Z", 1), "+", 1), "-", 1)
    zone = F.substr(time, F.length(clock) + 1)
    plain = F.translate(clock, ",:", ".")
    whole = F.substring_index(plain, ".", 1)
    after = F.substr(plain, F.length(whole) + 2)
    # what is left out becomes zeros before the cast: a cast that fails costs more than all else here
    h, m, s = (num(F.rpad(whole, 6, "0"), at, 2) for at in (1, 3, 5))
    frac = F.rpad(after, 6, "0").try_cast("long")
    offset = F.rpad(F.translate(zone, "+-:Z", ""), 4, "0")
    shift = num(offset, 1, 2) * 60 + num(offset, 3, 2)
    shift = F.when(F.startswith(zone, F.lit("-")), -shift).otherwise(shift)
    of_day = ((h * 3600 + m * 60 + s).cast("long") - shift * 60) * F.lit(1_000_000) + frac
    good = ~timed | (time.rlike(_TIME) & (h <= 24) & (m <= 59) & (s <= 60))
    ts = F.when(good, F.timestamp_micros(F.unix_date(day).cast("long") * F.lit(86_400_000_000) + F.when(timed, of_day).otherwise(F.lit(0))))
    precision = F.when(timed & (after != ""), "fraction").when(timed & (F.length(whole) > 4), "second").when(timed & (F.length(whole) > 2), "minute").when(timed, "hour")
    for k in ("century", "year", "month"):
        precision = precision.when(is_[k], k)
    precision = precision.when(is_["week_only"], "week").otherwise("day")
    return ts, F.when(ts.isNotNull(), precision)


def format_iso(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def format_short(t: Column) -> Column:
    return F.date_format(t, "d/M/yyyy HH:mm")


def format_long(t: Column) -> Column:
    return F.date_format(t, "EEEE d MMMM yyyy HH:mm:ss")


def format_12h(t: Column) -> Column:
    return F.date_format(t, "h:mm:ss a")


def is_rfc3339_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}\z") & F.try_to_date(c, "yyyy-MM-dd").isNotNull()


def is_rfc3339_time(c: Column) -> Column:
    return c.rlike(r"^([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(?:[zZ]|[+-]([01]\d|2[0-3]):[0-5]\d)\z")


def is_rfc3339(c: Column) -> Column:
    return is_rfc3339_date(F.substring(c, 1, 10)) & F.substring(c, 11, 1).isin("T", "t", " ") & is_rfc3339_time(F.substring(c, 12, 100))


def julian_day(t: Column) -> Column:
    """Days and fraction since noon of the first day of 4713 BC."""
    return micros(t) / F.lit(86_400_000_000.0) + F.lit(2440587.5)


def time_of_day(t: Column) -> Column:
    """Seconds since midnight."""
    return F.pmod(micros(t), F.lit(86_400_000_000)) / F.lit(1e6)
