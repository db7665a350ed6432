"""Capture timestamps: strings of 4 to 14 digits, compared as strings and measured as seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400


def is_usable(ts: Column) -> Column:
    return F.coalesce(ts.rlike(r"\A\d{4,14}\z"), F.lit(False))


def last_day(year: Column, month: Column) -> Column:
    """Days of a month; months beyond 12 roll into later years, and years below 100 count from 1900."""
    full = F.when(year < 100, year + 1900).otherwise(year) + F.floor((month - 1) / 12)
    of_year = F.pmod(month - 1, F.lit(12)) + 1
    leap = ((full % 4 == 0) & (full % 100 != 0)) | (full % 400 == 0)
    return F.when(of_year == 2, F.when(leap, 29).otherwise(28)).when(of_year.isin(4, 6, 9, 11), 30).otherwise(31)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def expand_timestamp(ts: Column, edge: str) -> Column:
    """Fill a prefix up to 14 digits with the first or last instant that it covers; anything else stays as it is. Of an odd
    number of digits the last one falls away."""
    whole = (F.length(ts) - F.length(ts) % 2).cast("int")
    kept = F.substring(ts, F.lit(1), whole)
    if edge == "start":
        filled = F.concat(kept, F.substring(F.lit("00000101000000"), whole + 1, F.lit(14)))
    else:
        month = F.when(whole >= 6, F.substring(ts, 5, 2)).otherwise("12")
        day = F.when(whole >= 8, F.substring(ts, 7, 2)).otherwise(last_day(F.substring(ts, 1, 4).try_cast("int"), month.try_cast("int")).cast("string"))
        filled = F.concat(F.substring(ts, 1, 4), month, day, F.substring(kept, 9, 4), F.substring(F.lit("00000000235959"), F.greatest(whole, F.lit(8)) + 1, F.lit(14)))
        filled = F.when(whole < 12, filled).otherwise(F.concat(kept, F.lit("59")))
    return F.when(is_usable(ts) & (F.length(ts) < 14), filled).otherwise(ts)


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 of a 14-digit timestamp; null if it is none or names no instant. No time zone enters."""

    def seconds(v: Column) -> Column:
        part = lambda low, size: ((v % (low * size) - v % low) / low).cast("int")
        made = F.try_make_timestamp_ntz(part(10**10, 10**4), part(10**8, 100), part(10**6, 100), part(10**4, 100), part(100, 100), (v % 100).cast("decimal(16,6)"))
        return F.when(v % 100 < 60, seconds_of(made))

    return let(F.when(ts.rlike(r"\A\d{14}\z"), ts.try_cast("long")), seconds)


def seconds_of(moment: Column) -> Column:
    """Seconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), moment)


def start_epoch(ts: Column) -> Column:
    return epoch_seconds(expand_timestamp(ts, "start"))


def distance_seconds(a: Column, b: Column) -> Column:
    return F.abs(epoch_seconds(a) - epoch_seconds(b))


def iso_timestamp(ts: Column) -> Column:
    filled = F.concat(F.substring(ts, 1, 4), F.lit("-"), F.substring(ts, 5, 2), F.lit("-"), F.substring(ts, 7, 2), F.lit("T"), F.substring(ts, 9, 2), F.lit(":"), F.substring(ts, 11, 2), F.lit(":"), F.substring(ts, 13, 2), F.lit(".000Z"))
    return F.when(epoch_seconds(ts).isNotNull(), filled)


def selection_target(start: str | None, end: str | None) -> Column:
    """The instant that a declared period aims at: its end, else its beginning, else none."""
    if end:
        return expand_timestamp(F.lit(end), "end")
    return expand_timestamp(F.lit(start), "start") if start else F.lit(None).cast("string")


MONTHS = ("Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec")


def http_date(value: Column) -> Column:
    """An HTTP date as 14 digits."""
    pattern = r"^\s*\w{3}, (\d{2}) (\w{3}) (\d{4}) (\d{2}):(\d{2}):(\d{2}) GMT\s*$"
    part = lambda i: F.regexp_extract(value, pattern, i)
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), part(2))
    return F.when(value.rlike(pattern) & (month > 0), F.concat(part(3), F.lpad(month.cast("string"), 2, "0"), part(1), part(4), part(5), part(6)))


def served_timestamp(memento: Column, final_url: Column) -> Column:
    from relictum.functions.url import replay_timestamp

    return F.coalesce(http_date(memento), replay_timestamp(final_url))


def retry_after_seconds(value: Column, now: Column) -> Column:
    """A Retry-After header, seconds or an HTTP date, as seconds from `now` (seconds since 1970), never negative."""
    plain = F.when(F.trim(value).rlike(r"^\d+$"), F.trim(value).try_cast("long"))
    dated = epoch_seconds(http_date(value))
    return F.coalesce(plain, F.when(dated.isNotNull(), F.greatest(F.lit(0).cast("long"), dated - now)))


def format_days(seconds: Column, *, quarter: str = "3") -> Column:
    """Seconds below a day, else days with one digit, rounded from the exact value of the double. `quarter` is the digit of a quarter
    day, the one tie that rules differ on: up, or "2" for C's printf."""
    days = F.call_function("format_number", seconds / float(DAY), F.lit("0.0"))  # ties to even
    if quarter != "2":
        days = F.when(seconds % DAY == DAY // 4, F.concat(F.floor(seconds / DAY).cast("string"), F.lit("." + quarter))).otherwise(days)
    return F.when(seconds < DAY, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(days, F.lit("d")))
