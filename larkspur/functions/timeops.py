"""Calendar functions: floors, steps, weeks from Sunday, formats and day parts."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "month", "year")


def floor(ts: Column, unit: str) -> Column:
    return F.date_trunc(unit, ts)


def week(ts: Column, first: int = 0) -> Column:
    """Start of the week that begins on weekday `first` (0: Sunday)."""
    day = F.to_date(ts)
    return F.date_sub(day, F.pmod(F.dayofweek(day) - 1 - first, F.lit(7)))


def every(day: Column, step: int) -> Column:
    """Whether a day is one of each `step`, counted anew from the first of every month."""
    return (F.dayofmonth(day) - 1) % step == 0


def ceiling(ts: Column, unit: str) -> Column:
    """The next border of the unit, or the time itself on one."""
    low = floor(ts, unit)
    return F.when(low == ts, low).otherwise(F.date_trunc(unit, F.timestamp_add(unit.upper(), F.lit(1), low)))


def nearest(ts: Column, unit: str) -> Column:
    """The nearer border of the unit, the later one from the middle on."""
    low, high = floor(ts, unit), ceiling(ts, unit)
    gap = lambda a, b: F.timestamp_diff("MICROSECOND", a, b)
    return F.when(gap(low, ts) < gap(ts, high), low).otherwise(high)


def offset(ts: Column, unit: str, n: int) -> Column:
    """The time `n` units later; a day that a month lacks becomes its last one."""
    return F.timestamp_add(unit.upper(), F.lit(n), ts)


def borders(start: Column, end: Column, unit: str) -> Column:
    """Number of borders of the unit after `start` up to `end`."""
    return F.timestamp_diff(unit.upper(), floor(start, unit), floor(end, unit))


def iso_format(ts: Column) -> Column:
    """Text of a time in UTC, to thousandths, whatever the session's zone; a time without zone is one of that zone."""
    return F.date_format(in_utc(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def in_utc(ts: Column) -> Column:
    """The calendar time in UTC, without zone: counted from the epoch, so the hour that a zone has twice is told apart."""
    seconds = F.unix_micros(ts.cast("timestamp")).cast("decimal(18,0)") / F.lit(1_000_000)
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))


def iso_parse(text: Column) -> Column:
    """Time of a text such as iso_format gives, or with another zone; null for others."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX"))


# Steps of time axes as (unit, multiple, seconds).
TICK_STEPS = (
    ("SECOND", 1, 1), ("SECOND", 5, 5), ("SECOND", 15, 15), ("SECOND", 30, 30), ("MINUTE", 1, 60), ("MINUTE", 5, 300), ("MINUTE", 15, 900), ("MINUTE", 30, 1800),
    ("HOUR", 1, 3600), ("HOUR", 3, 10800), ("HOUR", 6, 21600), ("HOUR", 12, 43200), ("DAY", 1, 86400), ("DAY", 2, 172800), ("WEEK", 1, 604800),
    ("MONTH", 1, 2592000), ("MONTH", 3, 7776000), ("YEAR", 1, 31536000),
)


def tick_unit(seconds: float, count: int) -> tuple[str, int]:
    """Unit and multiple of the step nearest in ratio to a span over `count`."""
    target = seconds / count
    return min(TICK_STEPS, key=lambda s: max(s[2] / target, target / s[2]))[:2]


def time_ticks(rows: DataFrame, ts: str, count: int = 10) -> DataFrame:
    """tick: about `count` round times within the extent of a column, days counted anew every month, weeks from Sunday. One row of aggregates sets the step."""
    ends = rows.agg(F.min(ts).cast("timestamp").alias("a"), F.max(ts).cast("timestamp").alias("b")).where("a is not null")
    first = ends.select("a", "b", F.timestamp_diff("SECOND", "a", "b").alias("s")).first()
    unit, k = tick_unit(first.s, count) if first and first.s else ("SECOND", 1)
    # Days and longer steps don't fit a fixed distance, so single units are made and every k-th is kept.
    single = ends.select(F.explode(F.sequence(F.date_trunc(unit, "a"), F.col("b"), F.expr(f"INTERVAL 1 {'DAY' if unit == 'WEEK' else unit}"))).alias("tick"), "a")
    keep = {"SECOND": F.second("tick") % k == 0, "MINUTE": F.minute("tick") % k == 0, "HOUR": F.hour("tick") % k == 0, "DAY": (F.dayofmonth("tick") - 1) % k == 0, "WEEK": F.dayofweek("tick") == 1, "MONTH": (F.month("tick") - 1) % k == 0, "YEAR": F.year("tick") % k == 0}[unit]
    return single.where(keep & (F.col("tick") >= F.col("a"))).select("tick")


_PARSED = {"Y": "yyyy", "m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss", "L": "SSS", "f": "SSSSSS", "j": "DDD", "b": "MMM", "B": "MMMM", "y": "yy", "I": "hh", "p": "a", "a": "EEE", "A": "EEEE", "e": "d", "Z": "[XXX][XX][X]"}


def strptime(text: Column, pattern: str) -> Column:
    """Time of a text after a % pattern of digits, names of months and days, half days and zones; null where it doesn't fit."""
    # Odd parts are the letters after a percent sign.
    parts = re.split("%(.)", pattern)
    if unknown := [p for p in parts[1::2] if p not in _PARSED]:
        raise ValueError(f"unknown directive %{unknown[0]}")
    quoted = lambda t: "'" + t.replace("'", "''") + "'" if t else ""
    return F.try_to_timestamp(text, F.lit("".join(_PARSED[p] if i % 2 else quoted(p) for i, p in enumerate(parts))))


def week_of_year(ts: Column, first: int) -> Column:
    """Week of the year by weeks that begin on weekday `first` (0 Sunday: %U, 1 Monday: %W); days before the first such day are in week 0."""
    weekday = F.pmod(F.dayofweek(ts) - 1 - first, F.lit(7))
    return F.floor((F.dayofyear(ts) + 6 - weekday) / 7).cast("int")


_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "L": "SSS", "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD",
}


#: What %c, %x and %X stand for.
_WHOLE = {"c": "%x, %X", "x": "%-m/%-d/%Y", "X": "%-I:%M:%S %p"}
#: Digits and value of the directives that a fill may be named for.
_NUMBERS: dict[str, tuple[int, Callable[[Column], Column]]] = {
    "m": (2, F.month), "d": (2, F.dayofmonth), "e": (2, F.dayofmonth), "H": (2, F.hour), "I": (2, lambda t: F.pmod(F.hour(t) + 11, F.lit(12)) + 1), "M": (2, F.minute), "S": (2, F.second), "j": (3, F.dayofyear),
    "U": (2, lambda t: week_of_year(t, 0)), "W": (2, lambda t: week_of_year(t, 1)), "V": (2, F.weekofyear), "Y": (4, F.year), "y": (2, lambda t: F.year(t) % 100),
}
#: Years by weeks, and counts from the epoch.
_COUNTED: dict[str, Callable[[Column], Column]] = {
    "G": lambda t: F.lpad(F.extract(F.lit("YEAROFWEEK"), t).cast("string"), 4, "0"), "g": lambda t: F.lpad((F.extract(F.lit("YEAROFWEEK"), t) % 100).cast("string"), 2, "0"),
    "Q": lambda t: F.unix_millis(t.cast("timestamp")).cast("string"), "s": lambda t: F.unix_seconds(t.cast("timestamp")).cast("string"), "Z": lambda t: F.date_format(t.cast("timestamp"), "xx"),
}


def strftime(ts: Column, pattern: str) -> Column:
    """Text of a time after a % pattern."""
    parts: list[Column] = []
    k = 0
    while k < len(pattern):
        if pattern[k] == "%" and k + 1 < len(pattern):
            d, k = pattern[k + 1], k + 2
            # A sign before the letter says what fills a number: nothing, spaces or zeros.
            fill = None
            if d in "-_0" and k < len(pattern):
                fill, d, k = {"-": "", "_": " ", "0": "0"}[d], pattern[k], k + 1
            if fill is not None and d in _NUMBERS:
                width, value = _NUMBERS[d]
                text = value(ts).cast("string")
                parts.append(F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit(fill)) if fill else text)
            elif d in _WHOLE:
                parts.append(strftime(ts, _WHOLE[d]))
            elif d in _COUNTED:
                parts.append(_COUNTED[d](ts))
            elif d in _DIRECTIVES:
                parts.append(F.date_format(ts, _DIRECTIVES[d]))
            elif d == "e":
                parts.append(F.lpad(F.dayofmonth(ts).cast("string"), 2, " "))
            elif d in "UW":
                parts.append(F.lpad(week_of_year(ts, "UW".index(d)).cast("string"), 2, "0"))
            elif d == "V":
                parts.append(F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))
            elif d == "u":
                parts.append((F.weekday(ts) + 1).cast("string"))
            elif d == "w":
                parts.append((F.dayofweek(ts) - 1).cast("string"))
            elif d == "q":
                parts.append(F.quarter(ts).cast("string"))
            elif d == "%":
                parts.append(F.lit("%"))
            else:
                raise ValueError(f"unknown directive %{d}")
        else:
            parts.append(F.lit(pattern[k]))
            k += 1
    return F.concat(*parts)


def day_part(ts: Column) -> Column:
    """Names of the parts of a day, by hour and minute."""
    hm = F.hour(ts) * 100 + F.minute(ts)
    return F.when(hm < 600, "凌晨").when(hm < 900, "早上").when(hm < 1130, "上午").when(hm < 1230, "中午").when(hm < 1800, "下午").otherwise("晚上")


#: Chinese names of the months, and of the days of the week from Sunday on.
MONTHS = "一月 二月 三月 四月 五月 六月 七月 八月 九月 十月 十一月 十二月".split()
WEEKDAYS = "星期日 星期一 星期二 星期三 星期四 星期五 星期六".split()


def chinese_month(ts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, MONTHS)), F.month(ts))


def chinese_date(ts: Column) -> Column:
    """Year, month, day and day of the week, such as 2024年2月29日星期四."""
    day = F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.dayofweek(ts))
    return F.concat(F.year(ts), F.lit("年"), F.month(ts), F.lit("月"), F.dayofmonth(ts), F.lit("日"), day)
