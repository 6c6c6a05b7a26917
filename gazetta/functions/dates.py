"""Dates in text and urls, deadlines, quiet hours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts that are tried in order (fixed values).
LAYOUTS = ("yyyy-M-d", "yyyy/M/d", "yyyy.M.d", "yyyy年M月d日", "yyyyMMdd")


def parse_date(text: Column) -> Column:
    """First layout that reads the text without its time of day; null otherwise."""
    day = F.regexp_replace(F.trim(text), r"[ T].*$", "")
    return F.coalesce(*[F.try_to_date(day, layout) for layout in LAYOUTS])


def deadline(text: Column) -> Column:
    """``yyyy-MM-dd`` or ``yyyy-MM-dd HH:mm`` from the first date in the text; null without one."""
    form = r"([0-9]{4})[-/年.]([0-9]{1,2})[-/月.]([0-9]{1,2})日?\s*(?:([0-9]{1,2})[:：时]([0-9]{1,2}))?"
    part = lambda k: F.regexp_extract(text, form, k)
    day = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    clock = F.concat(F.lit(" "), F.lpad(part(4), 2, "0"), F.lit(":"), F.lpad(part(5), 2, "0"))
    return F.when(part(1) != "", F.concat(day, F.when(part(4) != "", clock).otherwise("")))


def url_date(url: Column) -> Column:
    """Date in a url's path as /yyyymmdd/ or /yyyy/mm/dd/."""
    text = F.regexp_extract(url, r"/([0-9]{4})/?([0-9]{2})/?([0-9]{2})(?:/|$)", 0)
    return F.try_to_date(F.regexp_replace(text, "/", ""), "yyyyMMdd")


def proximity(a: Column, b: Column) -> Column:
    """1 for equal texts, .9 for the same day, .7 month, .4 year, else 0; nulls and blanks count as far."""
    same = lambda n: F.left(a, F.lit(n)) == F.left(b, F.lit(n))
    dated = a.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") & b.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}")
    near = F.when(a == b, 1.0).when(dated & same(10), 0.9).when(dated & same(7), 0.7).when(dated & same(4), 0.4).otherwise(0.0)
    return F.when(F.coalesce(a, F.lit("")) == "", 0.0).when(F.coalesce(b, F.lit("")) == "", 0.0).otherwise(near)


def is_quiet(hour: Column, start: int = 22, end: int = 7) -> Column:
    """Whether an hour of the day lies in the quiet hours, which may go over midnight."""
    return (hour >= start) | (hour < end) if start > end else (hour >= start) & (hour < end)


def active_hours(start: Column, end: Column, quiet_from: int = 22, quiet_to: int = 7) -> Column:
    """Whole hours begun from ``start`` until before ``end`` that are not quiet."""
    hours = F.when(end > start, F.sequence(F.date_trunc("hour", start), end - F.expr("interval 1 microsecond"), F.expr("interval 1 hour"))).otherwise(F.array().cast("array<timestamp>"))
    return F.size(F.filter(hours, lambda h: ~is_quiet(F.hour(h), quiet_from, quiet_to)))
