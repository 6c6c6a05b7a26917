"""Counts for dashboards: facets, zero-filled grids, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def facet_counts(df: DataFrame, columns: list[str], measure: str) -> DataFrame:
    """(facet, value, n, least, most) of each value of each column and of all rows, in one pass over GROUPING SETS."""
    sets = [[F.col(c)] for c in columns] + [[]]
    grouped = df.groupingSets(sets, *columns).agg(
        *[F.grouping(c).alias(f"_{c}") for c in columns], F.count(F.lit(1)).alias("n"), F.min(measure).alias("least"), F.max(measure).alias("most"))
    facet, value = F.lit("all"), F.lit("")
    for c in reversed(columns):
        facet, value = F.when(F.col(f"_{c}") == 0, F.lit(c)).otherwise(facet), F.when(F.col(f"_{c}") == 0, F.coalesce(c, F.lit(""))).otherwise(value)
    return grouped.select(facet.alias("facet"), value.alias("value"), "n", "least", "most")


def week_grid(df: DataFrame, day: Column, monday: str) -> DataFrame:
    """Counts of the seven days from a Monday on; days without rows have zero."""
    days = df.sparkSession.range(7).select(F.date_add(F.lit(monday).cast("date"), F.col("id").cast("int")).alias("day"))
    first = F.lit(monday).cast("date")
    counts = df.select(day.cast("date").alias("day")).where(F.col("day").between(first, F.date_add(first, 6))).groupBy("day").agg(F.count(F.lit(1)).alias("n"))
    return days.join(counts, "day", "left").select(F.col("day").cast("string").alias("day"), F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, value: str, bounds: list[float], group: list[str]) -> DataFrame:
    """Cumulative counts up to each bound and of all rows, as wide columns le_0, le_1 ..., n."""
    return df.groupBy(*group).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(bounds)], F.count(F.lit(1)).alias("n"))


def top_counts(df: DataFrame, column: str, k: int) -> DataFrame:
    """The ``k`` most frequent values; ties by value."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def tail_days(df: DataFrame, day: str, days: int) -> DataFrame:
    """Rows per day over the last ``days`` days that have any."""
    counts = df.groupBy(day).agg(F.count(F.lit(1)).alias("n"), F.count_if("matched").alias("matched"))
    return counts.withColumn("_place", F.row_number().over(Window.orderBy(F.desc(day)))).where(F.col("_place") <= days).drop("_place")


def dated_facets(df: DataFrame, columns: list[str], day: str, days: int, unnamed: str) -> DataFrame:
    """(facet, value, n): rows of each value of each column (``unnamed`` for null), of the last ``days`` days that have any, and of all
    rows with their first and last day, in one pass over GROUPING SETS. ``day`` is a text like 2024-01-31."""
    named = [*columns, day]
    grouped = df.groupingSets([[F.col(c)] for c in named] + [[]], *named).agg(
        *[F.grouping(c).alias(f"_{c}") for c in named], F.count(F.lit(1)).alias("n"), F.concat_ws(" ", F.min(day), F.max(day)).alias("_range"))
    facet, value = F.lit("all"), F.col("_range")
    for c in reversed(named):
        facet, value = F.when(F.col(f"_{c}") == 0, F.lit(c)).otherwise(facet), F.when(F.col(f"_{c}") == 0, F.col(c) if c == day else F.coalesce(c, F.lit(unnamed))).otherwise(value)
    counts = grouped.select(facet.alias("facet"), value.alias("value"), "n")
    last = counts.where((F.col("facet") == day) & F.col("value").isNotNull()).orderBy(F.desc("value")).limit(days)
    return counts.where(F.col("facet") != day).unionByName(last)


def host_dashboard(df: DataFrame, url: str, day: str, full: str, today: str, days: int = 7) -> DataFrame:
    """One row (total, hosts, recent, complete): all rows, distinct hosts of urls, rows of the last ``days`` days up to ``today`` and later,
    and the percentage of those that are ``full``, null without any."""
    host = F.nullif(F.regexp_extract(F.lower(url), r"^[a-z]+://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    recent = F.col(day) >= F.date_sub(F.lit(today).cast("date"), days - 1)
    share = F.try_divide(100.0 * F.count_if(recent & F.col(full)), F.count_if(recent).cast("double"))
    return df.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(host).alias("hosts"), F.count_if(recent).alias("recent"), F.round(share, 1).alias("complete"))


def bucket_quantile(share: float, bounds: list[float], names: list[str], total: str) -> Column:
    """The quantile read from cumulative counts ``names`` up to ``bounds`` and of all rows: linear within the bucket where it falls, from 0 in
    the first; the last bound beyond it; null without rows."""
    rank = F.col(total) * share
    out = F.lit(float(bounds[-1]))
    for k in reversed(range(len(bounds))):
        low, before = (float(bounds[k - 1]), F.col(names[k - 1])) if k else (0.0, F.lit(0))
        within = F.coalesce(F.try_divide(rank - before, (F.col(names[k]) - before).cast("double")), F.lit(0.0))
        out = F.when(F.col(names[k]) >= rank, low + (bounds[k] - low) * within).otherwise(out)
    return F.when(F.col(total) > 0, out)
