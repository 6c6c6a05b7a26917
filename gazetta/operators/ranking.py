"""Rankings of winners by period and type, and grouping of notices by project."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to means before they are rounded, so that halves go up whatever the order in which they were summed.
NUDGE = 1e-9
MEASURES = {"amount": "total_amount", "count": "project_count"}


def rank_winners(awards: DataFrame, by: str = "amount", limit: int = 20) -> DataFrame:
    """Awards (winner, project, amount, score, day) by winner: distinct projects, sums, averages, first and last day, rows, and
    the rank by amount or count; winners without a name are left out, sums of nothing come last, ties go by name."""
    grouped = awards.where(F.col("winner").isNotNull() & (F.col("winner") != "")).groupBy("winner").agg(
        F.countDistinct("project").alias("project_count"), F.round(F.sum("amount"), 2).alias("total_amount"), F.round(F.avg("amount") + NUDGE, 2).alias("avg_amount"),
        F.round(F.avg("score") + NUDGE, 2).alias("avg_score"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count(F.lit(1)).alias("award_rows"),
    )
    order = [F.desc_nulls_last(MEASURES[by]), F.asc("winner")]
    top = grouped.orderBy(*order).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_per_group(awards: DataFrame, group: list[str], limit: int, names: DataFrame | None = None, key: str = "winner") -> DataFrame:
    """The ``limit`` winners of greatest amount in each group, with their rank; candidates are cut before the exchange. Awards may know winners
    by a ``key``; ``names`` (key, winner) are then joined to the sums of the winners, not to the awards."""
    grouped = awards.groupBy(*group, key).agg(F.countDistinct("project").alias("project_count"), F.round(F.sum("amount"), 2).alias("total_amount"))
    grouped = grouped if names is None else grouped.join(names, key).drop(key)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc_nulls_last("total_amount"), F.asc("winner")))
    return grouped.withColumn("rank", place).where(F.col("rank") <= limit)


def with_types(top: DataFrame, awards: DataFrame, types: str) -> DataFrame:
    """The ranked winners with ``types``: the distinct types of all their awards, sorted; none where no award has one. Only awards
    of ranked winners are looked at, of whom there are as many as the rank's limit says."""
    theirs = awards.join(F.broadcast(top.select("winner")), "winner", "left_semi")
    found = theirs.select("winner", F.explode(types).alias("_type")).distinct().groupBy("winner").agg(F.array_sort(F.collect_list("_type")).alias("types"))
    return top.join(found, "winner", "left").withColumn("types", F.coalesce("types", F.array().cast("array<string>")))


def nest_children(parents: DataFrame, children: DataFrame, key: str, newest: str, unique: str, fields: list[str], limit: int = 10) -> DataFrame:
    """Parents with an array of their newest children, at most ``limit``; the children are cut by rank, then collected."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(newest), F.desc(unique)))
    cut = children.withColumn("_place", place).where(F.col("_place") <= limit)
    lists = cut.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", *fields))), lambda x: F.struct(*[x[f] for f in fields])).alias("items"))
    return parents.join(lists, key, "left")


def interleave(df: DataFrame, group: str, order: list, quota: int, limit: int) -> DataFrame:
    """Take rows from the groups in turn, at most ``quota`` of each and ``limit`` in all."""
    df = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= quota)
    return df.orderBy("turn", group).limit(limit)


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """A page of the ordered rows; the order must be total."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def ordered_page(df: DataFrame, orders: dict[str, tuple[str, bool]], asked: str | None, unique: str, number: int, size: int) -> DataFrame:
    """A page in one of the stated orders (name -> column, descending); an unknown name means the first. Nulls last, ties by the
    greatest ``unique``, which has no repeats."""
    column, falling = orders.get(asked, next(iter(orders.values())))
    return page(df, [F.desc_nulls_last(column) if falling else F.asc_nulls_last(column), F.desc(unique)], number, size)
