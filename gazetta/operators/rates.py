"""Sliding rates over sparse counters: every source at every step, zero where nothing was counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sliding(events: DataFrame, key: str, at: Column, hit: Column, step: int, window: int) -> DataFrame:
    """(key, step, n, hits): events, and those that ``hit`` marks, in the ``window`` units of time up to the end of a step, for the steps that
    have any. ``at`` is in the units of ``step``, which divides the window.

    Events are counted per step where they are; a step's count then goes to each of the steps that look back on it, so no task holds a
    source and a busy source costs as many rows as it has steps.
    """
    if window % step:
        raise ValueError("the step must divide the window")
    counts = events.where(at.isNotNull()).groupBy(F.col(key), F.floor(at / step).cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    ahead = F.explode(F.sequence(F.lit(0), F.lit(window // step - 1))).alias("ahead")
    spread = counts.select(key, "step", "n", "hits", ahead)
    return spread.groupBy(key, (F.col("step") + F.col("ahead")).alias("step")).agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def filled(counts: DataFrame, sources: DataFrame, key: str, first: int, last: int) -> DataFrame:
    """The counts of every source at every step from ``first`` to ``last``, zeros included; also for sources that have none."""
    every = sources.select(key).distinct().withColumn("step", F.explode(F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))))
    joined = every.alias("e").join(counts.alias("c"), F.col(f"e.{key}").eqNullSafe(F.col(f"c.{key}")) & (F.col("e.step") == F.col("c.step")), "left")
    return joined.select(f"e.{key}", "e.step", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hits", F.lit(0)).alias("hits"))


def alerts(counts: DataFrame, key: str, window: int, bar: float, steps: int, block: int = 1440) -> DataFrame:
    """Add ``rate`` (hits a unit of time), ``ratio`` (hits of all; null where nothing was counted) and ``firing``: the ratio has been above the bar at
    the last ``steps`` steps. Windows run over blocks of steps that see the steps just before them."""
    near = F.pmod(F.col("step"), F.lit(block)) >= block - steps + 1
    at = F.floor(F.col("step") / block)
    rows = counts.withColumns({"rate": F.col("hits") / float(window), "ratio": F.when(F.col("n") > 0, F.col("hits") / F.col("n"))})
    rows = rows.withColumn("_block", F.explode(F.when(near, F.array(at, at + 1)).otherwise(F.array(at))))
    last = Window.partitionBy(key, "_block").orderBy("step").rowsBetween(1 - steps, 0)
    above = F.coalesce(F.col("ratio") > bar, F.lit(False))
    rows = rows.withColumn("firing", F.bool_and(above).over(last) & (F.count(F.lit(1)).over(last) == steps))
    return rows.where(F.col("_block") == at).drop("_block")
