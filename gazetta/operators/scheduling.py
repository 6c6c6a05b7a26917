"""Planning of collection: priorities of tasks, intervals, worker counts, collector states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .health import clamp

#: Weights of the five factors before they are scaled to one (fixed values), and intervals by success rate.
WEIGHTS = {"timeliness": 0.30, "reliability": 0.20, "cost": 0.15, "success": 0.20, "demand": 0.15}
TIERS = ((0.95, 300, "fast"), (0.80, 600, "normal"), (0.50, 1200, "slow"), (0.0, 1800, "careful"))


def timeliness(hours_left: Column, days_old: Column, rising: bool = True) -> Column:
    """1 for what is overdue, .3 a week ahead, in between rising towards the deadline (``rising`` off: falling, as a historical
    variant). Without a deadline: fresh notices first, falling over a week to .2; .3 without either."""
    near = F.exp(-hours_left / 48) if rising else 1 - F.exp(-hours_left / 48)
    by_deadline = F.when(hours_left <= 0, 1.0).when(hours_left > 168, 0.3).otherwise(near)
    by_age = F.when(days_old < 0, 1.0).when(days_old > 7, 0.2).otherwise(1 - 0.8 * days_old / 7)
    return F.when(hours_left.isNotNull(), by_deadline).when(days_old.isNotNull(), by_age).otherwise(0.3)


def priority(factors: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    total, out = sum(weights.values()), F.lit(0.0)
    for name, value in factors.items():
        out = out + value * (weights[name] / total)
    return out


def reliability(mean_ms: Column) -> Column:
    return clamp((10_000 - mean_ms) / 9_500, 0, 1)


def cheapness(cost_ms: Column) -> Column:
    return clamp((30_000 - cost_ms) / 29_500, 0, 1)


def interval_tier(rate: Column, failures: Column, most: int = 3600) -> Column:
    """Struct (seconds, mode): back-off after three failures in a row, else by success rate."""
    out = F.struct(F.lit(TIERS[-1][1]).alias("seconds"), F.lit(TIERS[-1][2]).alias("mode"))
    for floor, seconds, mode in reversed(TIERS[:-1]):
        out = F.when(rate >= floor, F.struct(F.lit(seconds).alias("seconds"), F.lit(mode).alias("mode"))).otherwise(out)
    return F.when(failures >= 3, F.struct(F.lit(most).alias("seconds"), F.lit("backoff").alias("mode"))).otherwise(out)


def scaling(found: Column, rate: Column, trend: Column, odd: Column, hour: Column, up: float, down: float) -> Column:
    """What to do with the number of workers: the first rule that applies."""
    busy = hour.between(9, 18)
    return (
        F.when(odd, "maintain").when(rate < 0.5, "scale_down").when((trend == "rising") & (found > up), "scale_up").when(busy & (found > up), "scale_up")
        .when((trend == "falling") & (found < down) & ~busy, "scale_down").otherwise("maintain")
    )


def queue(tasks: DataFrame, url: str, score: str, most: int) -> DataFrame:
    """Best task of each url, the ``most`` best of all."""
    best = tasks.withColumn("_n", F.row_number().over(Window.partitionBy(url).orderBy(F.desc(score)))).where("_n = 1").drop("_n")
    return best.orderBy(F.desc(score), url).limit(most)


def stale(log: DataFrame, source: str, at: str, now: Column, seconds: int) -> DataFrame:
    """(source, last, age_s) of sources whose last row is older than ``seconds``."""
    last = log.groupBy(source).agg(F.max(at).alias("last"))
    return last.withColumn("age_s", now - F.col("last")).where(F.col("age_s") > seconds)


#: What remains of a task's priority at each risk (fixed values).
DISCOUNTS = {"low": 1.0, "medium": 0.8, "high": 0.5, "critical": 0.1}


def discounted(score: Column, risk: Column) -> Column:
    return score * F.element_at(F.create_map(*[F.lit(x) for kv in DISCOUNTS.items() for x in kv]), risk)


def deferred(score: Column, risk: Column, ban: Column) -> Column:
    """Why a task is put off: a critical source, a high one if the task's priority is under .5, a ban likelier than .7; null: it isn't."""
    return F.when(risk == "critical", "critical").when((risk == "high") & (score < 0.5), "high").when(ban > 0.7, "ban")


def forecast(history: DataFrame, start: Column, hours: int = 4, peaks: int = 3) -> DataFrame:
    """(at, expected) of the ``hours`` from ``start`` on, from a history of (at, found).

    A peak hour of the day expects its own mean, any other the mean of all; weekends expect 0.6 and hours outside 9 to 18
    0.3 of that. An empty history gives no rows.
    """
    by_hour = history.groupBy(F.hour("at").alias("hour")).agg(F.sum("found").alias("sum"), F.count("found").alias("n"))
    means = by_hour.agg(F.sum("sum").alias("sum"), F.sum("n").alias("n"), F.sort_array(F.collect_list(F.struct((F.col("sum") / F.col("n")).alias("mean"), (-F.col("hour")).alias("hour"))), False).alias("hours"))
    top = F.slice("hours", 1, peaks)
    ahead = F.explode(F.sequence(start, start + F.make_dt_interval(hours=F.lit(hours - 1)), F.expr("interval 1 hour")))
    rows = means.where("n > 0").select((F.col("sum") / F.col("n")).alias("mean"), F.map_from_arrays(F.transform(top, lambda x: -x["hour"]), F.transform(top, lambda x: x["mean"])).alias("peaks"), ahead.alias("at"))
    share = F.when(F.weekday("at") >= 5, 0.6).otherwise(1.0) * F.when(F.hour("at").between(9, 18), 1.0).otherwise(0.3)
    return rows.select("at", (F.coalesce(F.try_element_at("peaks", F.hour("at")), "mean") * share).alias("expected"))
