"""Health of sources over the last rows and times of their logs (source, ts, ok, response): windows as Column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks
from .merge import scan_sorted

#: Rows that a source's statistics look back on.
SHORT, LONG = 20, 500

#: What to do at a level of risk (fixed values).
ADVICE = {
    "critical": "立即暂停采集，进入恢复冷却期（15-30min）", "high": "大幅降低采集频率，切换备用站点或代理", "medium": "适度降低采集密度，密切监控指标变化",
    "low": "正常运行，保持当前采集节奏", "recovering": "站点尚未完全恢复，保持观察",
}


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def rolling(log: DataFrame, order: list[str]) -> DataFrame:
    """Add per row: success rate of the last SHORT and LONG rows, mean, deviation and variation of response times over LONG rows,
    the number of failures in a row up to here, and ``trend``: how much the error rate of the last SHORT rows is above that of
    the last LONG rows, 0 while there are fewer than SHORT. ``n`` is the row's number in its source.

    Windows run over blocks of a source's rows; a block also sees the LONG - 1 rows before it and the last success of earlier blocks.
    """
    rows = blocks.blocked(blocks.numbered(log, "source", order), LONG - 1)
    by = Window.partitionBy("source", "block").orderBy("n")
    short, long = by.rowsBetween(1 - SHORT, 0), by.rowsBetween(1 - LONG, 0)
    ok = F.col("ok").cast("double")
    out = rows.withColumns({
        "rate_short": F.avg(ok).over(short), "rate_long": F.avg(ok).over(long), "mean_response": F.avg("response").over(long), "deviation": F.stddev_pop("response").over(long),
        "succeeded": F.max(F.when(F.col("ok"), F.col("n"))).over(by.rowsBetween(Window.unboundedPreceding, 0)),
    })
    upto = Window.partitionBy("_source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.where("own").groupBy(F.col("source").alias("_source"), F.col("block").alias("_block")).agg(F.max(F.when(F.col("ok"), F.col("n"))).alias("earlier"))
    last = last.withColumn("earlier", F.max("earlier").over(upto))
    joined = out.where("own").join(last, (F.col("block") == F.col("_block")) & F.col("source").eqNullSafe(F.col("_source")))
    trend = F.when(F.col("n") >= SHORT, F.col("rate_long") - F.col("rate_short")).otherwise(0.0)
    return joined.withColumns({
        "failures": F.col("n") - F.coalesce("succeeded", "earlier", F.lit(0)), "variation": F.coalesce(F.try_divide("deviation", "mean_response"), F.lit(0.0)), "trend": trend,
    }).drop("_source", "_block", "block", "own", "succeeded", "earlier")


def running_mean(log: DataFrame, value: str, order: list[str]) -> DataFrame:
    """Add ``running``: the mean of the value over the source's rows up to here; nulls don't count."""
    upto = Window.partitionBy("source", "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = blocks.with_earlier(blocks.ranged(log, "source", order), "source", before=F.sum(value), held=F.count(value))
    total = F.col("before") + F.coalesce(F.sum(value).over(upto), F.lit(0))
    return rows.withColumn("running", F.try_divide(total, F.col("held") + F.count(value).over(upto))).drop("part", "before", "held")


def demand(log: DataFrame, at: str, span: int) -> DataFrame:
    """Add ``demand``: rows of the source in the last ``span`` units of time, this moment's included. Blocks are spans of time."""
    within = Window.partitionBy("source", "block").orderBy(at).rangeBetween(-span, 0)
    return blocks.timed(log, at, span).withColumn("demand", F.count(F.lit(1)).over(within)).where("own").drop("block", "own")


def steady(log: DataFrame, at: str, order: list[str], variation: float = 0.2) -> DataFrame:
    """Rows whose last three gaps vary by less than ``variation`` of their mean."""
    rows = blocks.blocked(blocks.numbered(log, "source", order), 3)
    by = Window.partitionBy("source", "block").orderBy("n")
    last = by.rowsBetween(-2, 0)
    gaps = rows.withColumn("gap", F.col(at) - F.lag(at).over(by))
    told = gaps.withColumns({"cv": F.try_divide(F.stddev_pop("gap").over(last), F.avg("gap").over(last)), "k": F.count("gap").over(last)})
    return told.where(F.col("own") & (F.col("k") == 3) & (F.col("cv") < variation)).drop("block", "own", "n", "gap", "cv", "k")


def recent_bans(log: DataFrame, banned: Column, seconds: int = 86_400) -> DataFrame:
    """(source, bans): rows that ``banned`` marks within ``seconds`` before the source's last row; ``us`` are microseconds."""
    last = log.groupBy("source").agg(F.max("us").alias("last"))
    hit = log.where(banned).join(last, "source").where(F.col("us") > F.col("last") - seconds * 1_000_000).groupBy("source").agg(F.count(F.lit(1)).alias("bans"))
    return last.join(hit, "source", "left").select("source", F.coalesce("bans", F.lit(0)).alias("bans"))


def recent(log: DataFrame, order: list[str], rows: int) -> DataFrame:
    """The last ``rows`` rows of each source with ``place`` (1: newest) and ``held`` (how many there are)."""
    place = F.row_number().over(Window.partitionBy("source").orderBy(*[F.desc(o) for o in order]))
    cut = log.withColumn("place", place).where(F.col("place") <= rows)
    return cut.withColumn("held", F.count(F.lit(1)).over(Window.partitionBy("source")))


def latest(log: DataFrame, order: list[str]) -> DataFrame:
    """(source, held, rate_short, rate_long, mean_response, variation, trend, failures): what ``rolling`` says of the newest row of each source, where
    ``held`` and ``failures`` count up to LONG rows. Only the last LONG rows of a source leave a task, nothing is written or numbered."""
    cut = recent(log, order, LONG)
    ok = F.col("ok").cast("double")
    told = cut.groupBy("source").agg(
        F.max("held").alias("held"), F.avg(F.when(F.col("place") <= SHORT, ok)).alias("rate_short"), F.avg(ok).alias("rate_long"), F.avg("response").alias("mean_response"),
        F.coalesce(F.try_divide(F.stddev_pop("response"), F.avg("response")), F.lit(0.0)).alias("variation"), F.min(F.when(F.col("ok"), F.col("place"))).alias("_good"),
    )
    trend = F.when(F.col("held") >= SHORT, F.col("rate_long") - F.col("rate_short")).otherwise(0.0)
    return told.withColumns({"trend": trend, "failures": F.coalesce(F.col("_good") - 1, F.col("held"))}).drop("_good")


def half_trend(log: DataFrame, value: Column, order: list[str], rows: int = 40) -> DataFrame:
    """(source, trend): relative change from the older to the newer half of the last rows; 0 under ten rows."""
    cut = recent(log, order, rows)
    newer, older = F.avg(F.when(F.col("place") <= F.col("held") / 2, value)), F.avg(F.when(F.col("place") > F.col("held") / 2, value))
    return cut.groupBy("source").agg(F.when(F.count(F.lit(1)) >= 10, (newer - older) / (older + 1e-9)).otherwise(0.0).alias("trend"))


def health_score(rate_long: Column, variation: Column, trend: Column, failures: Column, bans: Column) -> Column:
    """0 to 1 from long success rate, less for varying response, rising errors, failures in a row and bans."""
    score = 0.5 + 0.5 * rate_long + 0.15 - clamp(variation * 0.15, 0, 0.15) - clamp(trend * 0.5, 0, 0.2) - F.least(F.lit(0.15), failures * 0.03) - F.least(F.lit(0.10), bans * 0.025)
    return clamp(score, 0, 1)


def ban_probability(failures: Column, rate_short: Column, trend: Column, variation: Column, enough: int = 5, floor: float = 0.5) -> Column:
    """Strongest of the signs: failures in a row, a low short-term rate, rising errors, varying response times."""
    return F.greatest(
        F.when(failures >= enough, 0.9).when(failures >= 3, 0.6).when(failures >= 2, 0.3).otherwise(0.0), F.when(rate_short < floor, F.least(F.lit(0.8), (floor - rate_short) * 2)).otherwise(0.0),
        F.when(trend > 0.3, 0.7).when(trend > 0.15, 0.4).otherwise(0.0), F.when(variation > 1.0, 0.5).when(variation > 0.5, 0.25).otherwise(0.0),
    )


def degradation_probability(trend: Column, response_trend: Column, variation: Column, rate_long: Column, rate_short: Column) -> Column:
    return F.greatest(
        F.when(trend > 0.2, 0.7).when(trend > 0.1, 0.4).otherwise(0.0), F.when(response_trend > 0.5, 0.6).otherwise(0.0),
        F.when(variation > 0.8, 0.5).otherwise(0.0), F.when(rate_long - rate_short > 0.2, 0.6).otherwise(0.0),
    )


def outlook(ban: Column, degradation: Column, held: Column, healthy: Column) -> dict[str, Column]:
    """Level of the greater of two probabilities, what to do about it, and how far to trust it (a hundred rows: fully)."""
    level = risk_level(F.greatest(ban, degradation))
    advice = F.when(healthy, ADVICE["low"]).otherwise(ADVICE["recovering"])
    for name in ("medium", "high", "critical"):
        advice = F.when(level == name, F.lit(ADVICE[name])).otherwise(advice)
    return {"level": level, "advice": advice, "confidence": F.least(F.lit(1.0), held / 100)}


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.8, "critical").when(score >= 0.6, "high").when(score >= 0.3, "medium").otherwise("low")


def adjusted_interval(seconds: Column, level: Column) -> Column:
    """Longer pauses at higher risk: half as long again at medium, three times (half a minute to five) at high, ten times (one minute
    to ten) at critical risk."""
    return F.when(level == "critical", clamp(seconds * 10, 60, 600)).when(level == "high", clamp(seconds * 3, 30, 300)).when(level == "medium", seconds * 1.5).otherwise(seconds)


def adaptive_interval(mean: Column, variation: Column, errors: Column) -> Column:
    """Mean response stretched by its variation and, above ten percent errors, by those; from half a second to a minute."""
    return clamp(mean * (1 + variation) * F.when(errors > 0.1, 1 + 5 * errors).otherwise(1.0), 0.5, 60)


def load_trend(log: DataFrame, value: Column, order: list[str]) -> DataFrame:
    """(source, direction): the last ten rows against the ten before; rising above 1.2, falling below 0.8."""
    cut = recent(log, order, 20)
    now, before = F.avg(F.when(F.col("place") <= 10, value)), F.avg(F.when(F.col("place") > 10, value))
    ratio = F.try_divide(now, before)
    return cut.groupBy("source").agg(F.when(ratio > 1.2, "rising").when(ratio < 0.8, "falling").otherwise("stable").alias("direction"))


def edges(log: DataFrame, flag: Column, order: list[str]) -> DataFrame:
    """Rows where an alert begins: the flag is set and wasn't in the row before of the source."""
    rows = blocks.blocked(blocks.numbered(log.withColumn("flag", flag), "source", order), 1)
    before = F.lag("flag", 1, False).over(Window.partitionBy("source", "block").orderBy("n"))
    return rows.withColumn("begins", F.col("flag") & ~before).where("own AND begins").drop("flag", "begins", "n", "block", "own")


def sustained(log: DataFrame, flag: Column, at: str, seconds: int) -> DataFrame:
    """(source, since_s, until_s, held_s) of spells in which the flag stays set for at least ``seconds``.

    A spell is known by the number of rows without the flag up to it, counted per range of the source's times and carried on."""
    unset = F.when(F.col("flag"), 0).otherwise(1)
    rows = blocks.with_earlier(blocks.ranged(log.withColumn("flag", flag), "source", [at]), "source", spell=F.sum(unset))
    marked = rows.withColumn("spell", F.col("spell") + F.sum(unset).over(Window.partitionBy("source", "part").orderBy(at)))
    spells = marked.where("flag").groupBy("source", "spell").agg(F.min(at).alias("since_s"), F.max(at).alias("until_s"))
    return spells.withColumn("held_s", F.col("until_s") - F.col("since_s")).where(F.col("held_s") >= seconds).drop("spell")


def token_bucket(requests: DataFrame, at: str, capacity: float, rate: float) -> DataFrame:
    """(source, asked, granted): requests in order of time against a bucket of ``capacity`` tokens refilled at ``rate`` a second.
    A partition is sorted by source and time, which spills, and scanned: of a source only the bucket is held. The scan says
    which requests are granted (1, others 0), and these are summed."""

    def take(times: np.ndarray, state: tuple[float, float] | None) -> tuple[np.ndarray, tuple[float, float]]:
        tokens, last = state or (float(capacity), float(times[0]))
        granted = np.zeros(len(times))
        for i, t in enumerate(times.tolist()):
            tokens, last = min(capacity, tokens + (t - last) * rate), t
            if tokens >= 1:
                tokens, granted[i] = tokens - 1, 1
        return granted, (tokens, last)

    scanned = scan_sorted(requests.select("source", F.col(at).cast("double").alias("granted")), ["source"], "granted", take)
    return scanned.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("asked"), F.sum("granted").cast("int").alias("granted"))
