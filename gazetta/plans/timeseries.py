"""Health of sources and demand over time. Events are the log: user_id is the source, 'error' a failure, value the response."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import active_hours, is_quiet
from ..operators import facets, health, merge
from ..sources.tables import read
from .registry import query

_LOG = "log AS (SELECT user_id AS source, ts, epoch_us(ts) AS us, event_id, event_type <> 'error' AS ok, value AS response FROM events)"
_ORDER = ["us", "event_id"]


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(F.col("user_id").alias("source"), "ts", us.alias("us"), "event_id", (F.col("event_type") != "error").alias("ok"), F.col("value").alias("response"))


_ROLLING = f"""WITH {_LOG}, i AS (SELECT *, sum(ok::INT) OVER (PARTITION BY source ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM log), r AS (
    SELECT source, event_id, us, ok, avg(ok::INT) OVER (PARTITION BY source ORDER BY us, event_id ROWS 19 PRECEDING) AS rate_short, avg(ok::INT) OVER w AS rate_long,
           avg(response) OVER w AS mean_response, stddev_pop(response) OVER w AS deviation,
           sum((NOT ok)::INT) OVER (PARTITION BY source, island ORDER BY us, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS failures,
           row_number() OVER (PARTITION BY source ORDER BY us DESC, event_id DESC) AS place
    FROM i WINDOW w AS (PARTITION BY source ORDER BY us, event_id ROWS 499 PRECEDING))"""


@query(_ROLLING + " SELECT source, event_id, round(rate_short, 6) AS rate_short, round(mean_response + 1e-9, 4) AS mean_response, round(coalesce(deviation / nullif(mean_response, 0), 0), 4) AS variation FROM r")
def last20_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.rolling(log(spark, sf_dir), _ORDER).select("source", "event_id", F.round("rate_short", 6).alias("rate_short"), F.round(F.col("mean_response") + 1e-9, 4).alias("mean_response"), F.round("variation", 4).alias("variation"))


@query(_ROLLING + " SELECT source, event_id, failures FROM r")
def consecutive_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.rolling(log(spark, sf_dir), _ORDER).select("source", "event_id", "failures")


@query(_ROLLING + " SELECT source, event_id FROM (SELECT *, (SELECT response FROM log WHERE log.event_id = r.event_id) AS response FROM r) WHERE abs(response - mean_response) > 2 * deviation")
def outlier_2sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.rolling(log(spark, sf_dir), _ORDER).where("abs(response - mean_response) > 2 * deviation").select("source", "event_id")


_RECENT = f"WITH {_LOG}, c AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY us DESC, event_id DESC) AS place, least(count(*) OVER (PARTITION BY source), %d) AS held FROM log)"


@query(_RECENT % 40 + """ SELECT source, round(CASE WHEN count(*) >= 10 THEN (avg(response) FILTER (WHERE place <= held / 2.0) - avg(response) FILTER (WHERE place > held / 2.0))
       / (avg(response) FILTER (WHERE place > held / 2.0) + 1e-9) ELSE 0 END, 6) AS trend FROM c WHERE place <= 40 GROUP BY source""")
def half_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.half_trend(log(spark, sf_dir), F.col("response"), _ORDER).select("source", F.round("trend", 6).alias("trend"))


@query(_RECENT % 20 + """, m AS (SELECT source, avg(response) FILTER (WHERE place <= 10) / nullif(avg(response) FILTER (WHERE place > 10), 0) AS ratio FROM c WHERE place <= 20 GROUP BY source)
       SELECT source, CASE WHEN ratio > 1.2 THEN 'rising' WHEN ratio < 0.8 THEN 'falling' ELSE 'stable' END AS direction FROM m""")
def load_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.load_trend(log(spark, sf_dir), F.col("response"), _ORDER)


_SCORED = _ROLLING + """, l AS (SELECT r.*, coalesce(deviation / nullif(mean_response, 0), 0) AS variation FROM r WHERE place = 1), c AS (
    SELECT source, max(us) AS last_us, count(*) AS held FROM log GROUP BY 1), e AS (
    SELECT source, any_value(CASE WHEN held >= 20 THEN l.rate_long - l.rate_short ELSE 0 END) AS trend, count(*) FILTER (WHERE NOT g.ok AND g.response > 20 AND g.us > last_us - 86400000000) AS bans
    FROM log g JOIN c USING (source) JOIN l USING (source) GROUP BY source), s AS (
    SELECT l.source, failures, trend, greatest(0, least(1, 0.5 + 0.5 * rate_long + 0.15 - greatest(0, least(0.15, variation * 0.15)) - greatest(0, least(0.2, trend * 0.5)) - least(0.15, failures * 0.03) - least(0.10, bans * 0.025))) AS health,
        greatest(CASE WHEN failures >= 5 THEN 0.9 WHEN failures >= 3 THEN 0.6 WHEN failures >= 2 THEN 0.3 ELSE 0 END, CASE WHEN rate_short < 0.5 THEN least(0.8, (0.5 - rate_short) * 2) ELSE 0 END,
                 CASE WHEN trend > 0.3 THEN 0.7 WHEN trend > 0.15 THEN 0.4 ELSE 0 END, CASE WHEN variation > 1.0 THEN 0.5 WHEN variation > 0.5 THEN 0.25 ELSE 0 END) AS ban
    FROM l JOIN e USING (source))"""


@query(_SCORED + """ SELECT source, round(health, 6) AS health, round(ban, 6) AS ban, CASE WHEN ban >= 0.8 THEN 'critical' WHEN ban >= 0.6 THEN 'high' WHEN ban >= 0.3 THEN 'medium' ELSE 'low' END AS level,
       (CASE WHEN ban >= 0.8 THEN least(600, 100 * 10) WHEN ban >= 0.6 THEN least(300, 100 * 3) WHEN ban >= 0.3 THEN 100 * 1.5 ELSE 100 END)::DOUBLE AS interval_s FROM s""")
def health_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    # A failure with a slow response stands for a ban.
    joined = health.latest(rows, _ORDER).join(health.recent_bans(rows, ~F.col("ok") & (F.col("response") > 20)), "source")
    ban = health.ban_probability(F.col("failures"), F.col("rate_short"), F.col("trend"), F.col("variation"))
    scored = joined.select("source", health.health_score(F.col("rate_long"), F.col("variation"), F.col("trend"), F.col("failures"), F.col("bans")).alias("health"), ban.alias("ban"))
    level = health.risk_level(F.col("ban"))
    return scored.select("source", F.round("health", 6).alias("health"), F.round("ban", 6).alias("ban"), level.alias("level"), health.adjusted_interval(F.lit(100.0), level).alias("interval_s"))


@query(f"WITH {_LOG} SELECT source, event_id, count(*) OVER (PARTITION BY source ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS demand FROM log")
def demand_1h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.demand(log(spark, sf_dir), "us", 3_600_000_000).select("source", "event_id", "demand")


@query(f"WITH {_LOG} SELECT source, event_id, round(avg(response) OVER (PARTITION BY source ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) + 1e-9, 6) AS running FROM log")
def running_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.running_mean(log(spark, sf_dir), "response", _ORDER).select("source", "event_id", F.round(F.col("running") + 1e-9, 6).alias("running"))


@query(f"WITH {_LOG} SELECT source, event_id FROM (SELECT *, lag(ok, 1, true) OVER (PARTITION BY source ORDER BY us, event_id) AS before FROM log) WHERE NOT ok AND before")
def alert_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.edges(log(spark, sf_dir), ~F.col("ok"), _ORDER).select("source", "event_id")


@query(f"""WITH {_LOG}, f AS (SELECT *, response > 20 AS flag FROM log), s AS (SELECT *, sum((NOT flag)::INT) OVER (PARTITION BY source ORDER BY us RANGE UNBOUNDED PRECEDING) AS spell FROM f)
    SELECT source, min(us) AS since_s, max(us) AS until_s, max(us) - min(us) AS held_s FROM s WHERE flag GROUP BY source, spell HAVING max(us) - min(us) >= 3600000000""")
def alert_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.sustained(log(spark, sf_dir), F.col("response") > 20, "us", 3_600_000_000)


@query(f"""WITH {_LOG}, d AS (SELECT source, event_id, us - lag(us) OVER w AS gap, row_number() OVER w AS n FROM log WINDOW w AS (PARTITION BY source ORDER BY us, event_id)),
    v AS (SELECT source, event_id, n, stddev_pop(gap) OVER w / nullif(avg(gap) OVER w, 0) AS cv, count(gap) OVER w AS k FROM d WINDOW w AS (PARTITION BY source ORDER BY n ROWS 2 PRECEDING))
    SELECT source, event_id FROM v WHERE k = 3 AND cv < 0.2""")
def oscillation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.steady(log(spark, sf_dir), "us", _ORDER).select("source", "event_id")


@query("""SELECT strftime(d, '%Y-%m-%d') AS day, (SELECT count(*) FROM events WHERE ts::DATE = d) AS n FROM (SELECT unnest(range(DATE '2024-01-29', DATE '2024-02-05', INTERVAL 1 DAY)) AS d)""")
def week_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.week_grid(read(spark, sf_dir, "events"), F.col("ts"), "2024-01-29")


@query("""SELECT day, n, matched FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS matched FROM events GROUP BY 1) ORDER BY day DESC LIMIT 14""")
def daily_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("date").cast("string").alias("day"), (F.col("event_type") == "error").alias("matched"))
    return facets.tail_days(rows, "day", 14)


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 10) AS high, round(avg(value) FILTER (WHERE value > 10), 6) AS mean_high FROM events GROUP BY 1""")
def filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 10).alias("high"), F.round(F.avg(F.when(F.col("value") > 10, F.col("value"))), 6).alias("mean_high"))


@query("""WITH d AS (SELECT ts::DATE::VARCHAR AS day, count(*) AS total, count(*) FILTER (WHERE event_type <> 'error') AS good, avg(value) AS latency FROM events GROUP BY 1)
    SELECT day, total, good, round(latency, 4) AS latency, round(100.0 * good / total * 0.7 + greatest(0, 100 - latency) * 0.3, 2) AS score FROM d""")
def health_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = read(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("event_type") != "error").alias("good"), F.avg("value").alias("latency"))
    score = F.lit(100.0) * F.col("good") / F.col("total") * 0.7 + F.greatest(F.lit(0.0), 100 - F.col("latency")) * 0.3
    return days.select("day", "total", "good", F.round("latency", 4).alias("latency"), F.round(score, 2).alias("score"))


@query("""SELECT count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE ts::DATE = DATE '2024-01-31') AS today, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29') AS this_week,
       round(100.0 * count(*) FILTER (WHERE event_type <> 'error') / count(*), 2) AS complete FROM events""")
def dashboard_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").agg(
        F.count(F.lit(1)).alias("total"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("ts").cast("date") == F.lit("2024-01-31").cast("date")).alias("today"),
        F.count_if(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz")).alias("this_week"), F.round(F.lit(100.0) * F.count_if(F.col("event_type") != "error") / F.count(F.lit(1)), 2).alias("complete"))


@query("""SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, value LIMIT 3""")
def topk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.top_counts(read(spark, sf_dir, "events"), "event_type", 3)


@query("""WITH k AS (SELECT event_type, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS recent, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-24') AS older FROM events GROUP BY 1)
    SELECT *, round(recent / (older + 1.0), 6) AS score, recent / (older + 1.0) > 1.5 AS rising FROM k""")
def trending(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = F.lit("2024-01-24").cast("timestamp_ntz")
    counts = read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("ts") >= cut).alias("recent"), F.count_if(F.col("ts") < cut).alias("older"))
    score = F.col("recent") / (F.col("older") + 1.0)
    return counts.withColumns({"score": F.round(score, 6), "rising": score > 1.5})


@query("""SELECT event_type, count(*) FILTER (WHERE value <= 5) AS le_0, count(*) FILTER (WHERE value <= 10) AS le_1, count(*) FILTER (WHERE value <= 50) AS le_2, count(*) AS n FROM events GROUP BY 1""")
def histogram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facets.histogram(read(spark, sf_dir, "events"), "value", [5, 10, 50], ["event_type"])


@query("""WITH h AS (SELECT event_type, (epoch_us(ts) // 3600000000)::BIGINT AS hour, count(*) FILTER (WHERE value <= 5) AS a, count(*) FILTER (WHERE value <= 10) AS b, count(*) FILTER (WHERE value <= 50) AS c, count(*) AS n FROM events GROUP BY ALL)
    SELECT event_type, hour, round(n / 3600.0 + 1e-12, 9) AS rate, round(CASE WHEN a >= 0.95 * n THEN 5 * (0.95 * n) / a WHEN b >= 0.95 * n THEN 5 + 5 * (0.95 * n - a) / (b - a) WHEN c >= 0.95 * n THEN 10 + 40 * (0.95 * n - b) / (c - b) ELSE 50 END + 1e-9, 6) AS p95 FROM h""")
def bucket_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("hour", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000))
    counts = facets.histogram(rows, "value", [5, 10, 50], ["event_type", "hour"])
    p95 = facets.bucket_quantile(0.95, [5, 10, 50], ["le_0", "le_1", "le_2"], "n")
    return counts.select("event_type", "hour", F.round(F.col("n") / 3600.0 + 1e-12, 9).alias("rate"), F.round(p95 + 1e-9, 6).alias("p95"))


@query("""SELECT event_type, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def hist_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.95), 6).alias("p95"))


@query("""SELECT hour(ts)::INT AS hour, isodow(ts) <= 5 AS workday, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL""")
def workday_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour"), (F.weekday("ts") < 5).alias("workday")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("""SELECT hour(ts)::INT AS hour, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, hour LIMIT 3""")
def hourly_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy(F.hour("ts").alias("hour")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "hour").limit(3)


@query("""SELECT event_id, hour(ts) >= 22 OR hour(ts) < 7 AS quiet, (SELECT count(*) FROM range(0, 12) t(k) WHERE date_trunc('hour', ts) + to_hours(k) < ts + INTERVAL 10 HOUR
          AND NOT (hour(ts + to_hours(k)) >= 22 OR hour(ts + to_hours(k)) < 7)) AS active FROM events""")
def quiet_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    return read(spark, sf_dir, "events").select("event_id", is_quiet(F.hour("ts")).alias("quiet"), active_hours(at, at + F.expr("interval 10 hours")).alias("active"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type, epoch_us(ts) AS us FROM events),
    s AS (SELECT user_id, event_type, min(us) AS sent_us FROM e GROUP BY ALL
          UNION ALL SELECT s.user_id, s.event_type, (SELECT min(us) FROM e WHERE e.user_id = s.user_id AND e.event_type = s.event_type AND us >= s.sent_us + 86400000000) FROM s WHERE s.sent_us IS NOT NULL)
    SELECT user_id, event_type, sent_us FROM s WHERE sent_us IS NOT NULL""")
def suppressed_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.suppress(read(spark, sf_dir, "events"), ["user_id", "event_type"], "ts", 86_400)


@query(f"""WITH RECURSIVE {_LOG}, o AS (SELECT source, us / 1e6 AS s, row_number() OVER (PARTITION BY source ORDER BY us) AS n FROM log),
    b AS (SELECT source, n, s, 2.0::DOUBLE AS tokens, 1 AS granted FROM o WHERE n = 1
          UNION ALL SELECT o.source, o.n, o.s, CASE WHEN f.filled >= 1 THEN f.filled - 1 ELSE f.filled END, b.granted + (f.filled >= 1)::INT
          FROM b JOIN o ON o.source = b.source AND o.n = b.n + 1, LATERAL (SELECT least(3.0::DOUBLE, b.tokens + (o.s - b.s) * (1 / 36000.0::DOUBLE)) AS filled) f)
    SELECT source, max(n)::INT AS asked, max(granted)::INT AS granted FROM b GROUP BY 1""")
def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.token_bucket(log(spark, sf_dir).withColumn("s", F.col("us") / 1e6), "s", 3, 1 / 36_000)
