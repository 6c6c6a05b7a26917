"""Streaming queries, run to the end of what is available; their oracle is the batch result on the same rows."""

from __future__ import annotations

import calendar
import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read
from ..streaming import flows
from ..streaming.delta_log import DeltaLog, SeenKeys
from . import timeseries  # noqa: F401  registers the batch forms
from .registry import ORACLE_SQL, query


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = flows.first_seen(flows.timed(flows.table_stream(spark, sf_dir, "events")), ["user_id", "event_type"])
    return flows.drained(spark, seen.select("user_id", "event_type"))


@query(ORACLE_SQL["suppressed_notices"])
def stream_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = flows.timed(flows.table_stream(spark, sf_dir, "events"))
    return flows.drained(spark, flows.suppress(stream, ["user_id", "event_type"], 86_400))


@query("""SELECT epoch_us(date_trunc('hour', ts)) AS from_us, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures FROM events
       GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")
def stream_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.drained(spark, flows.hourly_health(flows.timed(flows.table_stream(spark, sf_dir, "events"))))


@query(f"SELECT source AS user_id, asked, granted FROM ({ORACLE_SQL['token_bucket']})")
def stream_token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = flows.timed(flows.table_stream(spark, sf_dir, "events"))
    return flows.drained(spark, flows.token_bucket(stream, "user_id", 3.0, 1 / 36_000))


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 2 = 0 THEN 'stream' ELSE 'stored' END AS origin FROM orders")
def stream_delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_totalprice"]
    stored = read(spark, sf_dir, "orders").select(*columns).withColumn("origin", F.lit("stored"))
    stream = flows.table_stream(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(*columns).withColumn("origin", F.lit("stream"))
    return flows.merge_into_log(spark, stream, stored, "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 7 = 0 AND o_orderkey % 5 > 1 THEN 4 WHEN o_orderkey % 3 = 0 THEN 2 WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS version
       FROM orders WHERE o_orderkey % 11 <> 0 OR (o_orderkey % 7 = 0 AND o_orderkey % 5 > 1)""")
def delta_log_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five versions of a table: the whole, two deltas, a removal by keys, a delta that brings some of them back."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    log = DeltaLog(spark, f"{flows.shared_folder(spark)}/log", orders.withColumn("version", F.lit(0)).schema, "o_orderkey")
    for version, change in enumerate(("true", "o_orderkey % 100 = 0", "o_orderkey % 3 = 0", "o_orderkey % 11 = 0", "o_orderkey % 7 = 0 AND o_orderkey % 5 > 1")):
        rows = orders.where(change).withColumn("version", F.lit(version))
        log.remove(rows, version) if version == 3 else log.merge(rows, version)
    return log.read()


@query("""WITH RECURSIVE k AS (SELECT event_type || ':' || user_id AS k, date_trunc('day', ts)::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
             r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS i FROM k), last AS (SELECT max(day) AS d FROM k),
             d AS (SELECT r.* FROM r, last WHERE day > d - 3),
             o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY day) AS j FROM d),
             s AS (SELECT k, day, j, day AS marked, true AS admitted FROM o WHERE j = 1
                   UNION ALL SELECT o.k, o.day, o.j, CASE WHEN o.day - s.marked >= 2 THEN o.day ELSE s.marked END, o.day - s.marked >= 2 FROM s JOIN o ON o.k = s.k AND o.j = s.j + 1)
       SELECT 'two days' AS lifetime, epoch(day)::BIGINT AS now, count(*) AS n FROM s WHERE admitted GROUP BY ALL
       UNION ALL SELECT 'for ever', epoch(day)::BIGINT, count(*) FROM o WHERE j = 1 GROUP BY ALL""")
def seen_lifetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys admitted in each of the last three days' runs, with markers of two days and with markers for ever."""
    events = read(spark, sf_dir, "events").select(F.concat_ws(":", "event_type", "user_id").alias("k"), F.to_date("ts").alias("day"))
    last = events.agg(F.max("day")).first()[0]
    out = None
    for name, seconds in (("two days", 2 * 86_400), ("for ever", None)):
        seen = SeenKeys(spark, f"{flows.shared_folder(spark)}/seen", "k", events.schema["k"].dataType, seconds)
        for version in range(3):
            now = int(calendar.timegm((last - datetime.timedelta(days=2 - version)).timetuple()))
            rows = events.where(F.unix_date("day") == now // 86_400).select("k")
            run = seen.admit(rows, now, version).agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("lifetime"), F.lit(now).cast("bigint").alias("now"), "n")
            out = run if out is None else out.unionByName(run)
    return out
