"""What sinks write and sources read back: tables for spreadsheets, snapshots with totals, tables by url, levels of log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts
from ..sources import tables
from ..sources.tables import read
from ..streaming.flows import shared_folder
from .registry import query


@query("""SELECT c_custkey AS number, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), 'none, "so far"') AS segment, round(c_acctbal, 2)::VARCHAR AS balance FROM customer""")
def csv_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/csv"
    segment = F.when(F.col("c_custkey") % 3 == 0, None).otherwise(F.nullif("c_mktsegment", F.lit("")))
    columns = {"number": F.col("c_custkey"), "segment": F.coalesce(segment, F.lit('none, "so far"')), "balance": amounts.cents(F.col("c_acctbal"))}
    tables.csv_sink(read(spark, sf_dir, "customer"), folder, columns, mark=True)
    back = tables.csv_source(spark, folder, "number long, segment string, balance double")
    return back.withColumn("balance", amounts.number_text(F.col("balance")))


@query("""SELECT o_orderpriority AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 UNION ALL SELECT 'all', count(*), round(sum(o_totalprice), 2) FROM orders""")
def json_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    orders = read(spark, sf_dir, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("o_totalprice"))
    n, total = F.count(F.lit(1)), F.round(F.sum("o_totalprice"), 2)
    tables.snapshot_sink(orders, folder, {"n": n, "total": total})
    parts = spark.read.schema(orders.schema).json(f"{folder}/records").groupBy(F.col("o_orderpriority").alias("part")).agg(n.alias("n"), total.alias("total"))
    return parts.unionByName(spark.read.schema("n long, total double").json(f"{folder}/totals").withColumn("part", F.lit("all")))


@query("""SELECT CASE WHEN contains(url, '/en/') THEN 'english' WHEN contains(url, '/de/') THEN 'german' ELSE 'rest' END AS target_table, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1""")
def routed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/routed"
    route = F.when(F.contains("url", F.lit("/en/")), "english").when(F.contains("url", F.lit("/de/")), "german").otherwise("rest")
    tables.routed_sink(read(spark, sf_dir, "pages").select("page_id", "url"), folder, route)
    return spark.read.parquet(folder).groupBy("target_table").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))


LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


@query("""WITH l AS (SELECT date_trunc('second', ts) AS moment, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'INFO' END AS level FROM events WHERE event_id % 7 <> 0)
    SELECT level, count(moment) AS n FROM (SELECT unnest(['DEBUG', 'INFO', 'WARNING', 'ERROR', 'CRITICAL']) AS level) LEFT JOIN (SELECT * FROM l WHERE moment >= (SELECT max(moment) FROM l) - INTERVAL 1 DAY) USING (level) GROUP BY 1""")
def log_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/log"
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "Warning").otherwise("INFO")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss")
    line = F.when(F.col("event_id") % 14 == 0, "no line of the form").when(F.col("event_id") % 7 == 0, F.concat(F.lit("2024-13-45 10:00:00 | "), level, F.lit(" | x"))).otherwise(F.concat(at, F.lit(" | "), level, F.lit(" | message")))
    read(spark, sf_dir, "events").select(line.alias("value")).write.text(folder)
    lines = tables.log_lines(spark, folder, r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \| (\w+) \|", ("at", "level"))
    return tables.levels_of_late(lines, F.try_to_timestamp("at", F.lit("yyyy-MM-dd HH:mm:ss")), F.col("level"), LEVELS, 86_400)
