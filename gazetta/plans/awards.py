"""Award analytics: suppliers stand for winners, order lines for awards, orders for projects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.predicates import period
from ..operators import ranking
from ..sources.tables import read
from .registry import query

_AWARDS = """SELECT s_name AS winner, l_orderkey AS project, l_extendedprice AS amount, l_discount AS score, l_shipdate::DATE AS day, l_partkey
             FROM lineitem JOIN supplier ON l_suppkey = s_suppkey"""


def awards(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers = read(spark, sf_dir, "lineitem", "supplier")
    return lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(
        F.col("s_name").alias("winner"), F.col("l_orderkey").alias("project"), F.col("l_extendedprice").alias("amount"), F.col("l_discount").alias("score"),
        F.col("l_shipdate").cast("date").alias("day"), "l_partkey", "l_linenumber",
    )


def _dated(df: DataFrame) -> DataFrame:
    """Dates as text, which both engines print alike."""
    return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})


def _rank_sql(order: str, where: str = "day BETWEEN DATE '1997-04-01' AND DATE '1997-06-30'") -> str:
    return f"""
    WITH a AS ({_AWARDS}), g AS (
        SELECT winner, count(DISTINCT project) AS project_count, round(sum(amount), 2) AS total_amount, round(avg(amount) + 1e-9, 2) AS avg_amount,
               round(avg(score) + 1e-9, 2) AS avg_score, min(day)::VARCHAR AS first_day, max(day)::VARCHAR AS last_day, count(*) AS award_rows
        FROM a WHERE {where} AND winner <> '' GROUP BY winner)
    SELECT *, row_number() OVER (ORDER BY {order} DESC NULLS LAST, winner) AS rank FROM g ORDER BY rank LIMIT 20"""


@query(_rank_sql("total_amount"))
def award_rank_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last, _ = period("quarter", 1997, 2)
    return _dated(ranking.rank_winners(awards(spark, sf_dir).where(F.col("day").between(first, last)), "amount"))


@query(_rank_sql("project_count"))
def award_rank_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last, _ = period("quarter", 1997, 2)
    return _dated(ranking.rank_winners(awards(spark, sf_dir).where(F.col("day").between(first, last)), "count"))


@query(f"WITH r AS ({_rank_sql('total_amount')}) SELECT count(*) AS winners, round(sum(total_amount), 2) AS amount, sum(project_count)::BIGINT AS projects FROM r")
def award_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = award_rank_amount(spark, sf_dir)
    return top.agg(F.count(F.lit(1)).alias("winners"), F.round(F.sum("total_amount"), 2).alias("amount"), F.sum("project_count").alias("projects"))


@query(f"""
    WITH a AS ({_AWARDS}), g AS (
        SELECT quarter(day) AS quarter, winner, count(DISTINCT project) AS project_count, round(sum(amount), 2) AS total_amount
        FROM a WHERE day BETWEEN DATE '1997-01-01' AND DATE '1997-12-31' GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY total_amount DESC NULLS LAST, winner) AS rank FROM g) WHERE rank <= 3""")
def award_quarter_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last, _ = period("year", 1997)
    rows = awards(spark, sf_dir).where(F.col("day").between(first, last)).withColumn("quarter", F.quarter("day"))
    return ranking.top_per_group(rows, ["quarter"], 3)


@query(f"""
    WITH a AS ({_AWARDS}), g AS (
        SELECT year(day) AS year, winner, count(DISTINCT project) AS project_count, round(sum(amount), 2) AS total_amount FROM a GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY total_amount DESC NULLS LAST, winner) AS rank FROM g) WHERE rank <= 10""")
def award_year_top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_per_group(awards(spark, sf_dir).withColumn("year", F.year("day")), ["year"], 10)


_TYPED = f"""a AS ({_AWARDS}), t AS (SELECT a.*, unnest(string_split(p_name, ' ')) AS type FROM a JOIN part ON l_partkey = p_partkey)"""


@query(f"""
    WITH {_TYPED}, g AS (SELECT type, winner, count(DISTINCT project) AS project_count, round(sum(amount), 2) AS total_amount FROM t GROUP BY ALL),
    r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY total_amount DESC NULLS LAST, winner) AS rank FROM g) WHERE rank <= 5)
    SELECT *, round(sum(total_amount) OVER (PARTITION BY type), 2) AS type_amount FROM r""")
def award_rank_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, suppliers, parts = read(spark, sf_dir, "lineitem", "supplier", "part")
    typed = lines.select("l_suppkey", "l_partkey", F.col("l_orderkey").alias("project"), F.col("l_extendedprice").alias("amount")).join(
        parts.select("p_partkey", F.split("p_name", " ").alias("types")), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "project", "amount", F.explode("types").alias("type"))
    top = ranking.top_per_group(typed, ["type"], 5, suppliers.select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("winner")), "l_suppkey")
    return top.withColumn("type_amount", F.round(F.sum("total_amount").over(Window.partitionBy("type")), 2))


@query(f"""
    WITH {_TYPED}, g AS (SELECT winner, round(sum(amount), 2) AS total_amount FROM a WHERE day BETWEEN DATE '1997-04-01' AND DATE '1997-06-30' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20),
    y AS (SELECT winner, array_to_string(list_sort(list_distinct(list(type))), ',') AS types FROM t WHERE day BETWEEN DATE '1997-04-01' AND DATE '1997-06-30' GROUP BY 1)
    SELECT winner, total_amount, types FROM g JOIN y USING (winner)""")
def award_rank_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, last, _ = period("quarter", 1997, 2)
    parts = read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("types"))
    rows = awards(spark, sf_dir).where(F.col("day").between(first, last))
    top = ranking.rank_winners(rows, "amount")
    return ranking.with_types(top, rows.join(parts, F.col("l_partkey") == F.col("p_partkey")), "types").select("winner", "total_amount", F.array_join("types", ",").alias("types"))


@query(f"""
    WITH a AS (SELECT l_orderkey, l_linenumber, s_name AS winner, l_extendedprice AS amount, l_shipdate::DATE::VARCHAR AS day, p_name
               FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey)
    SELECT l_orderkey AS project, l_linenumber, winner, amount, day, p_name FROM a
    WHERE winner = (SELECT min(s_name) FROM supplier) AND list_has_any(string_split(p_name, ' '), (SELECT list_distinct(string_split(p_name, ' ')) FROM part WHERE p_partkey = 1))""")
def award_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, suppliers = read(spark, sf_dir, "part", "supplier")
    name = suppliers.agg(F.min("s_name").alias("winner"))
    wanted = parts.where("p_partkey = 1").select(F.split("p_name", " ").alias("wanted"))
    rows = awards(spark, sf_dir).join(F.broadcast(name), "winner").join(parts.select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"), "left")
    return rows.join(F.broadcast(wanted), F.arrays_overlap(F.split("p_name", " "), "wanted")).select("project", "l_linenumber", "winner", "amount", F.col("day").cast("string").alias("day"), "p_name")


@query("""
    WITH n AS (SELECT o_orderkey, coalesce(nullif(CASE WHEN o_custkey % 7 = 0 THEN '' ELSE 'P-' || o_custkey END, ''), 'url-' || o_orderkey) AS key,
                      o_orderstatus, o_orderpriority, o_totalprice, o_orderdate::DATE AS day FROM orders)
    SELECT key, count(*) AS n, max(o_orderpriority) AS priority, max(day)::VARCHAR AS last_day, string_agg(DISTINCT o_orderstatus, '|' ORDER BY o_orderstatus) AS statuses,
           max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS done_amount
    FROM n WHERE length(key) >= 6 GROUP BY key ORDER BY last_day DESC NULLS LAST, key LIMIT 100""")
def project_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("o_custkey") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("P-"), "o_custkey"))
    notices = read(spark, sf_dir, "orders").withColumn("key", F.coalesce(F.nullif(number, F.lit("")), F.concat(F.lit("url-"), "o_orderkey")))
    groups = notices.where((F.length("key") >= 6) & ~F.col("key").rlike("[一-鿿]")).groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.max("o_orderpriority").alias("priority"), F.max(F.col("o_orderdate").cast("date")).cast("string").alias("last_day"),
        F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "|").alias("statuses"), F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("done_amount"),
    )
    return groups.orderBy(F.desc_nulls_last("last_day"), "key").limit(100)


@query("""
    WITH c AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
    SELECT c_custkey, c_name, array_to_string(list(o_orderkey::VARCHAR ORDER BY place), ',') AS items
    FROM customer LEFT JOIN (SELECT * FROM c WHERE place <= 10) ON o_custkey = c_custkey GROUP BY ALL""")
def project_groups_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers, orders = read(spark, sf_dir, "customer", "orders")
    nested = ranking.nest_children(customers.select("c_custkey", "c_name"), orders.withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", "o_orderdate", "o_orderkey", ["o_orderkey"])
    return nested.select("c_custkey", "c_name", F.nullif(F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ","), F.lit("")).alias("items"))


@query("""
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey, l_returnflag ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem)
    WHERE rn = 1""".replace("SELECT * FROM (", "SELECT l_suppkey, l_partkey, l_returnflag, l_orderkey, l_linenumber FROM (", 1))
def dedup_first_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.merge import first_rows

    return first_rows(read(spark, sf_dir, "lineitem"), ["l_suppkey", "l_partkey", "l_returnflag"], ["l_orderkey", "l_linenumber"]).select(
        "l_suppkey", "l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("""
    SELECT source, doc_id, turn FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS turn FROM documents)
    WHERE turn <= 5 ORDER BY turn, source LIMIT 40""")
def round_robin_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.interleave(read(spark, sf_dir, "documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), "doc_id"], 5, 40).select("source", "doc_id", "turn")


@query("""
    SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE o_orderstatus = 'F' AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND (contains(lower(c_name), '7') OR contains(lower(o_orderpriority), '7'))
    ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25""")
def filtered_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.predicates import conjunction

    orders, customers = read(spark, sf_dir, "orders", "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey).where(conjunction(
        {"o_orderstatus": "F", "o_orderpriority": None}, {"o_orderdate": (date(1996, 1, 1), date(1997, 12, 31))}, ("7", ["c_name", "o_orderpriority"])))
    return ranking.page(rows.select("o_orderkey", "c_name", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, 25)


@query("""
    SELECT c_mktsegment AS segment, count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS in_credit, coalesce(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END), 0)::BIGINT AS in_debt
    FROM customer GROUP BY 1""")
def category_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("segment")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("in_credit"), F.count_if(F.col("c_acctbal") < 0).alias("in_debt"))


@query("""SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [read(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n") for t in ("nation", "region", "orders", "events")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
