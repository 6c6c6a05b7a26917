"""Upserts, patches and deltas on orders: the stored snapshot and the incoming batch are two slices of the table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import merge
from ..sources.tables import read
from .registry import query

_SLICES = """
    old AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS category, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS budget, 'old' AS title FROM orders WHERE o_orderkey % 10 < 7),
    new AS (SELECT o_orderkey AS url, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE lower(o_orderpriority) END AS category, CASE WHEN o_orderkey % 6 <> 0 THEN o_totalprice + 1 END AS budget, 'new' AS title FROM orders WHERE o_orderkey % 10 > 4)"""


def slices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    old = orders.where(key % 10 < 7).select(key.alias("url"), F.when(key % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("category"), F.when(key % 4 != 0, F.col("o_totalprice")).alias("budget"), F.lit("old").alias("title"))
    new = orders.where(key % 10 > 4).select(key.alias("url"), F.when(key % 5 == 0, "").otherwise(F.lower("o_orderpriority")).alias("category"), F.when(key % 6 != 0, F.col("o_totalprice") + 1).alias("budget"), F.lit("new").alias("title"))
    return old, new


_ACTION = "CASE WHEN o.url IS NULL THEN 'inserted' WHEN n.url IS NULL THEN 'kept' ELSE 'updated' END AS action FROM old o FULL JOIN new n ON o.url = n.url"


@query(f"WITH {_SLICES} SELECT coalesce(o.url, n.url) AS url, coalesce(nullif(n.category, ''), o.category, n.category) AS category, round(coalesce(n.budget, o.budget), 2) AS budget, coalesce(n.title, o.title) AS title, {_ACTION}")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = merge.upsert(*slices(spark, sf_dir), "url", {"category": "keep_if_blank", "budget": "keep_if_null", "title": "overwrite"})
    return merged.withColumn("budget", F.round("budget", 2))


@query(f"WITH {_SLICES} SELECT coalesce(o.url, n.url) AS url, coalesce(nullif(o.category, ''), n.category, o.category) AS category, {_ACTION}")
def first_writer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(*slices(spark, sf_dir), "url", {"category": "keep_existing"})


@query(f"WITH {_SLICES} SELECT url, title FROM new UNION ALL SELECT url, title FROM old WHERE url NOT IN (SELECT url FROM new)")
def delta_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.apply_delta(*slices(spark, sf_dir), "url").select("url", "title")


@query(f"WITH {_SLICES} SELECT o.url, coalesce(nullif(n.category, ''), o.category) AS category, o.title FROM old o LEFT JOIN new n ON o.url = n.url")
def sparse_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = slices(spark, sf_dir)
    return merge.patch(old, new, "url", ["category"]).select("url", "category", "title")


@query("""WITH a AS (SELECT l_orderkey, l_partkey, nullif(l_suppkey % 9, 0) AS winner, l_linenumber, l_extendedprice FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, winner ORDER BY l_orderkey, l_linenumber) AS n FROM a)
    SELECT l_orderkey, l_linenumber, l_partkey, winner FROM r WHERE winner IS NULL OR n = 1""")
def award_batch_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").withColumn("winner", F.nullif(F.col("l_suppkey") % 9, F.lit(0)))
    return merge.first_rows(rows, ["l_partkey", "winner"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "winner")
