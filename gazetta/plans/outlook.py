"""Risk of sources, pages in stated orders, totals of notices, a search that grows lenient, children of entities, queue and cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, extract
from ..operators import health, matching, merge, ranking, relevance
from ..sources.tables import read
from .registry import ORACLE_SQL, query
from .selection import _WANTED
from .timeseries import _ORDER, _SCORED, log


@query(_SCORED + """, h AS (SELECT source, response, row_number() OVER (PARTITION BY source ORDER BY us DESC, event_id DESC) AS k FROM log),
    z AS (SELECT *, least(count(*) OVER (PARTITION BY source), 40) AS of FROM h), t AS (SELECT source, CASE WHEN count(*) >= 10 THEN (avg(response) FILTER (WHERE k <= of / 2.0) - avg(response) FILTER (WHERE k > of / 2.0)) / (avg(response) FILTER (WHERE k > of / 2.0) + 1e-9) ELSE 0 END AS rise FROM z WHERE k <= 40 GROUP BY 1),
    d AS (SELECT s.source, s.health, s.ban, held, greatest(CASE WHEN s.trend > 0.2 THEN 0.7 WHEN s.trend > 0.1 THEN 0.4 ELSE 0 END, CASE WHEN rise > 0.5 THEN 0.6 ELSE 0 END, CASE WHEN variation > 0.8 THEN 0.5 ELSE 0 END,
                 CASE WHEN rate_long - rate_short > 0.2 THEN 0.6 ELSE 0 END) AS degradation FROM s JOIN l USING (source) JOIN c USING (source) JOIN t USING (source)), g AS (SELECT *, greatest(ban, degradation) AS p FROM d)
    SELECT source, round(degradation, 6)::DOUBLE AS degradation, least(1.0, held / 100.0)::DOUBLE AS confidence, CASE WHEN p >= 0.8 THEN 'critical' WHEN p >= 0.6 THEN 'high' WHEN p >= 0.3 THEN 'medium' ELSE 'low' END AS level,
           CASE WHEN p >= 0.8 THEN '立即暂停采集，进入恢复冷却期（15-30min）' WHEN p >= 0.6 THEN '大幅降低采集频率，切换备用站点或代理' WHEN p >= 0.3 THEN '适度降低采集密度，密切监控指标变化' WHEN health >= 0.7 THEN '正常运行，保持当前采集节奏' ELSE '站点尚未完全恢复，保持观察' END AS advice FROM g""")
def risk_outlook(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = log(spark, sf_dir)
    latest = health.latest(rows, _ORDER)
    rise = health.half_trend(rows, F.col("response"), _ORDER).withColumnRenamed("trend", "rise")
    joined = latest.join(rise, "source").join(health.recent_bans(rows, ~F.col("ok") & (F.col("response") > 20)), "source")
    ban = health.ban_probability(F.col("failures"), F.col("rate_short"), F.col("trend"), F.col("variation"))
    worse = health.degradation_probability(F.col("trend"), F.col("rise"), F.col("variation"), F.col("rate_long"), F.col("rate_short"))
    well = health.health_score(F.col("rate_long"), F.col("variation"), F.col("trend"), F.col("failures"), F.col("bans")) >= 0.7
    told = health.outlook(ban, worse, F.col("held"), well)
    return joined.select("source", F.round(worse, 6).alias("degradation"), told["confidence"].alias("confidence"), told["level"].alias("level"), told["advice"].alias("advice"))


_ORDERS = {"day_desc": ("day", True), "day_asc": ("day", False), "price_desc": ("price", True)}


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS day, o_totalprice AS price FROM orders),
    a AS (SELECT 'day_asc' AS asked, o_orderkey FROM o ORDER BY day ASC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 20), b AS (SELECT 'price_desc', o_orderkey FROM o ORDER BY price DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 20),
    c AS (SELECT 'unknown', o_orderkey FROM o ORDER BY day DESC NULLS LAST, o_orderkey DESC LIMIT 20 OFFSET 20) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def sorted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", day.alias("day"), F.col("o_totalprice").alias("price"))
    a, b, c = (ranking.ordered_page(rows, _ORDERS, asked, "o_orderkey", 2, 20).select(F.lit(asked).alias("asked"), "o_orderkey") for asked in ("day_asc", "price_desc", "unknown"))
    return a.unionByName(b).unionByName(c)


@query("""WITH p AS (SELECT CASE WHEN contains(p_name, 'red') THEN 'red' WHEN p_partkey % 4 = 0 THEN '' END AS matched, CASE WHEN p_partkey % 2 = 0 THEN '政府采购' ELSE '工程招投标' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '5万' END AS budget FROM part)
    SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(matched, '') = '') AS pending, count(*) FILTER (WHERE matched <> '') AS matched, count(*) FILTER (WHERE kind = '政府采购') AS gov_count,
           count(*) FILTER (WHERE kind = '工程招投标') AS eng_count, count(*) FILTER (WHERE budget <> '') AS budget_count FROM p""")
def notice_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = F.when(F.contains("p_name", F.lit("red")), "red").when(F.col("p_partkey") % 4 == 0, "")
    kind = F.when(F.col("p_partkey") % 2 == 0, "政府采购").otherwise("工程招投标")
    rows = read(spark, sf_dir, "part").select(matched.alias("matched"), kind.alias("kind"), F.when(F.col("p_partkey") % 3 == 0, "").otherwise("5万").alias("budget"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.coalesce("matched", F.lit("")) == "").alias("pending"), F.count_if(F.col("matched") != "").alias("matched"),
        F.count_if(F.col("kind") == "政府采购").alias("gov_count"), F.count_if(F.col("kind") == "工程招投标").alias("eng_count"), F.count_if(F.col("budget") != "").alias("budget_count"))


@query(f"SELECT p_partkey, best FROM ({ORACLE_SQL['keyword_matches']}) WHERE matched <> ''")
def search_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By vector (whose hits are no parts here), else by TF-IDF, else by substring."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")

    def by_vector() -> DataFrame:
        hits = relevance.nearest(read(spark, sf_dir, "embeddings"), F.col("embedding"), F.array_repeat(F.lit(1.0), 64), 50, "vec_id")
        return parts.join(hits, F.col("p_partkey") == -1 - F.col("vec_id")).select("p_partkey", F.col("score").alias("best"))

    def by_terms() -> DataFrame:
        keywords = spark.createDataFrame([(k,) for k in _WANTED], "keyword string")
        found = relevance.keyword_matches(parts, "p_partkey", "p_name", keywords, 0.15)
        return found.where(F.size("matched") > 0).select(F.col("id").alias("p_partkey"), "best")

    by_words = lambda: parts.where(F.contains("p_name", F.lit(_WANTED[0]))).select("p_partkey", F.lit(1.0).alias("best"))
    return matching.first_that_finds(by_vector, by_terms, by_words)


_CHILDREN = "SELECT l_orderkey, l_partkey % 500 AS url, CASE WHEN l_suppkey % 3 = 0 THEN 'name:' || l_returnflag ELSE 'no:' || l_suppkey END AS parent, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS title, l_orderkey * 10 + l_linenumber AS stamp FROM lineitem"


@query(f"""WITH c AS ({_CHILDREN}), n AS (SELECT * FROM c WHERE stamp % 20 > 10 QUALIFY row_number() OVER (PARTITION BY url ORDER BY stamp DESC) = 1), o AS (SELECT * FROM c WHERE stamp % 20 <= 10 QUALIFY row_number() OVER (PARTITION BY url ORDER BY stamp DESC) = 1)
    SELECT coalesce(n.url, o.url) AS url, coalesce(n.parent, o.parent) AS parent, coalesce(nullif(n.title, ''), o.title, n.title) AS title FROM o FULL JOIN n ON o.url = n.url""")
def child_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of projects by url: the newest of a batch counts, blank titles don't replace others."""
    number = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(
        (F.col("l_partkey") % 500).alias("url"), merge.entity_key(number, F.col("l_returnflag")).alias("parent"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise("").alias("title"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    newest = lambda df: merge.latest_of(df, F.col("url"), [F.desc("at")]).drop("at")
    merged = merge.upsert(newest(rows.where("at % 20 <= 10")), newest(rows.where("at % 20 > 10")), "url", {"parent": "overwrite", "title": "keep_if_blank"})
    return merged.select("url", "parent", "title")


@query("""SELECT event_id, user_id FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before IS NULL OR epoch_us(ts) - epoch_us(before) >= 3600000000""")
def queue_adds(spark: SparkSession, sf_dir: str) -> DataFrame:
    adds = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return merge.admitted(adds, "user_id", "us", "event_id", 3_600_000_000).select("event_id", "user_id")


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_custkey % 10 <> 0 THEN o_custkey END AS code, o_orderdate FROM orders) SELECT o_orderkey FROM o WHERE code IN (SELECT code FROM o WHERE o_orderdate >= DATE '1998-07-01' AND code IS NOT NULL)""")
def stale_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("code"), "o_orderdate")
    changed = rows.where(F.col("o_orderdate") >= F.lit("1998-07-01").cast("date"))
    return merge.affected(rows.select("o_orderkey", "code"), changed, "code").select("o_orderkey")


_CODES = ("014005001", "014005002", "014005003", "014005004", "014005005", "014005008", "014001019", "014001001", "014001014", "014001002", "014001003", "014001004", "014001020", "014001023", "014001016", "014001021", "014009001")
_PLAIN = {
    "014005001": "采购公告", "014005002": "变更公告", "014005004": "采购结果公告", "014005008": "单一来源公示", "014001019": "招标计划", "014001001": "招标公告", "014001014": "邀标信息", "014001002": "答疑补遗", "014001003": "中标候选人公示",
    "014001004": "中标结果公示", "014001020": "合同签订基本信息公示", "014001023": "合同变更基本信息公示", "014001016": "相关公告", "014001021": "终止公告",
}
_SHORT = ("014001019", "014001001", "014001002", "014001003", "014001004", "014001021", "014005001", "014005002", "014005004")


@query(f"""WITH u AS (SELECT p_partkey, {list(_CODES)}[p_partkey % {len(_CODES)} + 1] AS code FROM part)
    SELECT p_partkey, CASE code {" ".join(f"WHEN '{c}' THEN '{n}'" for c, n in _PLAIN.items())} ELSE '' END AS collector, CASE code {" ".join(f"WHEN '{c}' THEN '{_PLAIN[c]}'" for c in _SHORT)} ELSE '' END AS parameter FROM u""")
def url_type_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("p_partkey") % len(_CODES) + 1).cast("int"))
    path = F.concat(F.lit("http://x/xxhz/"), F.left(code, F.lit(6)), F.lit("/"), code, F.lit("/1.html"))
    asked = F.concat(F.lit("http://x/list?categoryNum="), code, F.lit("004&page=1"))
    return read(spark, sf_dir, "part").select("p_partkey", extract.collector_type(path).alias("collector"), extract.parameter_type(asked).alias("parameter"))


@query("""WITH b AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '约' || p_partkey || '.5万元' WHEN 1 THEN p_partkey || '亿元' WHEN 2 THEN '1,' || (100 + p_partkey % 900) || '.50元' WHEN 3 THEN '面议' END AS text FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN (p_partkey + 0.5) * 10000 WHEN 1 THEN p_partkey * 100000000.0 WHEN 2 THEN 1100.5 + p_partkey % 900 END::DOUBLE AS large,
           CASE p_partkey % 5 WHEN 0 THEN p_partkey + 0.5 WHEN 1 THEN p_partkey WHEN 2 THEN 1100.5 + p_partkey % 900 END::DOUBLE AS digits FROM b""")
def budget_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, k = F.col("p_partkey"), F.col("p_partkey") % 5
    text = F.when(k == 0, F.concat(F.lit("约"), key.cast("string"), F.lit(".5万元"))).when(k == 1, F.concat(key.cast("string"), F.lit("亿元"))).when(k == 2, F.concat(F.lit("1,"), (key % 900 + 100).cast("string"), F.lit(".50元"))).when(k == 3, "面议")
    return read(spark, sf_dir, "part").select("p_partkey", amounts.amount_in_large_units(text).alias("large"), amounts.amount_of_digits(text).alias("digits"))
