"""Names, numbers, questions and codes in short texts; resolution of entities; what may be shown; the hours ahead."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amounts, classify, dates, extract, text
from ..operators import matching, scheduling
from ..sources.tables import read
from .registry import query


def _one_of(number: str, *texts) -> F.Column:
    """Texts in turn, by the remainder of a number."""
    parts = [t if isinstance(t, F.Column) else F.lit(t) for t in texts]
    return F.element_at(F.array(*parts), (F.col(number) % len(parts) + 1).cast("int"))


@query("""SELECT o_orderkey, 'proj' || o_custkey || CASE WHEN o_orderkey % 5 = 3 THEN 'ab' WHEN o_orderkey % 5 = 4 THEN '二期' ELSE '' END AS name FROM orders""")
def project_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    ending = _one_of("o_orderkey", "（第2次）招标公告", "二次采购 中标结果公告", "分包3", " A-B 变更公告", "(二期)结果公告")
    name = F.concat(F.lit("Proj "), F.col("o_custkey").cast("string"), ending)
    return read(spark, sf_dir, "orders").select("o_orderkey", text.project_name(name).alias("name"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN 'BID-' || o_custkey WHEN 5 THEN 'P' || o_custkey || ',Q1' WHEN 0 THEN 'AB-' || o_custkey WHEN 1 THEN 'ABCD-' || lpad(o_custkey::VARCHAR, 6, '0') WHEN 2 THEN 'cq-2024-' || lpad(o_custkey::VARCHAR, 6, '0') END AS number FROM orders""")
def project_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, padded = F.col("o_custkey").cast("string"), F.lpad(F.col("o_custkey").cast("string"), 6, "0")
    title = _one_of("o_orderkey", F.concat(F.lit("采购 编号： AB-"), key), F.concat(F.lit("改造["), F.lit("ABCD-"), padded, F.lit("]")), F.lit("公告"), F.lit("无编码"),
                    F.concat(F.lit("项目编号：PRJ-"), key, F.lit(" 招标编号：BID-"), key), F.concat(F.lit("(ABCDEF12) 编号：Z-1"), F.lit("")))
    body = F.when(F.col("o_orderkey") % 6 == 5, F.concat(F.lit("采购编号：C-2 项目号：P"), key, F.lit(",Q1"))).when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("见 cq-2024-"), padded, F.lit(" 文件")))
    return read(spark, sf_dir, "orders").select("o_orderkey", text.project_number(title, body).alias("number"))


@query("""SELECT o_orderkey, o_orderkey % 5 IN (0, 1, 4) AS aborted FROM orders""")
def aborted_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _one_of("o_orderkey", "本项目因故废标", "招标失败，另行公告", "合同已签订", F.lit(None).cast("string"), "有效供应商数量不足三家")
    return read(spark, sf_dir, "orders").select("o_orderkey", classify.is_aborted(body).alias("aborted"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '预算金额' WHEN 1 THEN '时间节点' WHEN 2 THEN '联系方式' ELSE '招标公告' END AS intent FROM orders""")
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = _one_of("o_orderkey", "这个项目的预算金额是多少钱", "截止时间是何时", "怎么联系他们，电话", F.lit(None).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", extract.intent(asked).alias("intent"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '面议' WHEN p_partkey % 50 * 1000 > 10000 THEN printf('%.2f万元', p_partkey % 50 * 1000 / 10000.0) ELSE (p_partkey % 50 * 1000) || '万元' END AS budget FROM part""")
def repaired_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = F.when(F.col("p_partkey") % 5 == 0, "面议").otherwise(F.concat((F.col("p_partkey") % 50 * 1000).cast("string"), F.lit("万元")))
    return read(spark, sf_dir, "part").select("p_partkey", amounts.repair_unit(given).alias("budget"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, epoch_ms(o_orderdate) AS ms, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS back FROM orders""")
def url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("o_orderdate")
    url = F.concat(F.lit("https://x.example/"), _one_of("o_orderkey", F.date_format(at, "yyyyMMdd"), F.date_format(at, "yyyy/MM/dd"), F.lit("20249999")), F.lit("/"), F.col("o_orderkey").cast("string"))
    ms = F.unix_millis(at.cast("timestamp"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.date_format(dates.url_date(url), "yyyy-MM-dd").alias("day"), ms.alias("ms"), F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd HH:mm").alias("back"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '工程招投标' WHEN p_partkey % 3 = 1 THEN '政府采购' WHEN contains(p_name, 'blue') THEN '工程招投标' ELSE '政府采购' END AS business,
           CASE WHEN p_partkey % 3 = 0 THEN '招标公告' WHEN p_partkey % 3 = 1 THEN '废标公告' ELSE '其他' END AS info FROM part""")
def codes_in_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = _one_of("p_partkey", "https://x.example/014001/014001001/1.html", "https://x.example/014005/014005003/2.html", "https://x.example/014001001/3.html")
    title = F.replace("p_name", F.lit("blue"), F.lit("监理"))
    return read(spark, sf_dir, "part").select("p_partkey", extract.business_type(url, title).alias("business"), extract.info_type(url).alias("info"))


@query("""SELECT c_custkey, c_mktsegment, substr(sha256(c_name || 'salt'), 1, 16) AS member FROM customer""")
def public_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.col("c_name").alias("member"), F.col("c_acctbal").alias("bank_account"), F.col("c_name").alias("Contact_Phone"))
    return text.publishable(rows, digested=("member",), salt="salt")


@query("""WITH e AS (SELECT c_custkey AS place, 'N' || c_custkey % 300 AS num, c_mktsegment || c_custkey % 90 AS name FROM customer), r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'N' || o_custkey % 400 END AS num, 'BUILDING' || o_custkey % 120 AS name FROM orders),
     n AS (SELECT num, min(place) AS place FROM e GROUP BY 1), m AS (SELECT name, min(place) AS place FROM e GROUP BY 1)
    SELECT o_orderkey, least(n.place, m.place) AS place, CASE WHEN n.place IS NOT NULL AND (m.place IS NULL OR n.place <= m.place) THEN 'number' ELSE 'name' END AS match_type
    FROM r LEFT JOIN n ON n.num = r.num LEFT JOIN m ON m.name = r.name WHERE n.place IS NOT NULL OR m.place IS NOT NULL""")
def entity_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = read(spark, sf_dir, "customer", "orders")
    text_of = lambda c, k: (F.col(c) % k).cast("string")
    known = customer.select(F.col("c_custkey").alias("place"), F.concat(F.lit("N"), text_of("c_custkey", 300)).alias("k_number"), F.concat("c_mktsegment", text_of("c_custkey", 90)).alias("k_name"))
    records = orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("N"), text_of("o_custkey", 400))).alias("number"), F.concat(F.lit("BUILDING"), text_of("o_custkey", 120)).alias("name"))
    return matching.earliest_candidate(records, known, "o_orderkey", "place", [("number", "number", "k_number"), ("name", "name", "k_name")])


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN contains(p_name, 'red') THEN 'red' WHEN contains(p_name, 'bolt') THEN 'bolt' ELSE 'other' END AS kind FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'A'""")
def reclassified(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, part = read(spark, sf_dir, "lineitem", "part")
    awards = lines.where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber", "l_partkey")
    kinds = part.select("p_partkey", classify.first_label(F.col("p_name"), {"red": ("red",), "bolt": ("bolt",)}, "other").alias("kind"))
    return awards.join(kinds, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "kind")


@query("""WITH h AS (SELECT hour(ts) AS hour, avg(value) AS found FROM events GROUP BY 1), p AS (SELECT * FROM h ORDER BY found DESC, hour LIMIT 3), a AS (SELECT avg(value) AS mean FROM events),
     n AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-05 16:00:00', TIMESTAMP '2024-01-07 15:00:00', INTERVAL 1 HOUR)) AS t)
    SELECT strftime(t, '%Y-%m-%d %H') AS hour, round(coalesce(found, mean) * CASE WHEN isodow(t) > 5 THEN 0.6 ELSE 1 END * CASE WHEN hour(t) BETWEEN 9 AND 18 THEN 1 ELSE 0.3 END, 4) AS expected
    FROM n CROSS JOIN a LEFT JOIN p ON p.hour = hour(t)""")
def hours_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = read(spark, sf_dir, "events").select(F.col("ts").alias("at"), F.col("value").alias("found"))
    ahead = scheduling.forecast(history, F.expr("TIMESTAMP_NTZ'2024-01-05 16:00:00'"), 48)
    return ahead.select(F.date_format("at", "yyyy-MM-dd HH").alias("hour"), F.round("expected", 4).alias("expected"))
