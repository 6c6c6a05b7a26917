"""Planning, extraction and housekeeping: the remaining operators over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, extract, text
from ..functions.predicates import filled
from ..operators import conversations, health, scheduling
from ..sources.tables import read
from .registry import query
from .timeseries import _LOG, _ROLLING, log


@query("""SELECT event_id, (props::JSON ->> 'k')::INT AS k FROM events WHERE (props::JSON ->> 'k')::INT % 2 = 0""")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k % 2 = 0")


@query("""SELECT doc_id FROM documents WHERE regexp_matches(text, '^[A-Z]') AND NOT regexp_matches(text, '[0-9]{4}') AND length(text) >= 500""")
def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(F.col("text").rlike("^[A-Z]") & ~F.col("text").rlike("[0-9]{4}") & (F.length("text") >= 500)).select("doc_id")


@query(f"""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '采购结果公告' WHEN 1 THEN '终止公告' ELSE '其他' END AS info_type,
       CASE WHEN p_partkey % 4 IN (1, 2) THEN '工程招投标' ELSE '政府采购' END AS business_type FROM part""")
def notice_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    url = F.when(k == 0, "/014005/014005004/").when(k == 1, "/014001/014001021/").when(k == 2, "/014001/014001999/").otherwise("/x/")
    return read(spark, sf_dir, "part").select("p_partkey", extract.info_type(url).alias("info_type"), extract.business_type(url, F.col("p_name")).alias("business_type"))


@query("""SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END, ''), c_name) AS shown FROM customer""")
def blank_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment"))
    return read(spark, sf_dir, "customer").select("c_custkey", filled(segment, F.col("c_name")).alias("shown"))


@query("""WITH w AS (SELECT unnest(string_split(p_type || ',' || p_name, ' ')) AS word FROM part), t AS (SELECT trim(word, ' ') AS word FROM w WHERE trim(word, ' ') NOT IN ('', 'red', 'blue'))
    SELECT word, count(*) AS n FROM t GROUP BY 1 ORDER BY n DESC, word LIMIT 12""")
def keyword_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "part").select(F.explode(F.split(F.concat_ws(",", "p_type", "p_name"), " ")).alias("word")).select(F.trim("word").alias("word"))
    return words.where(~F.col("word").isin("", "red", "blue")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "word").limit(12)


@query("""WITH w AS (SELECT doc_id, source, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents)
    SELECT word, count(*) AS frequency, count(DISTINCT source) AS sources FROM w WHERE length(word) >= 4 GROUP BY 1 ORDER BY frequency DESC, word LIMIT 50""")
def keyword_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = read(spark, sf_dir, "documents").select("source", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") >= 4)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("source").alias("sources")).orderBy(F.desc("frequency"), "word").limit(50)


@query("""WITH d AS (SELECT c_mktsegment AS category, DATE '2024-02-01' + (c_custkey % 60 - 20)::INT AS valid_to FROM customer)
    SELECT category, count(*) FILTER (WHERE valid_to < DATE '2024-02-01') AS expired, count(*) FILTER (WHERE valid_to BETWEEN DATE '2024-02-01' AND DATE '2024-02-08') AS week,
           count(*) FILTER (WHERE valid_to BETWEEN DATE '2024-02-01' AND DATE '2024-03-02') AS month FROM d GROUP BY 1""")
def expiry_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    today = F.lit("2024-02-01").cast("date")
    rows = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("category"), F.date_add(today, (F.col("c_custkey") % 60 - 20).cast("int")).alias("valid_to"))
    left = F.datediff("valid_to", today)
    return rows.groupBy("category").agg(F.count_if(left < 0).alias("expired"), F.count_if(left.between(0, 7)).alias("week"), F.count_if(left.between(0, 30)).alias("month"))


@query("""WITH q AS (SELECT doc_id, least(100, n_chars / 50.0) AS score FROM documents)
    SELECT CASE WHEN score >= 80 THEN 'A' WHEN score >= 60 THEN 'B' WHEN score >= 40 THEN 'C' ELSE 'D' END AS grade, count(*) AS n, round(avg(score) + 1e-9, 4) AS mean FROM q GROUP BY 1""")
def quality_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "documents").select(F.least(F.lit(100.0), F.col("n_chars") / 50.0).alias("score"))
    return scored.groupBy(classify.grade(F.col("score")).alias("grade")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score") + 1e-9, 4).alias("mean"))


@query("""SELECT event_id, strftime(ts + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local, epoch_us(ts) // 1000 AS ms, strftime(date_trunc('week', ts + INTERVAL 8 HOUR), '%Y-%m-%d') AS monday FROM events""")
def local_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    local = F.from_utc_timestamp(at, "Asia/Shanghai")
    return read(spark, sf_dir, "events").select("event_id", F.date_format(local, "yyyy-MM-dd HH:mm:ss").alias("local"), F.unix_millis(at).alias("ms"), F.date_format(F.date_trunc("week", local), "yyyy-MM-dd").alias("monday"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate::DATE BETWEEN DATE '2001-07-01' AND DATE '2001-07-08' AND o_orderstatus <> 'F'""")
def due_soon(spark: SparkSession, sf_dir: str) -> DataFrame:
    today, day = F.lit("2001-07-01").cast("date"), F.col("o_orderdate").cast("date")
    return read(spark, sf_dir, "orders").where(day.between(today, F.date_add(today, 7)) & (F.col("o_orderstatus") != "F")).select("o_orderkey")


@query("""WITH s AS (SELECT user_id AS source, avg(value) * 100 AS ms, avg((event_type <> 'error')::INT) AS rate, count(*) AS asked FROM events GROUP BY 1),
    t AS (SELECT s.*, CASE WHEN source % 3 = 0 THEN (source % 200)::DOUBLE END AS hours, CASE WHEN source % 3 = 1 THEN (source % 10)::DOUBLE END AS days FROM s),
    f AS (SELECT source, CASE WHEN hours IS NOT NULL THEN CASE WHEN hours <= 0 THEN 1 WHEN hours > 168 THEN 0.3 ELSE exp(-hours / 48) END WHEN days IS NOT NULL THEN CASE WHEN days > 7 THEN 0.2 ELSE 1 - 0.8 * days / 7 END ELSE 0.3 END AS t,
          greatest(0, least(1, (10000 - ms) / 9500)) AS r, greatest(0, least(1, (30000 - 2 * ms) / 29500)) AS c, rate, least(1, asked / 100.0) AS d FROM t)
    SELECT source, round(0.3 * t + 0.2 * r + 0.15 * c + 0.2 * rate + 0.15 * d, 6) AS priority FROM f""")
def task_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = log(spark, sf_dir).groupBy("source").agg((F.avg("response") * 100).alias("ms"), F.avg(F.col("ok").cast("double")).alias("rate"), F.count(F.lit(1)).alias("asked"))
    s = F.col("source")
    hours, days = F.when(s % 3 == 0, (s % 200).cast("double")), F.when(s % 3 == 1, (s % 10).cast("double"))
    factors = {"timeliness": scheduling.timeliness(hours, days), "reliability": scheduling.reliability(F.col("ms")), "cost": scheduling.cheapness(F.col("ms") * 2), "success": F.col("rate"), "demand": F.least(F.lit(1.0), F.col("asked") / 100.0)}
    return stats.select("source", F.round(scheduling.priority(factors), 6).alias("priority"))


@query(_ROLLING + """ SELECT source, CASE WHEN failures >= 3 THEN 'backoff' WHEN rate_long >= 0.95 THEN 'fast' WHEN rate_long >= 0.8 THEN 'normal' WHEN rate_long >= 0.5 THEN 'slow' ELSE 'careful' END AS mode,
       CASE WHEN failures >= 3 THEN 3600 WHEN rate_long >= 0.95 THEN 300 WHEN rate_long >= 0.8 THEN 600 WHEN rate_long >= 0.5 THEN 1200 ELSE 1800 END AS seconds,
       round(greatest(0.5, least(60, mean_response * (1 + coalesce(deviation / nullif(mean_response, 0), 0)) * CASE WHEN 1 - rate_short > 0.1 THEN 1 + 5 * (1 - rate_short) ELSE 1 END)), 6) AS pause FROM r WHERE place = 1""")
def collection_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = health.latest(log(spark, sf_dir), ["us", "event_id"])
    tier = scheduling.interval_tier(F.col("rate_long"), F.col("failures"))
    pause = health.adaptive_interval(F.col("mean_response"), F.col("variation"), 1 - F.col("rate_short"))
    return last.select("source", tier["mode"].alias("mode"), tier["seconds"].alias("seconds"), F.round(pause, 6).alias("pause"))


@query(f"""WITH {_LOG}, h AS (SELECT hour(ts)::INT AS hour, avg(response) AS found, avg(ok::INT) AS rate FROM log GROUP BY 1), t AS (SELECT *, lag(found) OVER (ORDER BY hour) AS before FROM h),
    d AS (SELECT *, CASE WHEN found > 1.05 * before THEN 'rising' WHEN found < 0.95 * before THEN 'falling' ELSE 'stable' END AS trend FROM t)
    SELECT hour, CASE WHEN rate < 0.5 THEN 'scale_down' WHEN trend = 'rising' AND found > 49 THEN 'scale_up' WHEN hour BETWEEN 9 AND 18 AND found > 49 THEN 'scale_up' WHEN trend = 'falling' AND found < 51 AND NOT hour BETWEEN 9 AND 18 THEN 'scale_down' ELSE 'maintain' END AS action FROM d""")
def worker_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = log(spark, sf_dir).groupBy(F.hour("ts").alias("hour")).agg(F.avg("response").alias("found"), F.avg(F.col("ok").cast("double")).alias("rate"))
    before = F.lag("found").over(Window.orderBy("hour"))  # 24 rows
    trend = F.when(F.col("found") > 1.05 * F.col("before"), "rising").when(F.col("found") < 0.95 * F.col("before"), "falling").otherwise("stable")
    return hours.withColumn("before", before).select("hour", scheduling.scaling(F.col("found"), F.col("rate"), trend, F.lit(False), F.col("hour"), 49, 51).alias("action"))


@query("""WITH l AS (SELECT user_id, max(epoch_us(ts)) AS last FROM events GROUP BY 1) SELECT user_id, last, epoch_us(TIMESTAMP '2024-01-31') - last AS age_s FROM l WHERE epoch_us(TIMESTAMP '2024-01-31') - last > 3600000000""")
def stale_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.unix_micros(F.lit("2024-01-31").cast("timestamp"))
    rows = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return scheduling.stale(rows, "user_id", "us", now, 3_600_000_000)


@query("""WITH t AS (SELECT 'u' || event_id % 700 AS url, value, event_id FROM events), b AS (SELECT url, max(value) AS value FROM t GROUP BY 1) SELECT * FROM b ORDER BY value DESC, url LIMIT 100""")
def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("event_id") % 700).cast("string")).alias("url"), "value")
    return scheduling.queue(tasks, "url", "value", 100)


@query("""WITH q AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '建筑' WHEN 1 THEN 'IT' ELSE '' END AS category, CASE s_suppkey % 4 WHEN 0 THEN '一级' WHEN 1 THEN '' ELSE '二级' END AS level, CASE WHEN s_suppkey % 11 = 0 THEN '过期' ELSE '有效' END AS status FROM supplier),
    s AS (SELECT s_suppkey, CASE WHEN status = '过期' THEN 10 ELSE CASE WHEN category = '建筑' THEN 50 ELSE 0 END + CASE WHEN level = '一级' THEN 30 ELSE 0 END END AS score FROM q)
    SELECT s_suppkey, score, CASE WHEN score >= 80 THEN 'full' WHEN score >= 40 THEN 'partial' ELSE 'none' END AS class FROM s""")
def qualification_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    category, level = F.when(k % 3 == 0, "建筑").when(k % 3 == 1, "IT").otherwise(""), F.when(k % 4 == 0, "一级").when(k % 4 == 1, "").otherwise("二级")
    score = extract.qualification_score(F.lit("建筑"), F.lit("一级"), category, level, F.lit(False), F.when(k % 11 == 0, "过期").otherwise("有效"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", score.alias("score"), extract.match_class(score).alias("class"))


@query("""WITH d AS (SELECT doc_id, list_distinct(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM documents)
    SELECT doc_id, round(len(list_intersect(w, ['the', 'and', 'idiot', 'with'])) / 4.0, 6) AS share FROM d WHERE len(list_intersect(w, ['the', 'and', 'idiot', 'with'])) >= 2""")
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*[F.lit(w) for w in ("the", "and", "idiot", "with")])
    share = F.size(F.array_intersect(F.split(F.lower("text"), " "), wanted)) / 4.0
    return read(spark, sf_dir, "documents").select("doc_id", F.round(share, 6).alias("share")).where("share >= 0.5")


@query("""WITH a AS (SELECT o_orderkey, '包号：1\n供应商名称：' || c_name || '有限公司\n中标（成交）金额：' || printf('%.2f', o_totalprice) || '元\n' AS t, c_name || '有限公司' AS winner, round(o_totalprice, 2) AS amount FROM orders JOIN customer ON o_custkey = c_custkey)
    SELECT o_orderkey, '1' AS package_no, winner, amount FROM a""")
def award_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders", "customer")
    notices = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        "o_orderkey", F.concat(F.lit("包号：1\n供应商名称："), "c_name", F.lit("有限公司\n中标（成交）金额："), F.format_string("%.2f", "o_totalprice"), F.lit("元\n")).alias("t"))
    found = notices.select("o_orderkey", F.explode(extract.package_awards(F.col("t"))).alias("x"))
    return found.select("o_orderkey", "x.package_no", "x.winner", F.col("x.amount").cast("double").alias("amount"))


@query("""SELECT doc_id, CASE WHEN instr(text, 'Licensed') > 0 THEN substr(text, greatest(instr(text, 'Licensed') - 20, 1), 80) ELSE '' END AS around FROM documents""")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", extract.snippet(F.col("text"), "Licensed").alias("around"))


@query("""SELECT conv_id, turn, sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM (SELECT conv_id, turn, greatest(floor(length(text) / 4.0), 1) AS tokens FROM conversations)""")
def turn_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", text.token_estimate(F.col("text")).cast("bigint").alias("tokens"))
    return conversations.used_so_far(turns, "conv_id", ["turn"], "tokens").select("conv_id", "turn", "used")


@query("""SELECT o.o_orderkey, coalesce(c.c_mktsegment, 'none') AS segment FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_orderkey % 2 = 0""")
def update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders", "customer")
    joined = orders.join(customers, (orders.o_custkey == customers.c_custkey) & (orders.o_orderkey % 2 == 0), "left")
    return joined.select("o_orderkey", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("""SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01')""")
def expire_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = (F.col("o_orderstatus") == "F") & (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return read(spark, sf_dir, "orders").where(~old).select("o_orderkey")
