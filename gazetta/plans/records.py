"""Records in bulk: filters of collection, entity keys, quarantine, status, fallback search, framed output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.extract import LEVELS
from ..functions.predicates import any_of, listable, matches, worth_notice
from ..operators import blocks, matching, merge, scheduling
from ..sources.tables import read
from .registry import query


@query("""SELECT o_orderkey FROM orders WHERE o_orderpriority <> '5-LOW' AND length(o_orderpriority) >= 5 AND NOT contains(o_orderpriority, 'HIGH') AND o_custkey % 4 IN (0, 1)""")
def record_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_custkey") % 4
    code = F.when(k == 0, "014001001").when(k == 1, "014005001002").when(k == 2, "014001002").when(k == 3, None)
    return read(spark, sf_dir, "orders").where(listable(F.col("o_orderpriority"), code, ("LOW", "HIGH"), ("014001001", "014005001", "014001002"), ("014001002",))).select("o_orderkey")


@query("""SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_custkey % 5 = 0 OR c_acctbal >= 1000)""")
def worth_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    budget = F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal"))
    return read(spark, sf_dir, "customer").where(worth_notice(F.col("c_mktsegment"), budget, ("Build", "machine"), 1000.0)).select("c_custkey")


@query("""SELECT p_partkey, list_filter(['red', 'blue', 'steel'], lambda w: contains(lower(p_name), w)) AS found FROM part
    WHERE NOT contains(lower(p_name), 'green') AND len(list_filter(['red', 'blue', 'steel'], lambda w: contains(lower(p_name), w))) > 0""")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.lower("p_name")
    found = F.filter(F.array(*map(F.lit, ("red", "blue", "steel"))), lambda w: F.contains(name, w))
    return read(spark, sf_dir, "part").where(~any_of([F.contains(name, F.lit("green"))])).select("p_partkey", found.alias("found")).where(F.size("found") > 0)


@query("""SELECT o_orderkey, key, total FROM (SELECT o_orderkey, o_totalprice AS total, CASE WHEN o_custkey % 3 = 0 THEN 'name:' || o_orderpriority ELSE 'no:' || o_custkey END AS key FROM orders)
    QUALIFY row_number() OVER (PARTITION BY key ORDER BY o_orderkey DESC) = 1""")
def dimension_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.when(F.col("o_custkey") % 6 == 0, "").when(F.col("o_custkey") % 3 != 0, F.col("o_custkey").cast("string"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", merge.entity_key(number, F.col("o_orderpriority")).alias("key"), F.col("o_totalprice").alias("total"))
    return merge.latest_of(rows, F.col("key"), [F.desc("o_orderkey")])


@query("""SELECT o_orderkey, o_orderkey % 2 = 1 AS is_new FROM orders WHERE o_orderkey % 2 = 1 OR o_orderkey % 3 = 0""")
def upsert_is_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["o_orderkey", "o_orderstatus"]
    stored, incoming = read(spark, sf_dir, "orders").where("o_orderkey % 2 = 0").select(*columns), read(spark, sf_dir, "orders").where("o_orderkey % 2 = 1 OR o_orderkey % 3 = 0").select(*columns)
    merged = merge.upsert(stored, incoming, "o_orderkey", {"o_orderstatus": "keep_if_blank"})
    return merged.where("action <> 'kept'").select("o_orderkey", (F.col("action") == "inserted").alias("is_new"))


@query("""SELECT CASE WHEN o_orderkey % 10 = 0 THEN 'no customer' WHEN o_totalprice < 1000 THEN 'amount' END AS reason, count(*) AS n FROM orders GROUP BY 1""")
def quarantined_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.when(F.col("o_orderkey") % 10 != 0, F.col("o_custkey")).alias("customer"), "o_totalprice")
    checked = merge.quarantine(rows, {"no customer": F.col("customer") >= 0, "amount": F.col("o_totalprice") >= 1000})
    return checked.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH f AS (SELECT c_custkey AS fav, c_custkey % 400 AS url, c_mktsegment || c_custkey % 50 AS name, c_custkey % 4 = 0 AS archived FROM customer),
     u AS (SELECT url, arg_min(fav, archived::INT * 1000000 + fav) AS fav FROM f GROUP BY 1), m AS (SELECT name, arg_min(fav, archived::INT * 1000000 + fav) AS fav FROM f GROUP BY 1)
    SELECT o_orderkey, coalesce(u.fav, m.fav) AS fav, CASE WHEN u.fav IS NOT NULL THEN 'url' ELSE 'name' END AS match_type FROM orders LEFT JOIN u ON u.url = o_orderkey % 1000
    LEFT JOIN m ON m.name = 'BUILDING' || o_custkey % 60 WHERE coalesce(u.fav, m.fav) IS NOT NULL""")
def favourite_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = read(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + F.when(F.col("c_custkey") % 4 == 0, 1_000_000).otherwise(0)).alias("place"), (F.col("c_custkey") % 400).alias("f_url"), F.concat("c_mktsegment", (F.col("c_custkey") % 50).cast("string")).alias("f_name"))
    records = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 1000).alias("url"), F.concat(F.lit("BUILDING"), (F.col("o_custkey") % 60).cast("string")).alias("name"))
    best = matching.first_match(records, known, "o_orderkey", "place", [("url", "url", "f_url"), ("name", "name", "f_name")])
    fav = F.when(F.col("place") % 4 == 0, F.col("place") - 1_000_000).otherwise(F.col("place"))
    return best.select("o_orderkey", fav.alias("fav"), "match_type")


@query("""SELECT doc_id FROM documents WHERE contains(lower(text), 'licensed')""")
def fallback_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return matching.first_that_finds(
        lambda: docs.where(F.col("doc_id") < 0).select("doc_id"), lambda: docs.where(matches(F.col("text"), "no-such-word-anywhere")).select("doc_id"), lambda: docs.where(matches(F.col("text"), "licensed")).select("doc_id"))


@query("""SELECT event_type, round(avg(epoch_us(later) - epoch_us(ts)) / 1000.0, 3) AS latency_ms FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS later FROM events) WHERE later > ts GROUP BY 1""")
def latency_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    rows = blocks.blocked(blocks.numbered(events, "user_id", ["us", "event_id"]), 1)
    by = Window.partitionBy("user_id", "block").orderBy("n")
    gaps = rows.select("own", F.lag("event_type").over(by).alias("event_type"), (F.col("us") - F.lag("us").over(by)).alias("gap"))
    return gaps.where("own AND gap > 0").groupBy("event_type").agg(F.round(F.avg("gap") / 1000.0, 3).alias("latency_ms"))


@query(r"""SELECT page_id, regexp_replace(replace(url, 'http://', 'https://'), '(/[a-z]{2}/[0-9]+)\?.*$', '\1') AS url FROM pages""")
def url_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.replace("url", F.lit("http://"), F.lit("https://")), r"(/[a-z]{2}/[0-9]+)\?.*$", "$1").alias("url"))


@query("""WITH a AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS seen FROM orders ORDER BY seen DESC, id LIMIT 500), b AS (SELECT 'event' AS kind, event_id AS id, ts AS seen FROM events ORDER BY seen DESC, id LIMIT 500)
    SELECT kind, id FROM (SELECT * FROM a UNION ALL SELECT * FROM b) ORDER BY seen DESC, kind, id LIMIT 100 OFFSET 450""")
def two_table_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = read(spark, sf_dir, "orders", "events")
    top = lambda df, kind, id_, at: df.select(F.lit(kind).alias("kind"), F.col(id_).alias("id"), F.col(at).alias("at")).orderBy(F.desc("at"), "id").limit(500)
    return top(orders, "order", "o_orderkey", "o_orderdate").unionByName(top(events, "event", "event_id", "ts")).orderBy(F.desc("at"), "kind", "id").offset(450).limit(100).select("kind", "id")


@query("""SELECT count(*) AS tasks, coalesce(sum(value) FILTER (WHERE event_type = 'no such type'), 0) AS none, count(*) FILTER (WHERE event_type = 'error') AS failed, round(coalesce(sum(value), 0), 4) AS total FROM events""")
def task_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return read(spark, sf_dir, "events").agg(F.count(F.lit(1)).alias("tasks"), zero(F.when(F.col("event_type") == "no such type", F.col("value"))).alias("none"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(zero(F.col("value")), 4).alias("total"))


@query("""WITH n AS (SELECT o_orderkey, unnest(CASE o_orderkey % 3 WHEN 0 THEN ['一级', '甲级'] WHEN 1 THEN ['二级'] ELSE ['三级', '特级', '丙级'] END) AS wanted FROM orders), h AS (SELECT * FROM (VALUES ('一级'), ('二级'), ('特级')) t(held))
    SELECT o_orderkey, round(100.0 * count(held) / count(*), 1) AS coverage, coalesce(string_agg(wanted, ',' ORDER BY wanted) FILTER (WHERE held IS NULL), '') AS missing FROM n LEFT JOIN h ON wanted = held GROUP BY 1""")
def qualification_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    text = F.when(k == 0, "须具备壹级资质或甲级资质").when(k == 1, "贰级以上").otherwise("叁级、特级、丙级")
    wanted = F.array_compact(F.array(*[F.when(any_of([F.contains(text, F.lit(w)) for w in words]), name) for name, words in LEVELS.items()]))
    held = spark.createDataFrame([("一级",), ("二级",), ("特级",)], "held string")
    rows = read(spark, sf_dir, "orders").select("o_orderkey", F.explode(wanted).alias("wanted")).join(held, F.col("wanted") == F.col("held"), "left")
    return rows.groupBy("o_orderkey").agg(
        F.round(100.0 * F.count("held") / F.count(F.lit(1)), 1).alias("coverage"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("held").isNull(), F.col("wanted")))), ",").alias("missing"))


@query("""WITH t AS (SELECT event_id, user_id % 10 / 10.0 AS score, CASE event_id % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS risk, event_id % 11 / 10.0 AS ban FROM events)
    SELECT event_id, round(score * CASE risk WHEN 'low' THEN 1.0 WHEN 'medium' THEN 0.8 WHEN 'high' THEN 0.5 ELSE 0.1 END, 6) AS score,
           CASE WHEN risk = 'critical' THEN 'critical' WHEN risk = 'high' AND score < 0.5 THEN 'high' WHEN ban > 0.7 THEN 'ban' END AS deferred FROM t""")
def deferred_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10 / 10.0).alias("s"), risk.alias("risk"), (F.col("event_id") % 11 / 10.0).alias("ban"))
    return rows.select("event_id", F.round(scheduling.discounted(F.col("s"), F.col("risk")), 6).alias("score"), scheduling.deferred(F.col("s"), F.col("risk"), F.col("ban")).alias("deferred"))


@query("""WITH r AS (SELECT o_orderpriority AS kind, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS n, count(*) OVER (PARTITION BY o_orderpriority) AS c FROM orders)
    SELECT kind, '## ' || kind || ' (' || any_value(c) || ')' || chr(10) || string_agg('- ' || o_orderkey, chr(10) ORDER BY n) AS section FROM r WHERE n <= 3 GROUP BY kind""")
def summary_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.array_sort(F.collect_list(F.struct((-F.col("o_totalprice")).alias("rank"), "o_orderkey")))
    place = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    orders = read(spark, sf_dir, "orders")
    counts = orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    top = orders.withColumn("_place", place).where("_place <= 3").groupBy("o_orderpriority").agg(best.alias("best")).join(counts, "o_orderpriority")
    lines = F.array_join(F.transform("best", lambda x: F.concat(F.lit("- "), x["o_orderkey"].cast("string"))), "\n")
    return top.select(F.col("o_orderpriority").alias("kind"), F.concat(F.lit("## "), F.col("o_orderpriority"), F.lit(" ("), F.col("n").cast("string"), F.lit(")\n"), lines).alias("section"))


@query("""SELECT 0 AS part, '{"type":"header","total":' || count(*) || '}' AS record, 1 AS n FROM nation UNION ALL SELECT 1, '{"id":' || n_nationkey || ',"name":"' || n_name || '"}', 1 FROM nation UNION ALL SELECT 2, '{"type":"end"}', 1""")
def framed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = read(spark, sf_dir, "nation")
    head = nation.agg(F.to_json(F.struct(F.lit("header").alias("type"), F.count(F.lit(1)).alias("total"))).alias("record")).select(F.lit(0).alias("part"), "record")
    body = nation.select(F.lit(1).alias("part"), F.to_json(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))).alias("record"))
    tail = spark.range(1).select(F.lit(2).alias("part"), F.lit('{"type":"end"}').alias("record"))
    return head.unionByName(body).unionByName(tail).withColumn("n", F.lit(1))


@query("""SELECT c_custkey, c_name FROM customer WHERE c_custkey = 77""")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "customer").where("c_custkey = 77").select("c_custkey", "c_name")
