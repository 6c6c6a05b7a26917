"""Notices: search, overlays, set logic, facets, cleaning of text and amounts. Documents and pages stand for notices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import amounts, dates, predicates, text
from ..operators import merge
from ..sources.tables import read, since, unify
from .registry import query


@query("""SELECT doc_id, source, lang FROM documents WHERE (contains(lower(text), 'the') OR contains(lower(text), 'licensed')) AND NOT contains(lower(text), 'idiot')""")
def search_pos_neg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(predicates.matches(F.col("text"), "the,Licensed - idiot the -")).select("doc_id", "source", "lang")


@query("""SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'and') ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40""")
def search_page_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import page

    found = read(spark, sf_dir, "documents").where(predicates.matches(F.col("text"), "and")).select("doc_id", "n_chars")
    return page(found, [F.desc("n_chars"), "doc_id"], 3, 20)


@query("""
    WITH u AS (SELECT 0 AS r, 'orders' AS source, 'k' || o_orderkey % 5000 AS url, o_totalprice AS amount, o_orderkey AS id FROM orders
               UNION ALL SELECT 1, 'events', 'k' || event_id % 5000, value, event_id FROM events)
    SELECT source, url, amount FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY r DESC, id) AS n FROM u) WHERE n = 1""")
def unify_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events = read(spark, sf_dir, "orders", "events")
    key = lambda c: F.concat(F.lit("k"), (F.col(c) % 5000).cast("string"))
    first = merge.first_rows(orders.select(key("o_orderkey").alias("url"), F.col("o_totalprice").alias("amount"), "o_orderkey"), ["url"], ["o_orderkey"])
    second = merge.first_rows(events.select(key("event_id").alias("url"), F.col("value").alias("amount"), "event_id"), ["url"], ["event_id"])
    return unify({"orders": first, "events": second}, "url").select("source", "url", "amount")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderdate::DATE::VARCHAR END AS day FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' OR o_orderkey % 10 = 0""")
def pruned_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderdate")).alias("day"))
    return since(dated, "day", F.lit("2001-01-01").cast("timestamp_ntz")).withColumn("day", F.col("day").cast("date").cast("string"))


@query("""
    SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
                   UNION ALL SELECT 'event', event_id, strftime(ts, '%Y-%m-%d') FROM events
                   UNION ALL SELECT 'line', l_orderkey * 10 + l_linenumber, strftime(l_shipdate, '%Y-%m-%d') FROM lineitem)
    ORDER BY day DESC, kind, id DESC LIMIT 100""")
def latest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, events, lines = read(spark, sf_dir, "orders", "events", "lineitem")
    day = lambda c: F.col(c).cast("date").alias("day")
    parts = [
        orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), day("o_orderdate")), events.select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), day("ts")),
        lines.select(F.lit("line").alias("kind"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), day("l_shipdate")),
    ]
    order = [F.desc("day"), F.asc("kind"), F.desc("id")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).orderBy(*order).limit(100).withColumn("day", F.col("day").cast("string"))


@query("""
    WITH d AS (SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS seen FROM events WHERE ts > TIMESTAMP '2024-01-25' ORDER BY seen DESC, event_id DESC LIMIT 201)
    SELECT * EXCLUDE (n), (SELECT count(*) FROM d) > 200 AS has_more FROM (SELECT *, row_number() OVER (ORDER BY seen DESC, event_id DESC) AS n FROM d) WHERE n <= 200""")
def delta_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").where(F.col("ts") > F.lit("2024-01-25").cast("timestamp_ntz"))
    some = events.select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("seen")).orderBy(F.desc("seen"), F.desc("event_id")).limit(201)
    # One task has the 201 rows; the last one only says that there are more.
    all_rows = Window.partitionBy(F.lit(1))
    placed = some.withColumns({"n": F.row_number().over(all_rows.orderBy(F.desc("seen"), F.desc("event_id"))), "has_more": F.count(F.lit(1)).over(all_rows) > 200})
    return placed.where("n <= 200").drop("n")


@query("""SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, 'tender_' || left(sha256(url), 16) AS id FROM pages""")
def stable_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1).alias("host"), text.stable_id(F.col("url"), F.lit("")).alias("id"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '^http://', 'https://'), '_[0-9]+(/|$)', '\\1') AS url, coalesce(len(regexp_extract_all(url, '[0-9]+')), 0) AS numbers,
          regexp_extract(url, '[?&]([^=&#]+)=', 1) AS first_parameter FROM pages""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace(F.regexp_replace("url", "^http://", "https://"), "_[0-9]+(/|$)", "$1").alias("url"),
        F.size(F.regexp_extract_all("url", F.lit("([0-9]+)"), 1)).alias("numbers"), F.regexp_extract("url", "[?&]([^=&#]+)=", 1).alias("first_parameter"))


@query("""
    SELECT d.doc_id, 'tender_' || left(sha256(d.doc_id::VARCHAR), 16) AS vector_id FROM documents d
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE 'tender_' || left(sha256(l.doc_id::VARCHAR), 16) = 'tender_' || left(sha256(d.doc_id::VARCHAR), 16))""")
def anti_missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = read(spark, sf_dir, "documents", "labels")
    key = lambda c: text.stable_id(F.col(c).cast("string"), F.lit("")).alias("vector_id")
    return documents.select("doc_id", key("doc_id")).join(labels.select(key("doc_id")), "vector_id", "left_anti")


@query("""
    SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-24' AND event_type = 'error'
    AND user_id NOT IN (SELECT user_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' AND event_type <> 'error') ORDER BY event_id LIMIT 50""")
def anti_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    done = events.where((F.col("ts") >= at("2024-01-31")) & (F.col("event_type") != "error")).select("user_id").distinct()
    missed = events.where((F.col("ts") >= at("2024-01-24")) & (F.col("event_type") == "error"))
    return missed.join(done, "user_id", "left_anti").select("event_id").orderBy("event_id").limit(50)


@query("""
    SELECT p.page_id FROM pages p WHERE EXISTS (SELECT 1 FROM pages e WHERE regexp_extract(e.url, '^[a-z]+://[^/?#]+') = regexp_extract(p.url, '^[a-z]+://[^/?#]+') AND e.page_id <> p.page_id)""")
def semi_urlkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("key"))
    other = pages.select(F.col("page_id").alias("other"), "key")
    return pages.join(other, (pages.key == other.key) & (F.col("page_id") != F.col("other")), "left_semi").select("page_id")


_WORDS = ("licensed", "tion", "worthless", "que", "der")


@query("""
    WITH k AS (SELECT unnest(['licensed', 'tion', 'worthless', 'que', 'der']) AS kw)
    SELECT doc_id, string_agg(kw, ',' ORDER BY kw) AS keywords FROM documents JOIN k ON contains(lower(text), kw) WHERE NOT contains(lower(text), 'idiot') GROUP BY doc_id""")
def theta_keyword_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    lower = F.lower("text")
    hits = F.array_sort(F.filter(F.array(*[F.when(F.contains(lower, F.lit(w)), w) for w in _WORDS]), lambda x: x.isNotNull()))
    found = read(spark, sf_dir, "documents").where(~F.contains(lower, F.lit("idiot"))).select("doc_id", hits.alias("hits"))
    return found.where(F.size("hits") > 0).select("doc_id", F.array_join("hits", ",").alias("keywords"))


@query("""
    SELECT o_orderkey, c_custkey IS NOT NULL AS is_favorite, coalesce(c_mktsegment, '') AS segment
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey""")
def left_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = read(spark, sf_dir, "orders", "customer")
    favourites = customers.where("c_acctbal > 5000").select("c_custkey", "c_mktsegment")
    joined = orders.join(favourites, orders.o_custkey == favourites.c_custkey, "left")
    return joined.select("o_orderkey", F.col("c_custkey").isNotNull().alias("is_favorite"), F.coalesce("c_mktsegment", F.lit("")).alias("segment"))


@query("""
    WITH p AS (SELECT p_partkey, p_name, p_brand FROM part), m AS (
        SELECT a.p_partkey, b.p_partkey AS favourite, CASE WHEN a.p_partkey = b.p_partkey THEN 'url' WHEN a.p_name = b.p_name THEN 'name' WHEN a.p_brand = b.p_brand AND a.p_partkey % 50 = b.p_partkey % 50 THEN 'number' END AS match_type
        FROM p a JOIN p b ON b.p_partkey <= 20 AND (a.p_name = b.p_name OR a.p_brand = b.p_brand OR a.p_partkey = b.p_partkey)), r AS (
        SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE match_type WHEN 'url' THEN 0 WHEN 'name' THEN 1 ELSE 2 END, favourite) AS n FROM m WHERE match_type IS NOT NULL)
    SELECT p_partkey, favourite, match_type FROM r WHERE n = 1""")
def prioritised_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.matching import first_match

    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name", F.concat_ws("|", "p_brand", (F.col("p_partkey") % 50).cast("string")).alias("number"))
    favourites = parts.where("p_partkey <= 20").select(F.col("p_partkey").alias("favourite"), F.col("p_name").alias("f_name"), F.col("number").alias("f_number"), F.col("p_partkey").alias("f_key"))
    return first_match(parts, favourites, "p_partkey", "favourite", [("url", "p_partkey", "f_key"), ("name", "p_name", "f_name"), ("number", "number", "f_number")])


@query("""
    SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS facet, coalesce(lang, source, '') AS value, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most
    FROM documents GROUP BY GROUPING SETS ((lang), (source), ())""")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.facets import facet_counts

    return facet_counts(read(spark, sf_dir, "documents"), ["lang", "source"], "n_chars")


@query("""SELECT sha256(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1""")
def having_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("""
    SELECT upper(regexp_replace(p_brand || ' - ' || p_type, '[ _-]', '', 'g')) AS key, count(*) AS n, string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) AS members
    FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 30""")
def dup_by_normkey(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = text.plain_number(F.concat("p_brand", F.lit(" - "), "p_type")).alias("key")
    groups = read(spark, sf_dir, "part").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("p_partkey")).alias("ids")).where("n > 1")
    return groups.orderBy(F.desc("n"), "key").limit(30).select("key", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("members"))


def _budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("p_partkey") % 5
    size = F.col("p_size").cast("string")
    budget = (
        F.when(kind == 0, F.concat(F.lit("￥"), F.format_string("%.2f", "p_retailprice"), F.lit("元"))).when(kind == 1, F.concat(F.lit("预算 "), size, F.lit("万元")))
        .when(kind == 2, F.concat(size, F.lit(",000.50元"))).when(kind == 3, "").otherwise("面议")
    )
    return read(spark, sf_dir, "part").select("p_partkey", budget.alias("budget"))


_AMOUNTS = """
    WITH b AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '￥' || printf('%.2f', p_retailprice) || '元' WHEN 1 THEN '预算 ' || p_size || '万元' WHEN 2 THEN p_size || ',000.50元' WHEN 3 THEN '' ELSE '面议' END AS budget FROM part),
    n AS (SELECT *, nullif(regexp_extract(replace(budget, ',', ''), '([0-9]+(?:\\.[0-9]+)?)', 1), '')::DOUBLE * CASE WHEN contains(budget, '万') THEN 10000 ELSE 1 END AS yuan FROM b)"""


@query(_AMOUNTS + """SELECT p_partkey, budget, round(yuan, 2) AS yuan, CASE WHEN yuan IS NULL THEN NULL WHEN yuan >= 5000000 THEN 4 WHEN yuan >= 1000000 THEN 3 WHEN yuan >= 500000 THEN 2 WHEN yuan >= 100000 THEN 1 ELSE 0 END AS bucket FROM n""")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    yuan = amounts.parse_amount(F.col("budget"))
    return _budgets(spark, sf_dir).select("p_partkey", "budget", yuan.cast("double").alias("yuan"), amounts.bucket(yuan).alias("bucket"))


@query(_AMOUNTS + """, s AS (SELECT p_partkey, yuan, regexp_replace(budget, '[^0-9.]', '', 'g') AS digits FROM n)
    SELECT p_partkey, CASE WHEN digits = '' THEN '小' WHEN digits::DOUBLE >= 5000 THEN '超大' WHEN digits::DOUBLE >= 1000 THEN '大' WHEN digits::DOUBLE >= 100 THEN '中' ELSE '小' END AS level, yuan AS largest FROM s""")
def budget_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _budgets(spark, sf_dir).select("p_partkey", amounts.level(F.col("budget")).alias("level"), amounts.largest_amount(F.col("budget")).alias("largest"))


@query(_AMOUNTS + """SELECT count(yuan) AS n, round(min(yuan), 2) AS least, round(max(yuan), 2) AS most, round(avg(yuan), 2) AS mean FROM n""")
def budget_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    yuan = amounts.parse_amount(F.col("budget")).cast("double")
    return _budgets(spark, sf_dir).select(yuan.alias("yuan")).agg(F.count("yuan").alias("n"), F.round(F.min("yuan"), 2).alias("least"), F.round(F.max("yuan"), 2).alias("most"), F.round(F.avg("yuan"), 2).alias("mean"))


@query(r"""
    WITH t AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d 10:30') WHEN 2 THEN strftime(o_orderdate, '%Y年%m月%d日') ELSE 'soon' END AS said, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN d::VARCHAR END AS day, CASE o_orderkey % 4 WHEN 1 THEN d || ' 10:30' WHEN 3 THEN NULL ELSE d::VARCHAR END AS due FROM t""")
def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    said = F.when(kind == 0, F.date_format(day, "yyyy-MM-dd")).when(kind == 1, F.date_format(day, "yyyy/MM/dd' 10:30'")).when(kind == 2, F.date_format(day, "yyyy年MM月dd日")).otherwise("soon")
    return read(spark, sf_dir, "orders").select("o_orderkey", said.alias("said")).select("o_orderkey", dates.parse_date(F.col("said")).cast("string").alias("day"), dates.deadline(F.col("said")).alias("due"))


@query(r"""WITH p AS (SELECT doc_id, regexp_replace(text || ' 138' || (10000000 + doc_id) || ' 023-' || (1000000 + doc_id), '([0-9]{3})[0-9]?[-\s]?[0-9]{3,4}([0-9]{4})', '\1****\2', 'g') AS t FROM documents)
    SELECT doc_id, regexp_replace(t, '([\p{L}\p{N}_.-])(?:[\p{L}\p{N}_.-]+([\p{L}\p{N}_.-])|[\p{L}\p{N}_.-]?)@([\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+)', '\1***\2@\3', 'g') AS masked FROM p""")
def pii_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    message = F.concat("text", F.lit(" 138"), (k + 10_000_000).cast("string"), F.lit(" 023-"), (k + 1_000_000).cast("string"))
    return read(spark, sf_dir, "documents").select("doc_id", text.mask_message(message).alias("masked"))


@query(r"""WITH l AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''>]*)["''][^>]*>(.*?)</a>', 1) AS h, regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*["'']([^"''>]*)["''][^>]*>(.*?)</a>', 2) AS t FROM pages),
    u AS (SELECT page_id, unnest(h) AS href, unnest(t) AS label, generate_subscripts(h, 1) AS i FROM l), f AS (SELECT * FROM u WHERE href <> '' QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY i) = 1)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i)::INT AS place, href, label FROM f""")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page in order, each target once with its first label."""
    rows = read(spark, sf_dir, "pages").select("page_id", F.posexplode(text.anchors(F.col("html"))).alias("at", "a"))
    return rows.select("page_id", (F.col("at") + 1).alias("place"), "a.href", "a.label")


@query("""SELECT doc_id, greatest(floor(length(text) / 4.0), 1)::INT AS tokens FROM documents""")
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


_SPACES = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(rf"""WITH p AS (SELECT page_id, url, regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
    q AS (SELECT page_id, url, trim(regexp_replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '{_SPACES}', ' ', 'g'), ' ') AS text FROM p)
    SELECT page_id, text, left(concat_ws(' | ', nullif(url, ''), nullif(left(text, 500), '')), 2000) AS for_vector FROM q""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", text.strip_markup(F.col("html")).alias("text"), text.vector_text(F.col("url"), body=text.strip_markup(F.col("html"))).alias("for_vector"))


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?。！？\n]'), lambda x: trim(x, ' ')), lambda x: length(x) >= 10) AS cut FROM documents),
    u AS (SELECT doc_id, unnest(cut) AS said, generate_subscripts(cut, 1) - 1 AS i FROM s),
    r AS (SELECT doc_id, said, i, CASE WHEN i < 3 THEN 3 - i ELSE 0 END + 2 * (contains(lower(said), 'licensed')::INT + contains(lower(said), 'copyright')::INT + contains(lower(said), 'version')::INT) + (length(said) BETWEEN 20 AND 100)::INT + regexp_matches(said, '[0-9]')::INT AS score FROM u),
    b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, i) <= 3), j AS (SELECT doc_id, string_agg(said, '. ' ORDER BY i) AS summary FROM b GROUP BY 1)
    SELECT s.doc_id, coalesce(summary, '') AS summary FROM s LEFT JOIN j ON j.doc_id = s.doc_id""")
def extract_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", text.best_sentences(F.col("text"), ("licensed", "copyright", "version")).alias("summary"))
