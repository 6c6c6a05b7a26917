"""Text of collected notices: cleaning, previews, overviews, fields, JSON sources. Texts are composed from the test tables, so
that the oracle knows the parts they were made of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import award_text, certificates, notice_text, overview
from ..functions.text import strip_markup
from ..sources import html_pages, json_pages
from ..sources.tables import dealt, once, read
from ..streaming import collectors, flows
from .registry import query


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format(F.date_add(F.to_date("o_orderdate"), 20), "yyyy-MM-dd").alias("due"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' ELSE p_name || ' 正文' END AS text, p_partkey % 3 = 0 OR length(p_name || ' 正文') < 30 AS is_empty FROM part""")
def clean_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    page = F.when(k == 0, "APP下载 首页 我要打印 关闭").when(k == 1, F.concat(F.lit("【】【 】 "), name, F.lit(" 打印 正文　\n技术支持：某公司"))).otherwise(F.concat(F.lit("字号：小 中 大 "), name, F.lit("  正文 版权所有 某中心")))
    return read(spark, sf_dir, "part").select("p_partkey", notice_text.clean_text(page).alias("text"), notice_text.is_empty_page(page).alias("is_empty"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '附件: a' || o_orderkey || '.pdf' WHEN 1 THEN '正文 ' || o_custkey
       WHEN 2 THEN '正文 项目(' || o_custkey || ')+' ELSE left(repeat('项目文', 200), 500) || '...' END AS preview FROM orders""")
def content_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    title = F.concat(F.lit("项目("), F.col("o_custkey").cast("string"), F.lit(")+"))
    body = (
        F.when(k == 0, F.concat(title, F.lit(" 版权所有 a"), F.col("o_orderkey").cast("string"), F.lit(".pdf"))).when(k == 1, F.concat(title, F.lit("\n"), title, F.lit(" 正文 "), F.col("o_custkey").cast("string")))
        .when(k == 2, F.concat(F.lit("正文 "), title)).otherwise(F.concat(title, F.lit(" "), F.repeat(F.lit("项目文"), 200)))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", notice_text.preview(body, title).alias("preview"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 AND o_orderdate >= TIMESTAMP '2000-01-01' THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def publish_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, join = F.col("o_orderkey") % 4, lambda *parts: F.concat(*[F.lit(p) if p not in ("day", "due") else F.col(p) for p in parts])
    text = (
        F.when(k == 0, join("递交截止时间：", "due", "，公告日期：", "day")).when(k == 1, join("获取文件期限：", "day", " 至 ", "due", "。其他内容"))
        .when(k == 2, join("开标时间：", "due", " 14:00，地点在本市公共资源交易中心三楼大厅，另见 ", "day")).otherwise(join("开标时间：", "due", " 14:00"))
    )
    return _orders(spark, sf_dir).select("o_orderkey", F.date_format(notice_text.publish_date(text), "yyyy-MM-dd").alias("day"))


@query(r"""SELECT page_id, (page_id % 4 + 1) * len(regexp_extract_all(html, '<div class="ad">')) AS n, regexp_extract(html, '<div class="ad">([^<]*)</div>', 1) AS said FROM pages WHERE contains(html, '<div class="ad">')""")
def page_ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advertisements of pages that stand one to four times behind each other: how many, and the text of the last."""
    pages = read(spark, sf_dir, "pages").select("page_id", html_pages.tree(F.expr("repeat(html, cast(page_id % 4 + 1 as int))")).alias("t"))
    ads = pages.select("page_id", "t", html_pages.select(F.col("t"), "div", "ad").alias("ads")).where(F.size("ads") > 0)
    return ads.select("page_id", F.size("ads").cast("bigint").alias("n"), html_pages.said(F.col("t"), F.element_at("ads", -1)).alias("said"))


@query(r"""WITH e AS (SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?s)<(script|style)>.*?</(script|style)>|<!--.*?-->', '', 'g'), '<([a-z0-9]+)[^>]*>', 1)) AS tag FROM pages)
    SELECT page_id, tag, count(*) AS n FROM e WHERE tag NOT IN ('script', 'style') GROUP BY ALL""")
def page_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of whole pages by tag."""
    pages = read(spark, sf_dir, "pages").select("page_id", F.explode(html_pages.tree("html")["nodes"]).alias("n"))
    return pages.where(~F.col("n.tag").isin("script", "style")).groupBy("page_id", F.col("n.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n"))


@query(r"""WITH p AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS origin, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS hrefs, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS titles FROM pages),
    l AS (SELECT page_id, origin, unnest(hrefs) AS href, unnest(titles) AS title, generate_subscripts(hrefs, 1) AS place FROM p),
    f AS (SELECT * FROM l WHERE length(title) > 3 AND (contains(title, 'th') OR contains(lower(href), 'en')) AND NOT contains(lower(href), 'ion') QUALIFY row_number() OVER (PARTITION BY page_id, href ORDER BY place) = 1)
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY place) AS place, title, origin || href AS url FROM f""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages that words of their titles or targets recommend, in order, each target once."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html_pages.tree("html").alias("t"))
    found = html_pages.keyword_links(F.col("t"), F.col("url"), ("th",), ("en",), ("ion",), least=3)
    return pages.select("page_id", F.posexplode(found).alias("at", "x")).select("page_id", (F.col("at") + 1).cast("bigint").alias("place"), "x.title", "x.url")


@query("""SELECT o_orderkey // 40 AS page, '项目' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 1 THEN '/a/' || strftime(o_orderdate, '%Y%m%d') || '/' || o_orderkey || '.html' ELSE '/doc?id=' || o_orderkey || '&x=1' END AS href,
       CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders WHERE o_orderkey % 7 <> 0""")
def notice_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """List pages of notices, composed with entities, separators and tags left open, read back as rows."""
    k, key = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    day = F.to_date("o_orderdate")
    href = F.when(k == 1, F.concat(F.lit("/a/"), F.date_format(day, "yyyyMMdd"), F.lit("/"), key, F.lit(".html"))).otherwise(F.concat(F.lit("/doc?id="), key, F.lit("&amp;x=1")))
    shown = F.when(k == 0, F.concat(F.lit('<span class="date">'), F.date_format(day, "yyyy-MM-dd"), F.lit("</span>"))).when(k == 1, '<span class="date">近日</span>').otherwise("<span>无")
    entry = F.concat(F.when(F.col("o_orderkey") % 7 == 0, '<li class="line">').otherwise("<li>"), F.lit('<i><a title="a>b" href="'), href, F.lit('"> 项目<b>'), key, F.lit("</b></a>"), shown, F.lit("</li>"))
    rows = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 40).alias("page"), "o_orderkey", entry.alias("entry"))
    pages = rows.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "entry"))), lambda x: x["entry"]), "\n").alias("entries"))
    html = F.concat(F.lit('<div><ul><li><a href="/">首页</a></li></ul></p><ul class="ul-news">'), "entries", F.lit("</ul></div><footer>"))
    found = pages.select("page", html_pages.tree(html).alias("t")).select("page", F.explode(html_pages.list_rows(F.col("t"), "ul-news")).alias("x"))
    return found.select("page", "x.title", "x.href", F.date_format("x.day", "yyyy-MM-dd").alias("day"))


@query("""SELECT p_partkey, '项目名称：' || p_name || ' 内容' AS text FROM part""")
def site_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.concat(F.lit("APP下载 用户手册 .preview-wrap h4{color: red} 注册 登录 项目名称："), F.col("p_name"), F.lit("  内容\n请点击这里查看"))
    inner = F.concat(F.lit('<div class="app-detail x"><p>'), page, F.lit("</p><div>请到原网址</div></div><div>页脚</div>"))
    return read(spark, sf_dir, "part").select("p_partkey", notice_text.site_text(F.when(F.col("p_partkey") % 2 == 0, page).otherwise(strip_markup(inner))).alias("text")).withColumn("text", F.regexp_replace("text", " (?:页脚|$)", ""))


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '📌 投标截止时间：' || strftime(o_orderdate::DATE + 20, '%Y-%m-%d') || chr(10) || '💰 最高限价：' || o_custkey || '万元'
       WHEN 1 THEN '🏢 客户' || o_custkey || '公司' || chr(10) || '💵 ' || o_orderkey || '元' ELSE '关于' || o_orderkey || '的更正说明' END AS overview FROM orders""")
def notice_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, said = F.col("o_orderkey") % 3, lambda c: F.col(c).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("投标截止："), F.col("due"))).when(k == 1, F.concat(F.lit("中标人：客户"), said("o_custkey"), F.lit("公司\n中标金额："), said("o_orderkey"), F.lit("元")))
        .otherwise(F.concat(F.lit("无\n关于"), said("o_orderkey"), F.lit("的更正说明\n其他说明内容")))
    )
    kind = F.when(k == 0, "采购公告").when(k == 1, "中标结果公示").otherwise("答疑变更")
    return _orders(spark, sf_dir).select("o_orderkey", overview.overview(kind, F.lit(None).cast("string"), F.when(k == 0, F.concat(said("o_custkey"), F.lit("万元"))), F.lit(None).cast("string"), text).alias("overview"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '营业执照' ELSE '建造师' END AS certificate_type, CASE WHEN c_custkey % 2 = 0 THEN c_name || '公司' ELSE '李四' END AS name,
       CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE 'A-' || (100000 + c_custkey) END AS certificate_no, '2030-0' || (1 + c_custkey % 9) || '-05' AS valid_to FROM customer""")
def certificate_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    even, month = F.col("c_custkey") % 2 == 0, (1 + F.col("c_custkey") % 9).cast("string")
    firm = F.concat(F.lit("营业执照\n企业名称："), F.col("c_name"), F.lit("公司\n法定代表人：张三\n有效期：2020年1月2日至2030年"), month, F.lit("月5日"))
    person = F.concat(F.lit("姓名：李四\n一级建造师\n注册编号：A-"), (100000 + F.col("c_custkey")).cast("string"), F.lit("\n有效期至2030-"), month, F.lit("-05"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", certificates.fields(F.when(even, firm).otherwise(person)).alias("f"))
    return rows.select("c_custkey", *[F.col(f"f.{n}") for n in ("certificate_type", "name", "certificate_no", "valid_to")])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 5 AS k, '客户' || o_custkey || '公司' AS who FROM orders)
    SELECT o_orderkey, 1 AS rank, who AS winner, CASE k WHEN 2 THEN 10000 * o_custkey WHEN 4 THEN NULL ELSE o_custkey END::DOUBLE AS amount, CASE WHEN k = 0 THEN 98.5 END::DOUBLE AS score FROM o WHERE k <> 3
    UNION ALL SELECT o_orderkey, 2, '乙公司', 7::DOUBLE, 90::DOUBLE FROM o WHERE k = 0 UNION ALL SELECT o_orderkey, 12, '丁公司', 5::DOUBLE, 88.25::DOUBLE FROM o WHERE k = 0
    UNION ALL SELECT o_orderkey, 1, '丙公司', o_custkey::DOUBLE, NULL FROM o WHERE k = 1
    UNION ALL SELECT o_orderkey, r, who || r || '厂', CASE WHEN r % 4 > 0 THEN 10000 * (o_custkey + r) END::DOUBLE, CASE WHEN r % 3 > 0 THEN 100 - r * 1.5 END::DOUBLE FROM o, range(1, 11) AS t(r) WHERE k = 3
    UNION ALL SELECT o_orderkey, 1, '戊公司', NULL, NULL FROM o WHERE k = 4""")
def award_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, said = F.col("o_orderkey") % 5, F.col("o_custkey").cast("string")
    who = F.concat(F.lit("客户"), said, F.lit("公司"))
    ten = []
    for r, word in enumerate("一二三四五六七八九十", 1):
        price = [F.lit("\n投标报价："), (F.col("o_custkey") + r).cast("string"), F.lit("万元（含税）")] if r % 4 else []
        ten += [F.lit(f"\n第{word}中标候选人（名称）："), who, F.lit(f"{r}厂\n地址：某路{r}号"), *price, F.lit(f"\n评审得分：{100 - r * 1.5}" if r % 3 else "\n无")]
    text = (
        F.when(k == 0, F.concat(F.lit("第一名 "), who, F.lit(" "), said, F.lit(" 12 98.5\n第2名 乙公司 7 3 90\n第十二中标候选人：丁公司 投标报价：5元 评审得分：88.25")))
        .when(k == 1, F.concat(F.lit("中标人信息\n单位名称 "), who, F.lit("、丙公司（联合体成员单位） 法定代表人：某人 电话：1\n中标金额："), said, F.lit("元")))
        .when(k == 2, F.concat(F.lit("拟 中 标 人 "), who, F.lit(" 中标金额 (万元) "), said, F.lit(" 工商注册号 1")))
        .when(k == 3, F.concat(F.lit("三、中标候选人公示内容"), *ten)).otherwise(F.concat(F.lit("中标候选人："), who, F.lit("\n投标单位：戊公司")))
    )
    rows = once(dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")), text=text, kind=F.when(k.isin(1, 2), "中标结果公示").otherwise("中标候选人公示"))
    rows = rows.select("o_orderkey", F.explode(award_text.awards(F.col("text"), F.col("kind"))).alias("a"))
    return rows.select("o_orderkey", "a.rank", "a.winner", F.col("a.amount").cast("double").alias("amount"), F.col("a.score").cast("double").alias("score"))


@query("""SELECT o_orderkey::VARCHAR AS source_id, CASE WHEN o_orderkey % 2 = 0 THEN '采购意向' ELSE '需求调查' END AS info_type, strftime(o_orderdate, '%Y-%m-%d') AS publish_date,
       CASE WHEN o_custkey % 7 = 0 THEN '' ELSE o_custkey || '.00万元' END AS budget, '【项目简介】' || chr(10) || o_orderstatus || chr(10) || chr(10) || '【采购明细】' || chr(10) || '▸ ' || o_orderpriority AS full_content FROM orders""")
def json_list_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(
        F.col("o_orderkey").cast("string").alias("id"), F.lit(" t ").alias("title"), F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1).alias("type"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createTime"),
        F.when(F.col("o_custkey") % 7 == 0, "面议").when(((F.col("o_custkey") % 7 == 1) & (F.col("o_custkey") > 1)) | (F.col("o_custkey") > 10_000), (F.col("o_custkey") * 10_000).cast("string")).otherwise(F.col("o_custkey").cast("string")).alias("money"),
        F.col("o_orderstatus").alias("depict"), F.array(F.struct(F.col("o_orderpriority").alias("title"))).alias("intentionDetaileList"),
    )
    pages = read(spark, sf_dir, "orders").select(F.to_json(F.struct(F.struct(F.array(record).alias("records")).alias("data"))).alias("value"))
    return json_pages.list_pages(pages).select("source_id", "info_type", F.date_format("publish_date", "yyyy-MM-dd").alias("publish_date"), "budget", "full_content")


@query("""SELECT 'id' || p_partkey AS "infoId", 'c' || p_partkey % 5 AS categorynum, trim(p_name, ' ') AS title, '' AS infodate FROM part""")
def referring_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    entry = F.to_json(F.struct(F.lit(1).alias("infoId"), F.lit(2).alias("categorynum"), F.lit(3).alias("title")))
    values = [F.concat(F.lit('"id'), key, F.lit('"')), F.concat(F.lit('"c'), (F.col("p_partkey") % 5).cast("string"), F.lit('"')), F.concat(F.lit('"'), F.col("p_name"), F.lit('"'))]
    pages = read(spark, sf_dir, "part").select(F.concat(F.lit("["), F.concat_ws(",", entry, *values, entry, F.lit('{"infoId":1}')), F.lit("]")).alias("value"))
    return json_pages.referring_records(pages, fields=("infodate",))


@query("""WITH e AS (SELECT user_id, epoch_us(ts) AS at_us, event_id, event_type <> 'error' AS ok, count(*) FILTER (WHERE event_type <> 'error') OVER w AS island, count(*) OVER w AS total
           FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
         f AS (SELECT *, count(*) FILTER (WHERE NOT ok) OVER (PARTITION BY user_id, island ORDER BY at_us, event_id ROWS UNBOUNDED PRECEDING) AS failures FROM e)
    SELECT user_id, at_us, failures, total, CASE WHEN failures >= 3 THEN 'degraded' ELSE 'ok' END AS status FROM f""")
def stream_collector_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = flows.timed(flows.table_stream(spark, sf_dir, "events")).withColumn("ok", F.col("event_type") != "error")
    return flows.drained(spark, flows.collector_states(events, "user_id", "ok"))


@query("""WITH w AS (SELECT epoch_ms(max(ts)) - 600000 AS now FROM events), l AS (SELECT user_id, max(epoch_us(ts)) AS last_us FROM events GROUP BY 1)
    SELECT user_id, last_us FROM l, w WHERE last_us // 1000 + 9000000 < now AND NOT (now // 3600000 % 24 BETWEEN 2 AND 6)""")
def stream_watchdog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = flows.timed(flows.table_stream(spark, sf_dir, "events"))
    return flows.drained(spark, flows.watchdog(events, "user_id", 9_000, quiet=(2, 7)))


_STATES = """
    WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'start' WHEN 'error' THEN 'failed' ELSE 'ok' END AS kind, event_type AS source FROM events),
         l AS (SELECT *, count(*) FILTER (WHERE kind = 'start') OVER w AS life, lead(us) OVER w AS next FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
         i AS (SELECT *, count(*) FILTER (WHERE kind = 'ok') OVER w AS island, count(*) FILTER (WHERE kind = 'ok') OVER w AS ok, count(*) FILTER (WHERE kind = 'failed') OVER w AS fail,
                   CASE WHEN max((source = 'click')::INT) OVER w = 1 THEN 1 ELSE 0 END + CASE WHEN max((source = 'view')::INT) OVER w = 1 THEN 1 ELSE 0 END
                   + CASE WHEN max((source = 'purchase')::INT) OVER w = 1 THEN 1 ELSE 0 END + CASE WHEN max((source = 'error')::INT) OVER w = 1 THEN 1 ELSE 0 END AS sources
               FROM l WINDOW w AS (PARTITION BY user_id, life ORDER BY us, event_id)),
         f AS (SELECT *, count(*) FILTER (WHERE kind = 'failed') OVER (PARTITION BY user_id, life, island ORDER BY us, event_id) AS failures FROM i),
         now AS (SELECT (epoch_ms(max(ts)) - 600000) AS ms FROM events)
    SELECT user_id, us AS at_us, CASE WHEN failures >= 3 THEN 'degraded' ELSE 'ok' END AS status, failures::INT AS failures, ok::INT AS total_ok, fail::INT AS total_fail, sources::INT AS sources FROM f
    UNION ALL SELECT user_id, us + 72000000000, 'idle', 0, 0, 0, 0 FROM l, now WHERE kind = 'start' AND coalesce(next > us + 72000000000, (us + 72000000000) // 1000 + 1 <= ms)"""


def _collector(events: DataFrame) -> dict:
    kind = F.when(F.col("event_type") == "signup", "start").when(F.col("event_type") == "error", "failed").otherwise("ok")
    return {"key": "user_id", "kind": kind, "source": F.col("event_type"), "idle": 72_000}


@query(_STATES)
def stream_collector_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collectors that start, run, fail, fall idle and recover, as a state machine with timers; twenty hours without a run are idle."""
    events = flows.timed(flows.table_stream(spark, sf_dir, "events"))
    with collectors.timers_kept(spark):
        return flows.drained(spark, collectors.collector_states(events, **_collector(events)))


@query(_STATES)
def collector_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the whole log by windows."""
    events = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    last = events.agg(F.unix_micros(F.max("ts")).alias("last")).first()["last"] or 0
    return collectors.states_of_log(events, now_us=F.lit(last - 600_000_000), **_collector(events))
