"""Fields and classes of notices by their forms, qualifications, favourites, digests, sliding rates, restarted sums, a ladder of searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import certificates, classify, fields, overview
from ..functions.dictionaries import TITLE_CLASSES
from ..functions.text import token_estimate
from ..operators import conversations, matching, qualifications, rates, relevance
from ..operators.qualifications import CATEGORIES
from ..sources.tables import dealt, once, read
from . import relevance as relevant
from .registry import ORACLE_SQL, query

_WORDS = [w for words in TITLE_CLASSES.values() for w in words]


def _pick(words: list[str], at) -> F.Column:
    return F.element_at(F.array(*[F.lit(w) for w in words]), (at % len(words) + 1).cast("int"))


def _any(words) -> str:
    return f"len(list_filter({list(words)}, lambda w: contains(t, w))) > 0"


@query(f"""WITH n AS (SELECT p_partkey, '关于' || {_WORDS}[(p_partkey % {len(_WORDS)} + 1)] || '及' || CASE WHEN p_partkey % 3 = 0 THEN {_WORDS}[(p_partkey * 7 % {len(_WORDS)} + 1)] ELSE p_brand END || CASE WHEN p_partkey % 10 = 0 THEN '的说明' ELSE '' END AS t0 FROM part),
    m AS (SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '会议通知' ELSE t0 END AS t FROM n)
    SELECT p_partkey, CASE {" ".join(f"WHEN {_any(words)} THEN '{name}'" for name, words in TITLE_CLASSES.items())} ELSE 'other' END AS class FROM m""")
def title_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of titles that hold one word or two of different classes, or none."""
    key = F.col("p_partkey")
    title = F.concat(F.lit("关于"), _pick(_WORDS, key), F.lit("及"), F.when(key % 3 == 0, _pick(_WORDS, key * 7)).otherwise(F.col("p_brand")), F.when(key % 10 == 0, "的说明").otherwise(""))
    title = F.when(key % 11 == 0, "会议通知").otherwise(title)
    return read(spark, sf_dir, "part").select("p_partkey", classify.first_label(title, TITLE_CLASSES, "other").alias("class"))


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, o_orderdate::DATE AS d FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN o_custkey || '.5' WHEN 1 THEN '1,234' WHEN 2 THEN o_custkey::VARCHAR END AS budget, CASE k WHEN 1 THEN o_orderkey::VARCHAR WHEN 2 THEN '88' END AS bid_amount,
           CASE k WHEN 1 THEN '某公司' WHEN 2 THEN '丙厂' END AS supplier, CASE k WHEN 0 THEN '张三' WHEN 1 THEN '李四' WHEN 2 THEN '王五' END AS contact, CASE k WHEN 0 THEN '023-6500' WHEN 1 THEN '13900001111' WHEN 2 THEN '88-1' END AS phone,
           CASE k WHEN 1 THEN 'a.b@x-y.cn' END AS email, CASE k WHEN 0 THEN '某路' || o_custkey || '号' WHEN 2 THEN '乙街' END AS address, CASE k WHEN 0 THEN '道路改造' WHEN 1 THEN '设备' END AS overview,
           CASE k WHEN 0 THEN '两江新区' WHEN 2 THEN '渝北区' ELSE '重庆市' END AS region,
           CASE k WHEN 0 THEN strftime(d, '%Y-%m-%d') || ' 14:30:00' WHEN 1 THEN strftime(d, '%Y-%m-%d') || ' 09:05:00' WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' 09:30:00' WHEN 3 THEN strftime(d, '%Y-%m-%d') || ' 08:00:00' END AS due, CASE k WHEN 2 THEN strftime(d, '%Y-%m-%d') || ' 09:30:15' END AS opens FROM o""")
def page_field_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list of forms over composed pages: forms of different rank, fields that are missing."""
    k, said = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    day = lambda form: F.date_format("o_orderdate", form)
    page = (
        F.when(k == 0, F.concat(F.lit("项目概况：道路改造\n采购内容：不看\n预算金额：\t"), said, F.lit(".5万元\n截止时间："), day("yyyy-MM-dd"), F.lit(" 14:30\n联系人：张三/某\n电话：023-6500\n地址：某路"), said, F.lit("号 邮编 400000\n永川区和两江新区".replace("永川区和", ""))))
        .when(k == 1, F.concat(F.lit("项目简介：设备\n项目预算：1,234元\n中标金额："), F.col("o_orderkey").cast("string"), F.lit("元\n中标人： 某公司 \n截止日期："), day("yyyy年M月d日"), F.lit(" 9时5分\n联 系 人：李四，手机：13900001111 a.b@x-y.cn")))
        .when(k == 2, F.concat(F.lit("最高限价："), said, F.lit("万元，合同金额：88万元\n成交供应商：丙厂\n开标时间："), day("yyyy/M/d"), F.lit(" 9:30:15\n项目联系人：王五 联系方式：88-1\n联系地址：乙街\n北碚区外的渝北区".replace("北碚区外的", ""))))
        .otherwise(F.concat(F.lit("无标签 "), day("yyyy年MM月dd日"), F.lit("8:00")))
    )
    rows = once(dealt(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")), page=page).select("o_orderkey", fields.page_fields(F.col("page")).alias("f"))
    names = ("budget", "bid_amount", "supplier", "contact", "phone", "email", "address", "overview", "region")
    return rows.select("o_orderkey", *[F.col(f"f.{n}") for n in names], *[F.date_format(F.col(f"f.{n}"), "yyyy-MM-dd HH:mm:ss").alias(n) for n in ("due", "opens")])


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN '预算：' || o_custkey || '万' WHEN 1 THEN '最高限价 ' || o_custkey || ' 元' ELSE '' END AS budget, CASE k WHEN 0 THEN d || ' 9:30' WHEN 1 THEN d ELSE '' END AS deadline,
           CASE k WHEN 0 THEN '联系人：张三；电话：023-65001234；邮箱：a@b.cn' WHEN 1 THEN '手机13912345678' ELSE '' END AS contact, CASE k WHEN 0 THEN '资格要求：须具备建筑工程施工总承包二级及以上资质证书' WHEN 1 THEN '评标办法为综合评分法，详见招标文件第三章评标办法前附表' ELSE '' END AS line FROM o""")
def notice_abstracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, said, day = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    text = (
        F.when(k == 0, F.concat(F.lit("预算："), said, F.lit("万元，截止时："), day, F.lit(" 9:30，开标：2001-01-01。联系人：张三，电话：023-65001234，邮箱：a@b.cn\n资格要求：须具备建筑工程施工总承包二级及以上资质证书\n其他")))
        .when(k == 1, F.concat(F.lit("资格要求：无\n最高限价 "), said, F.lit(" 元 开标"), day, F.lit(" 手机13912345678 电话：123\n评标办法为综合评分法，详见招标文件第三章评标办法前附表\n"))).otherwise("无")
    )
    line = fields.line_at(text, ("资格要求", "评标办法"))
    told = read(spark, sf_dir, "orders").select("o_orderkey", fields.abstract(text).alias("a"), line.alias("line"))
    budget = F.regexp_replace("a.budget", "万元$", "万")  # the forms take either unit, one of them whole
    return told.select("o_orderkey", budget.alias("budget"), "a.deadline", "a.contact", "line")


_ASKED = ("道路施工一级", "软件系统集成", "", "办公家具甲级采购", "咨询", "无要求", "施工及监理壹级或二级")
_TITLES = ("绿化养护一级", "某项目")
_FIRMS = ("某建筑公司", "某软件物业公司", "某公司", "设备租赁与咨询")
_SQL_NEEDS = f"""n0 AS (SELECT c_custkey AS id, {list(_ASKED)}[c_custkey % {len(_ASKED)} + 1] AS a, {list(_TITLES)}[c_custkey % {len(_TITLES)} + 1] AS b FROM customer), n1 AS (SELECT id, CASE WHEN a = '' THEN b ELSE a END AS t FROM n0),
    n AS (SELECT id, list_filter([{", ".join(f"CASE WHEN {_any(w)} THEN '{c}' END" for c, w in CATEGORIES.items())}], lambda x: x IS NOT NULL) AS cats,
              list_filter([CASE WHEN contains(t, '特级') THEN '特级' END, CASE WHEN contains(t, '一级') OR contains(t, '壹级') THEN '一级' END, CASE WHEN contains(t, '二级') OR contains(t, '贰级') THEN '二级' END, CASE WHEN contains(t, '三级') OR contains(t, '叁级') THEN '三级' END,
              CASE WHEN contains(t, '甲级') THEN '甲级' END, CASE WHEN contains(t, '乙级') THEN '乙级' END, CASE WHEN contains(t, '丙级') THEN '丙级' END], lambda x: x IS NOT NULL) AS levels FROM n1),
    q0 AS (SELECT s_suppkey, {list(_FIRMS)}[s_suppkey % {len(_FIRMS)} + 1] AS t, ['建筑', 'IT', '其他', NULL, '服务'][s_suppkey % 5 + 1] AS category, ['一级', '', '甲级'][s_suppkey % 3 + 1] AS level, ['有效', '过期', '待审核', '有效'][(s_suppkey // 4) % 4 + 1] AS status FROM supplier),
    q AS (SELECT *, list_filter([{", ".join(f"CASE WHEN {_any(w)} THEN '{c}' END" for c, w in CATEGORIES.items())}], lambda x: x IS NOT NULL) AS named FROM q0),
    p AS (SELECT id, s_suppkey, cats, category, CASE WHEN status = '过期' THEN 10 ELSE least(100, CASE WHEN len(cats) = 0 THEN 20 * len(named) WHEN coalesce(list_contains(cats, category), false) THEN 50 ELSE 30 * len(list_intersect(named, cats)) END
              + CASE WHEN len(levels) = 0 THEN CASE WHEN level <> '' THEN 10 ELSE 0 END WHEN list_contains(levels, level) THEN 30 ELSE 0 END) END AS score FROM n, q)"""


def _needs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    notices = read(spark, sf_dir, "customer").select("c_custkey", _pick(list(_ASKED), c).alias("text"), _pick(list(_TITLES), c).alias("title"))
    kind = F.element_at(F.array(F.lit("建筑"), F.lit("IT"), F.lit("其他"), F.lit(None), F.lit("服务")), (s % 5 + 1).cast("int"))
    held = read(spark, sf_dir, "supplier").select(
        "s_suppkey", _pick(list(_FIRMS), s).alias("name"), kind.alias("category"), _pick(["一级", "", "甲级"], s).alias("level"), _pick(["有效", "过期", "待审核", "有效"], F.floor(s / 4)).alias("status"))
    return qualifications.requirements(notices, "c_custkey", "text", "title"), held


@query(f"""WITH {_SQL_NEEDS} SELECT id, s_suppkey, score::INT AS score, CASE WHEN score >= 80 THEN 'full' ELSE 'partial' END AS class FROM p WHERE score >= 40""")
def qualification_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices against a table of qualifications, by category, name and level."""
    return qualifications.matches(*_needs(spark, sf_dir), "s_suppkey")


@query(f"""WITH {_SQL_NEEDS}, h AS (SELECT list(DISTINCT category) AS held FROM q WHERE status = '有效'),
    m AS (SELECT id, count(*) FILTER (WHERE score >= 80) AS matched, count(*) FILTER (WHERE score BETWEEN 40 AND 79) AS partial, list(DISTINCT category) FILTER (WHERE score >= 80) AS met FROM p GROUP BY 1)
    SELECT n.id, coalesce(matched, 0) AS matched, coalesce(partial, 0) AS partial, array_to_string(list_filter(cats, lambda c: NOT coalesce(list_contains(held, c), false)), ',') AS missing,
           CASE WHEN len(cats) > 0 THEN round(len(list_filter(cats, lambda c: coalesce(list_contains(met, c), false))) / len(cats)::DOUBLE * 100, 1) ELSE 0 END AS coverage FROM n LEFT JOIN m USING (id), h""")
def qualification_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per notice: matches, categories that no valid qualification has, share of the categories that full matches cover."""
    return qualifications.coverage(*_needs(spark, sf_dir), "s_suppkey")


_FAVOURITES = """r AS (SELECT p_partkey, 'http://x/' || p_partkey AS url, p_name AS name, p_brand || p_size AS number FROM part),
    f AS (SELECT p_partkey AS favourite, 'u' || p_partkey % 3 AS user, CASE WHEN p_partkey % 20 = 0 THEN 'http://x/' || p_partkey ELSE 'http://old/' || p_partkey % 40 END AS url,
              CASE p_partkey % 4 WHEN 0 THEN p_name || ' lot' WHEN 1 THEN substr(p_name, 3) WHEN 2 THEN '' ELSE p_name END AS name, CASE WHEN p_partkey % 30 <> 0 THEN p_brand || p_size END AS number, p_partkey AS k FROM part WHERE p_partkey % 10 < 2)"""


def _favourites(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    parts, k = read(spark, sf_dir, "part"), F.col("p_partkey")
    number = F.concat("p_brand", F.col("p_size").cast("string"))
    url = F.concat(F.lit("http://x/"), k.cast("string"))
    records = parts.select("p_partkey", url.alias("url"), F.col("p_name").alias("name"), number.alias("number"))
    name = F.when(k % 4 == 0, F.concat("p_name", F.lit(" lot"))).when(k % 4 == 1, F.substring("p_name", 3, 1000)).when(k % 4 == 2, "").otherwise(F.col("p_name"))
    held = parts.where(k % 10 < 2).select(
        k.alias("favourite"), F.concat(F.lit("u"), (k % 3).cast("string")).alias("user"), F.when(k % 20 == 0, url).otherwise(F.concat(F.lit("http://old/"), (k % 40).cast("string"))).alias("url"), name.alias("name"), F.when(k % 30 != 0, number).alias("number"))
    return records, held


@query(f"""WITH {_FAVOURITES}, m AS (SELECT p_partkey, favourite, f.user, f.url, CASE WHEN r.url = f.url THEN 'url' WHEN f.name <> '' AND r.name = f.name THEN 'name'
        WHEN f.name <> '' AND ((length(r.name) >= 6 AND contains(f.name, r.name)) OR (length(f.name) >= 6 AND contains(r.name, f.name))) THEN 'name_contains' WHEN r.number = f.number THEN 'project_no' END AS match_type FROM r, f)
    SELECT p_partkey, favourite, match_type FROM m WHERE match_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_partkey, user, url ORDER BY favourite) = 1""")
def favourite_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Favourites that records concern, by the first of four rules that fits."""
    return matching.favourite_matches(*_favourites(spark, sf_dir), "p_partkey", "favourite")


@query("""WITH e AS (SELECT event_id AS id, user_id AS project, event_type AS kind, ts AS sent, 'http://x/' || event_id % 300 AS url, 'name ' || user_id % 60 AS name FROM events WHERE ts >= TIMESTAMP '2024-01-25 00:00:00'),
    f AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'http://x/' || p_partkey % 150 END AS url, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE 'name ' || p_partkey % 45 END AS name, ['archived', 'active', 'archived', 'archived'][p_partkey // 45 % 4 + 1] AS status FROM part WHERE p_partkey <= 180),
    u AS (SELECT url, arg_max(status, k) AS status FROM f WHERE url <> '' GROUP BY 1), nm AS (SELECT name, coalesce(arg_min(status, k) FILTER (WHERE status <> 'archived'), 'archived') AS status FROM f WHERE name <> '' GROUP BY 1),
    s AS (SELECT e.*, coalesce(u.status, nm.status) AS status FROM e LEFT JOIN u ON u.url = e.url LEFT JOIN nm ON nm.name = e.name), l AS (SELECT * FROM s WHERE coalesce(status <> 'archived', true)),
    k AS (SELECT project, string_agg(kind, ',' ORDER BY seen DESC, top DESC) AS kinds FROM (SELECT project, kind, max(sent) AS seen, arg_max(id, epoch_us(sent)::HUGEINT * 10000000 + id) AS top FROM l GROUP BY ALL) GROUP BY 1),
    n AS (SELECT project, arg_max(id, epoch_us(sent)::HUGEINT * 10000000 + id) AS latest, count(*) AS n FROM l GROUP BY 1)
    SELECT n.project, l.name, l.url, kinds, latest, n FROM n JOIN k ON k.project = n.project JOIN l ON l.id = latest
    UNION ALL SELECT -1, 'archived', '', '', count(*), (SELECT count(*) FROM l) FROM s WHERE status = 'archived'""")
def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days' notices by project, kinds in order of first sight, archived favourites left out and counted in a row of their own."""
    joined = lambda word, at: F.concat(F.lit(word), at.cast("string"))
    recent = read(spark, sf_dir, "events").where(F.col("ts") >= F.lit("2024-01-25").cast("timestamp_ntz"))
    name = joined("name ", F.col("user_id") % 60)
    notices = recent.select(F.col("event_id").alias("id"), F.col("user_id").alias("project"), name.alias("name"), name.alias("title"), F.col("event_type").alias("kind"), joined("http://x/", F.col("event_id") % 300).alias("url"), F.col("ts").alias("sent"))
    k = F.col("p_partkey")
    held = read(spark, sf_dir, "part").where(k <= 180).select(
        k.alias("favourite"), F.when(k % 3 == 0, "").otherwise(joined("http://x/", k % 150)).alias("url"), F.when(k % 5 == 0, "").otherwise(joined("name ", k % 45)).alias("name"), _pick(["archived", "active", "archived", "archived"], F.floor(k / 45)).alias("status"))
    told, counts = matching.digest(notices, held, "favourite")
    last = counts.select(F.lit(-1).cast("bigint").alias("project"), F.lit("archived").alias("name"), F.lit("").alias("url"), F.lit("").alias("kinds"), F.col("archived").alias("latest"), F.col("told").alias("n"))
    return told.unionByName(last)


@query("""WITH s AS (SELECT DISTINCT user_id FROM events UNION ALL SELECT -1), b AS (SELECT min(epoch_us(ts) // 3600000000) AS low, max(epoch_us(ts) // 3600000000) AS high FROM events),
    g AS (SELECT user_id, unnest(range(low, high + 1)) AS step FROM s, b), c AS (SELECT user_id, epoch_us(ts) // 3600000000 AS step, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS hits FROM events GROUP BY ALL),
    w AS (SELECT g.user_id, g.step, sum(coalesce(n, 0)) OVER r AS n, sum(coalesce(hits, 0)) OVER r AS hits FROM g LEFT JOIN c ON c.user_id = g.user_id AND c.step = g.step WINDOW r AS (PARTITION BY g.user_id ORDER BY g.step RANGE BETWEEN 11 PRECEDING AND CURRENT ROW)),
    a AS (SELECT *, hits / 12.0 AS rate, CASE WHEN n > 0 THEN hits / n::DOUBLE END AS ratio FROM w)
    SELECT user_id, step, n::BIGINT AS n, round(rate, 9)::DOUBLE AS rate, round(ratio, 9) AS ratio, coalesce(min(coalesce(ratio > 0.3, false)::INT) OVER (PARTITION BY user_id ORDER BY step ROWS 2 PRECEDING) = 1 AND count(*) OVER (PARTITION BY user_id ORDER BY step ROWS 2 PRECEDING) = 3, false) AS firing FROM a""")
def sliding_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of every source in the last twelve hours at every hour, their share of all events, and whether it has been above 0.3 for three
    hours; with one source that has no events."""
    events = read(spark, sf_dir, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type")
    low, high = events.agg(F.floor(F.min("us") / 3_600_000_000), F.floor(F.max("us") / 3_600_000_000)).first()
    counts = rates.sliding(events, "user_id", F.col("us"), F.col("event_type") == "error", 3_600_000_000, 12 * 3_600_000_000)
    sources = events.select("user_id").unionByName(spark.createDataFrame([(-1,)], "user_id bigint"))
    every = rates.alerts(rates.filled(counts, sources, "user_id", low or 0, -1 if high is None else high), "user_id", 12, 0.3, 3)
    return every.select("user_id", "step", "n", F.round("rate", 9).alias("rate"), F.round("ratio", 9).alias("ratio"), "firing")


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, greatest(floor(coalesce(length(text), 0) / 4.0), 1) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    s AS (SELECT conv_id, turn, n, 1 AS part, tokens AS used FROM t WHERE n = 1
          UNION ALL SELECT t.conv_id, t.turn, t.n, s.part + CASE WHEN s.used + t.tokens > 200 THEN 1 ELSE 0 END, CASE WHEN s.used + t.tokens > 200 THEN t.tokens ELSE s.used + t.tokens END FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1)
    SELECT conv_id, turn, part, used::DOUBLE AS used FROM s""")
def restarted_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a conversation's turns, summed anew where they would exceed 200."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", token_estimate(F.coalesce("text", F.lit(""))).cast("double").alias("tokens"))
    return conversations.restarted(turns, "conv_id", ["turn"], "tokens", 200).select("conv_id", "turn", "part", "used")


@query(f"""WITH q AS ({ORACLE_SQL['quality_score']})
    SELECT CASE grade WHEN 'A' THEN 'excellent' WHEN 'B' THEN 'good' WHEN 'C' THEN 'fair' ELSE 'poor' END AS level, count(*) AS n, round(avg(total) + 1e-9, 4) AS mean, min(total) AS least, max(total) AS most FROM q GROUP BY 1""")
def quality_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the quality scores of notices."""
    level = F.when(F.col("grade") == "A", "excellent").when(F.col("grade") == "B", "good").when(F.col("grade") == "C", "fair").otherwise("poor")
    scored = relevant.quality_score(spark, sf_dir)
    return scored.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total") + 1e-9, 4).alias("mean"), F.min("total").alias("least"), F.max("total").alias("most"))


_KINDS = ("采购公告", "采购公告", "招标公告", "招标公告", "采购结果公告", "招标计划", "中标候选人公示", "答疑补遗", "中标结果公示", "答疑变更", "其他", "其他")


@query("""WITH o AS (SELECT o_orderkey, o_custkey::VARCHAR AS c, o_orderkey % 12 AS k, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
    SELECT o_orderkey, CASE k WHEN 0 THEN '📌 投标截止时间：' || d || chr(10) || '一、项目基本情况 ' || c || '号项目' WHEN 1 THEN '📌 投标截止时间：' || d || chr(10) || '📋 采购方式：竞争性磋商' || chr(10) || '💰 最高限价：' || c || '万元'
           WHEN 2 THEN '📌 投标截止时间：' || d || chr(10) || '二、项目概况与招标范围 ' || c || '号桥' WHEN 3 THEN '📌 投标截止时间：' || d || chr(10) || '💰 最高限价：' || c || '万元' || chr(10) || '🎯 招标范围：' || c || '号路段的全部土建施工内容'
           WHEN 4 THEN '📦 ' || c || chr(10) || '🏢 甲公司' || chr(10) || '🏢 乙公司' || chr(10) || '💵 5元' WHEN 5 THEN '🏗️ 招标人：某局' || c || chr(10) || '📋 路桥' || chr(10) || '⚙️ 招标方式：公开招标' || chr(10) || '📅 2024年5月'
           WHEN 6 THEN '🏢 甲公司' || c || chr(10) || '🏢 乙公司' || chr(10) || '💵 9元' WHEN 7 THEN '问：工期共多少天' || chr(10) || '答：共' || c || '天整' WHEN 8 THEN '🏢 丙公司' || c || chr(10) || '💵 7元'
           WHEN 9 THEN '原' || c || '页的日期作废' WHEN 10 THEN '关于' || c || '的通知' ELSE '无有效信息' END AS overview FROM o""")
def notice_overviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overviews of every kind of notice by each of their rules."""
    k, c, d = F.col("o_orderkey") % 12, F.col("o_custkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    texts = (
        said("投标截止：", d, "\n一、项目基本情况\n", c, "号项目"), said("投标截止：", d, "\n采购方式：竞争性磋商"), said("6.投标文件递交的截止时间 ", d, "\n二、项目概况与招标范围\n", c, "号桥"),
        said("时间 ", d, "\n招标范围：", c, "号路段的全部土建施工内容"), said("包号：", c, "\n成交供应商：甲公司\n中标供应商：乙公司\n成交金额：5元"),
        said("招标人：某局", c, "\n项目名称：路桥\n招标方式：公开招标\n招标文件计划发布时间：2024年5月"), said("第一中标候选人（名称）：甲公司", c, "\n第二中标候选人(名称)：乙公司\n投标报价：9元"),
        said("问：工期共多少天\n答：共", c, "天整\n无关的一行内容"), said("中标人：丙公司", c, "\n中标金额：7元"), said("请各方知悉\n原", c, "页的日期作废\n无关的一行内容"), said("首页内容无\n关于", c, "的通知\n正文如下文"), F.lit(""))
    text, kind = texts[-1], F.lit(_KINDS[-1])
    for i in range(len(texts) - 1):
        text, kind = F.when(k == i, texts[i]).otherwise(text), F.when(k == i, _KINDS[i]).otherwise(kind)
    business = F.when(k == 0, "政府采购").when(k == 2, "工程建设").otherwise("其他")
    told = overview.overview(kind, business, F.when(k.isin(1, 3), said(c, "万元")), F.lit(None).cast("string"), text)
    return read(spark, sf_dir, "orders").select("o_orderkey", told.alias("overview"))


@query("""WITH c AS (SELECT c_custkey, c_name, c_custkey % 4 AS k, lpad((c_custkey % 1000000)::VARCHAR, 6, '0') AS six, '0' || (1 + c_custkey % 9) AS m FROM customer)
    SELECT c_custkey, ['营业执照', '建造师', '身份证', '安全员'][k + 1] AS certificate_type, [c_name || '公司', '李四', '王五', '赵六'][k + 1] AS name, [NULL, '李四', '王五', '赵六'][k + 1] AS person_name,
           CASE k WHEN 2 THEN '50010119900101' || right(six, 3) || 'X' END AS id_number, CASE k WHEN 0 THEN '91500000MA5U' || six WHEN 1 THEN 'A-' || six WHEN 3 THEN 'AQ' || six END AS certificate_no, CASE k WHEN 1 THEN 'A-' || six WHEN 3 THEN 'AQ' || six END AS construction_no,
           CASE k WHEN 1 THEN '一级建造师' END AS title, CASE k WHEN 1 THEN '一级' WHEN 3 THEN '三级' END AS level, CASE k WHEN 1 THEN '某集团' END AS registered_city, CASE k WHEN 0 THEN '2020-01-02' END AS valid_from,
           CASE k WHEN 0 THEN '2030-' || m || '-05' WHEN 1 THEN '2031-' || m || '-06' WHEN 3 THEN '2032-' || m || '-09' END AS valid_to, CASE k WHEN 0 THEN '某局' END AS issuer, CASE k WHEN 0 THEN '某路' || six || '号' WHEN 3 THEN '北路' END AS address,
           CASE k WHEN 0 THEN '张三' END AS legal_person FROM c""")
def certificate_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of four kinds of certificates."""
    k, key = F.col("c_custkey") % 4, F.col("c_custkey")
    six, month = F.lpad((key % 1_000_000).cast("string"), 6, "0"), (1 + key % 9).cast("string")
    said = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    text = (
        F.when(k == 0, said("营业执照\n统一社会信用代码：91500000MA5U", six, "\n企业名称：", F.col("c_name"), "公司\n法定代表人：张三\n注册地址：某路", six, "号\n发证机关：某局。\n有效期：2020年1月2日至2030年", month, "月5日"))
        .when(k == 1, said("姓名：李四\n一级建造师\n注册编号：A-", six, "\n专业:建筑\n工作单位：某集团\n有效期至2031-", month, "-06"))
        .when(k == 2, said("居民身份证\n姓名：王五\n性别男 民族汉\n公民身份号码 50010119900101", F.right(six, F.lit(3)), "x"))
        .otherwise(said("安全生产考核合格证\n安全员\n持有人：赵六\n等级证书 三级\n编号：AQ", six, "\n有效期：2032/", month, "/9\n地址：北路"))
    )
    rows = once(dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_name")), text=text).select("c_custkey", certificates.fields(F.col("text")).alias("f"))
    names = ("certificate_type", "name", "person_name", "id_number", "certificate_no", "construction_no", "title", "level", "registered_city", "valid_from", "valid_to", "issuer", "address", "legal_person")
    return rows.select("c_custkey", *[F.col(f"f.{n}") for n in names])


_STEPS = (("vector", False, "steel bolt"), ("terms", True, "steel bolt"), ("words", True, "ld wid"))


@query("""WITH q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id = 3), v AS (SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], e), 6) AS best FROM embeddings, q ORDER BY best DESC, vec_id LIMIT 50),
    w AS (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(p_name), '[\\s!-/:-@\\[-`{-~]+')) AS term FROM part), c AS (SELECT id, term, count(*) AS n FROM w WHERE length(term) >= 2 GROUP BY ALL), tf AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM c),
    i AS (SELECT term, ln((SELECT count(*) FROM part) / (count(*) + 1)::DOUBLE) AS idf FROM tf GROUP BY 1), d AS (SELECT id, term, tf * idf AS w FROM tf JOIN i USING (term)), k AS (SELECT term, 0.5 * coalesce(idf, 0) AS w FROM (SELECT unnest(['steel', 'bolt']) AS term) LEFT JOIN i USING (term)),
    n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM d GROUP BY 1), s AS (SELECT d.id, round(coalesce(sum(d.w * k.w) / nullif(any_value(norm) * (SELECT sqrt(sum(w * w)) FROM k), 0), 0), 6) AS best FROM d JOIN k USING (term) JOIN n ON n.id = d.id GROUP BY 1)
    SELECT 'vector' AS asked, p_partkey, best FROM part JOIN v ON p_partkey = vec_id UNION ALL SELECT 'terms', id, best FROM s WHERE best >= 0.15 UNION ALL SELECT 'words', p_partkey, 1.0 FROM part WHERE contains(p_name, 'ld wid')""")
def search_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three searches down one ladder: the first is answered by vectors, the second, whose vectors are of things that aren't there any more, by terms,
    the third by a piece of a name."""
    parts, table = read(spark, sf_dir, "part").select("p_partkey", "p_name"), read(spark, sf_dir, "embeddings")
    target = table.where("vec_id = 3").select(F.col("embedding").alias("q")).limit(1)
    beyond = (parts.agg(F.max("p_partkey")).first()[0] or 0) + 1 - (table.agg(F.min("vec_id")).first()[0] or 0)  # puts vectors behind all parts
    out = None
    for asked, gone, words in _STEPS:
        def by_vector(offset=beyond if gone else 0) -> DataFrame:
            hits = relevance.nearest(table.join(F.broadcast(target)), F.col("embedding"), F.col("q"), 50, "vec_id")
            return parts.join(hits, F.col("p_partkey") == F.col("vec_id") + offset).select("p_partkey", F.col("score").alias("best"))

        def by_terms(words=words) -> DataFrame:
            found = relevance.keyword_matches(parts, "p_partkey", "p_name", spark.createDataFrame([(words,)], "keyword string"), 0.15)
            return found.where(F.size("matched") > 0).select(F.col("id").alias("p_partkey"), "best")

        def by_words(words=words) -> DataFrame:
            return parts.where(F.contains("p_name", F.lit(words))).select("p_partkey", F.lit(1.0).alias("best"))

        found = matching.first_that_finds(by_vector, by_terms, by_words).select(F.lit(asked).alias("asked"), "p_partkey", "best")
        out = found if out is None else out.unionByName(found)
    return out
