"""Types and trades of notices, keyword tables, names inside names, facets by day, hosts and completeness, changes of several tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import classify
from ..functions.predicates import any_of
from ..operators import facets, matching, merge
from ..sources.tables import read
from .registry import query

_TITLES = (
    "智慧园区建设", "老旧小区智能化改造", "老旧小区外墙维修", "新建住宅小区市政道路", "医院装饰工程", "道路绿化养护", "公园景观提升", "机房维护服务", "设备采购", "办公家具与教学设备", "物业保洁服务", "视频监控与门禁系统",
    "渝北区紧急抢修", "成都重点桥梁工程", "遵义数据中心", "Road works",
)


def _titled(key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (key % len(_TITLES) + 1).cast("int"))


_SQL_TITLES = f"(SELECT p_partkey, p_name, p_retailprice, {list(_TITLES)}[p_partkey % {len(_TITLES)} + 1] AS title FROM part)"


def _sql_hits(words: tuple) -> str:
    return f"len(list_filter({list(words)}, lambda w: contains(title, w)))"


@query(f"""WITH t AS (SELECT p_partkey, title, {", ".join(f"{_sql_hits(yes)} > 0 AND {_sql_hits(no)} = 0 AS t{k}" for k, (_, yes, no) in enumerate(classify.PROJECT_TYPES))} FROM {_SQL_TITLES})
    SELECT p_partkey, concat_ws(',', {", ".join(f"CASE WHEN t{k} THEN '{name}' END" for k, (name, _, _) in enumerate(classify.PROJECT_TYPES))}) AS types FROM t""")
def project_type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(classify.project_types(_titled(F.col("p_partkey")), F.lit("")), ",").alias("types"))


@query(f"""WITH h AS (SELECT p_partkey, title, p_retailprice, [{", ".join(f"{{'n': {_sql_hits(words)}, 'k': {-k}, 'v': '{name}'}}" for k, (name, words) in enumerate(classify.TRADES.items()))}] AS c FROM {_SQL_TITLES})
    SELECT p_partkey, CASE WHEN list_max(c).n = 0 THEN '其他' ELSE list_max(c).v END AS trade,
        CASE {" ".join(f"WHEN {_sql_hits(words)} > 0 THEN '{name}'" for name, words in classify.REGIONS.items())} ELSE '全国' END AS region,
        least(5, CASE WHEN {_sql_hits(classify.PRIORITIES[5])} > 0 THEN 5 WHEN {_sql_hits(classify.PRIORITIES[4])} > 0 THEN 4 ELSE 3 END + (p_retailprice >= 1000)::INT) AS priority FROM h""")
def notice_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = _titled(F.col("p_partkey"))
    level = F.when(F.col("p_retailprice") >= 5000, "超大").when(F.col("p_retailprice") >= 1000, "大").otherwise("小")
    return read(spark, sf_dir, "part").select("p_partkey", classify.trade(title).alias("trade"), classify.region(title).alias("region"), classify.priority(title, level).alias("priority"))


_KEYWORDS = (("改造", "include", True), ("系统", "include", True), ("监控", "include", True), ("桥", "include", True), ("维修", "exclude", True), ("建设", "include", False), ("门禁系统", "include", True), ("服务", "exclude", False))


@query(f"""WITH k AS (SELECT unnest({[w for w, c, on in _KEYWORDS if on]}) AS keyword, unnest({[c for w, c, on in _KEYWORDS if on]}) AS category)
    SELECT p_partkey, (SELECT string_agg(keyword, ', ' ORDER BY keyword) FROM k WHERE category = 'include' AND contains(title, keyword)) AS matched FROM {_SQL_TITLES} t
    WHERE NOT EXISTS (SELECT 1 FROM k WHERE category = 'exclude' AND contains(t.title, keyword)) AND NOT contains(title, '公园')
    UNION ALL SELECT p_partkey, NULL FROM {_SQL_TITLES} t WHERE EXISTS (SELECT 1 FROM k WHERE category = 'exclude' AND contains(t.title, keyword)) OR contains(title, '公园')""")
def keyword_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame(_KEYWORDS, "keyword string, category string, enabled boolean")
    titles = read(spark, sf_dir, "part").select("p_partkey", _titled(F.col("p_partkey")).alias("title"))
    return matching.keyword_backfill(titles, "title", keywords, "公园").select("p_partkey", "matched")


@query("""WITH f AS (SELECT p_partkey AS favourite, CASE WHEN p_partkey % 3 = 0 THEN p_name || ' lot' WHEN p_partkey % 3 = 1 THEN substr(p_name, 3) ELSE p_name END AS f_name FROM part WHERE p_partkey % 10 = 0)
    SELECT p_partkey, favourite FROM part, f WHERE p_name <> f_name AND ((length(p_name) >= 6 AND contains(f_name, p_name)) OR (length(f_name) >= 6 AND contains(p_name, f_name)))""")
def name_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    form = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_name", F.lit(" lot"))).when(F.col("p_partkey") % 3 == 1, F.substring("p_name", 3, 1_000)).otherwise(F.col("p_name"))
    favourites = parts.where("p_partkey % 10 = 0").select(F.col("p_partkey").alias("favourite"), form.alias("f_name"))
    return matching.inside_names(parts, favourites, "p_partkey", "favourite", "p_name", "f_name")


@query("""WITH r AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderdate >= DATE '1996-01-01')
    SELECT 'kind' AS facet, coalesce(kind, '未分类') AS value, count(*) AS n FROM r GROUP BY kind
    UNION ALL SELECT * FROM (SELECT 'day', day, count(*) FROM r GROUP BY day ORDER BY day DESC LIMIT 30) UNION ALL SELECT 'all', min(day) || ' ' || max(day), count(*) FROM r""")
def dated_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority"))
    rows = read(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("1996-01-01").cast("date")).select(kind.alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return facets.dated_facets(rows, ["kind"], "day", 30, "未分类")


@query("""WITH p AS (SELECT page_id, regexp_extract(lower(url), '^[a-z]+://(?:[^/@]*@)?([^/:?#]+)', 1) AS host, html, DATE '2024-01-01' + (page_id % 12)::INT AS day FROM pages)
    SELECT count(*) AS total, count(DISTINCT nullif(host, '')) AS hosts, count(*) FILTER (WHERE day >= DATE '2024-01-06') AS recent,
           round(100.0 * count(*) FILTER (WHERE day >= DATE '2024-01-06' AND length(html) > 2000) / nullif(count(*) FILTER (WHERE day >= DATE '2024-01-06'), 0), 1) AS complete FROM p""")
def host_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 12).cast("int"))
    return facets.host_dashboard(read(spark, sf_dir, "pages").select("url", day.alias("day"), (F.length("html") > 2000).alias("full")), "url", "day", "full", "2024-01-12")


@query("""WITH a AS (SELECT 0 AS place, o_orderkey % 700 AS url, o_orderdate AS updated, o_orderkey AS id FROM orders WHERE o_orderdate > DATE '1997-01-01' ORDER BY o_orderdate, o_orderkey LIMIT 300),
    b AS (SELECT 1 AS place, l_orderkey % 900 AS url, l_shipdate AS updated, l_orderkey * 10 + l_linenumber AS id FROM lineitem WHERE l_shipdate > DATE '1997-01-01' ORDER BY l_shipdate, id LIMIT 300), u AS (SELECT * FROM a UNION ALL SELECT * FROM b)
    SELECT url, place, id FROM u QUALIFY row_number() OVER (PARTITION BY url ORDER BY place, updated, id) = 1""")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = read(spark, sf_dir, "orders", "lineitem")
    a = orders.select((F.col("o_orderkey") % 700).alias("url"), F.col("o_orderdate").alias("updated"), F.col("o_orderkey").alias("id"))
    b = lines.select((F.col("l_orderkey") % 900).alias("url"), F.col("l_shipdate").alias("updated"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return merge.changes_since([a, b], "url", "updated", "id", F.lit("1997-01-01").cast("date"), 300).select("url", "place", "id")


@query("""SELECT p_partkey FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), '#13') OR contains(lower(p_type), 'economy')) AND contains(lower(p_brand), lower('BRAND#1'))""")
def any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = any_of([F.contains(F.lower("p_name"), F.lit("red")), F.contains(F.lower("p_brand"), F.lit("#13")), F.contains(F.lower("p_type"), F.lit("economy"))])
    return read(spark, sf_dir, "part").where(found & F.contains(F.lower("p_brand"), F.lower(F.lit("BRAND#1")))).select("p_partkey")
