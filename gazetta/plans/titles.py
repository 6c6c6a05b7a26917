"""Similar titles of pages, pair by pair and in groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import segment
from ..operators import titles
from ..sources.tables import read
from .registry import query

_PAIRS = r"""WITH t AS (SELECT lower(trim(regexp_extract(html, '<title>(.*?)</title>', 1))) AS title, min(page_id) AS id FROM pages GROUP BY 1 HAVING title <> ''),
     x AS (SELECT id, unnest(regexp_split_to_array(title, '[\s[:punct:]]+')) AS term FROM t), c AS (SELECT id, term, count(*) AS n FROM x WHERE length(term) >= 2 GROUP BY 1, 2),
     f AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf, count(*) OVER (PARTITION BY term) AS df FROM c), w AS (SELECT id, term, tf * (ln(((SELECT count(*) FROM t) + 1) / (df + 1)) + 1) AS w FROM f),
     u AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM w)
    SELECT a.id AS a, b.id AS b, round(sum(a.u * b.u), 6) AS similarity FROM u a JOIN u b ON a.term = b.term AND a.id < b.id GROUP BY 1, 2 HAVING sum(a.u * b.u) >= 0.3 - 1e-9"""


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"))


@query(_PAIRS)
def title_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = titles.similar_titles(titles.distinct_titles(_titled(spark, sf_dir), "page_id", "title"), 0.3)
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(rf"""WITH RECURSIVE l AS MATERIALIZED ({_PAIRS}), t AS (SELECT lower(trim(regexp_extract(html, '<title>(.*?)</title>', 1))) AS title, min(page_id) AS id FROM pages GROUP BY 1 HAVING title <> ''),
     e AS MATERIALIZED (SELECT id, title, row_number() OVER (ORDER BY id) AS n, (SELECT list(a ORDER BY a) FROM l WHERE l.b = t.id) AS near FROM t),
     g AS (SELECT n, id, NULL::BIGINT AS head, [id] AS heads FROM e WHERE n = 1
           UNION ALL SELECT e.n, e.id, c.head, CASE WHEN c.head IS NULL THEN g.heads || [e.id] ELSE g.heads END FROM g JOIN e ON e.n = g.n + 1, LATERAL (SELECT list_filter(coalesce(e.near, []), lambda x: list_contains(g.heads, x))[1] AS head) c),
     m AS (SELECT page_id AS id, coalesce(head, g.id) AS group_id FROM pages JOIN e ON e.title = lower(trim(regexp_extract(html, '<title>(.*?)</title>', 1))) JOIN g ON g.id = e.id)
    SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size FROM m QUALIFY group_size > 1""")
def title_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.title_groups(_titled(spark, sf_dir), "page_id", "title", 0.3)


@query(r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS term FROM documents),
    n AS (SELECT doc_id, term, count(*) AS n FROM w WHERE length(term) >= 2 GROUP BY ALL)
    SELECT term, sum(n)::BIGINT AS n, count(*) AS documents, max(n) AS most FROM n GROUP BY term""")
def plain_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of all texts by the tokeniser of titles: how often, in how many texts, how often in one."""
    words = read(spark, sf_dir, "documents").select("doc_id", F.explode(segment.plain_words(F.col("text"))).alias("term"))
    counts = words.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"), F.max("n").alias("most"))


#: Words of stand-in titles with their counts; some overlap others.
_WORDS = {"道路": 90, "改造": 80, "园林": 60, "绿化": 60, "养护": 40, "路改": 2, "造园": 1, "林绿": 1, "化养": 1, "医院": 50, "设备": 70, "院设": 1, "购置费": 30}


@query("""WITH t AS (SELECT p_partkey, regexp_extract_all(p_brand, '[A-Za-z0-9]+') || CASE p_partkey % 4 WHEN 0 THEN ['道路', '改造', '园林', '绿化', '养护'] WHEN 1 THEN ['医院', '设备', '招标', '采购', '购置费']
              WHEN 2 THEN ['改造', '道路', '改造', '升级', '养护'] ELSE ['软件', '平台', '软件', '系统', '软件', '平台', '软件', '系统', '软件', '平台'] END || [p_size::VARCHAR] AS words FROM part)
    SELECT p_partkey, array_to_string(list_filter(words, lambda w: length(w) >= 2), '|') AS words FROM t""")
def segmented_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles cut into words by a dictionary, with the synonyms of what they say."""
    k, said = F.col("p_partkey") % 4, F.when
    core = said(k == 0, "道路改造园林绿化养护").when(k == 1, "医院设备，购置费").when(k == 2, "改造道路，升级养护").otherwise("系统；平台")
    rows = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit("："), core, F.lit(" "), F.col("p_size").cast("string")).alias("title"))
    extra = {"升级": 20, "采购": 20, "购置": 5, "系统": 30, "平台": 30, "软件": 20, "招标": 20}
    dictionary = spark.createDataFrame(list((_WORDS | extra).items()), "word string, n int")
    return segment.with_words(rows, "title", dictionary).select("p_partkey", F.array_join("words", "|").alias("words"))
