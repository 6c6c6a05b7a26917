"""Pages by preset, category and budget, keyword suggestions and matches, messages, changes of vectors, one vector a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import selection, vectors
from ..operators import merge, relevance, vector_index
from ..session import settle
from ..sources.tables import read
from .registry import query


@query("""SELECT doc_id, source FROM documents WHERE contains(lower(text), 'and') AND lang = 'en' AND source >= 's'""")
def preset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = selection.with_preset({"keyword": "", "category": "en", "source": ""}, {"keyword": "and", "category": "fr", "source": "s"})
    docs = read(spark, sf_dir, "documents")
    return docs.where(F.contains(F.lower("text"), F.lit(chosen["keyword"])) & (F.col("lang") == chosen["category"]) & (F.col("source") >= chosen["source"])).select("doc_id", "source")


@query("""WITH a AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN '采购结果公告' WHEN 1 THEN '中标候选人公示' ELSE '中标结果公示' END AS info_type, o_totalprice FROM orders)
    SELECT info_type, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM a WHERE info_type IN ('中标候选人公示', '中标结果公示') GROUP BY 1""")
def typed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "采购结果公告").when(k == 1, "中标候选人公示").otherwise("中标结果公示").alias("info_type")
    rows = read(spark, sf_dir, "orders").select(kind, "o_totalprice").where(F.col("info_type").isin(*selection.types_of("工程招投标", "all")))
    return rows.groupBy("info_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("""WITH b AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '面议' WHEN 1 THEN printf('%.2f元', p_retailprice) WHEN 2 THEN '约' || p_partkey || '.5万元' WHEN 3 THEN '1.2.3' END AS budget, p_retailprice FROM part),
    v AS (SELECT *, CASE p_partkey % 5 WHEN 1 THEN round(p_retailprice, 2) WHEN 2 THEN (p_partkey + 0.5) * 10000 ELSE 0 END AS yuan FROM b)
    SELECT p_partkey, budget, yuan FROM v ORDER BY yuan DESC, p_partkey LIMIT 100""")
def budget_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    budget = F.when(k == 0, "面议").when(k == 1, F.concat(F.format_string("%.2f", "p_retailprice"), F.lit("元"))).when(k == 2, F.concat(F.lit("约"), F.col("p_partkey").cast("string"), F.lit(".5万元"))).when(k == 3, "1.2.3")
    rows = read(spark, sf_dir, "part").select("p_partkey", budget.alias("budget")).withColumn("yuan", selection.budget_number(F.col("budget")))
    return rows.orderBy(F.desc("yuan"), "p_partkey").limit(100)


_TITLES = ("道路改造工程设备采购项目", "智慧校园建设", "设备采购", "一个", "道路改造道路改造", "Road works")


@query("""WITH t AS (SELECT ['道路改造工程设备采购项目', '智慧校园建设', '设备采购', '一个', '道路改造道路改造', 'Road works'][p_partkey % 6 + 1] AS keyword, p_brand FROM part),
    k AS (SELECT keyword, count(*) AS frequency, count(DISTINCT p_brand) AS project_count FROM t GROUP BY 1),
    w AS (SELECT *, list_filter(regexp_extract_all(keyword, '[一-龥]{2,4}'), lambda x: x <> '一个') AS a, ['道路改造', '道路改造', '设备采购'] AS c FROM k),
    s AS (SELECT keyword, frequency, project_count, list_sum(list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) * len(list_filter(c, lambda y: y = x))))
                 / (sqrt(list_sum(list_transform(list_distinct(a), lambda x: len(list_filter(a, lambda y: y = x)) ** 2))) * sqrt(5)) AS relevance FROM w WHERE len(a) > 0)
    SELECT keyword, frequency, project_count, round(relevance, 6) AS relevance FROM s WHERE relevance > 0""")
def suggested_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.element_at(F.array(*[F.lit(t) for t in _TITLES]), (F.col("p_partkey") % len(_TITLES) + 1).cast("int"))
    keywords = read(spark, sf_dir, "part").select(title.alias("keyword"), "p_brand").groupBy("keyword").agg(F.count(F.lit(1)).alias("frequency"), F.countDistinct("p_brand").alias("project_count"))
    context = selection.candidate_words(F.lit("道路改造，道路改造：设备采购"))
    return keywords.withColumn("relevance", F.round(selection.bag_cosine(selection.candidate_words(F.col("keyword")), context), 6)).where("relevance > 0")


@query("""WITH m AS (SELECT c_custkey, left(c_name || repeat('x', (c_custkey % 90)::INT), 60) AS name, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '招标公告' END AS kind,
           left(CASE WHEN c_custkey % 4 = 0 THEN left(c_name || repeat('x', (c_custkey % 90)::INT), 60) ELSE c_mktsegment || repeat('y', (c_custkey % 120)::INT) END, 80) AS title FROM customer)
    SELECT c_custkey, '📄 <b>收藏项目有新动态</b>' || chr(10) || '📌 收藏项目：<b>' || name || '</b>' || CASE WHEN kind <> '' THEN chr(10) || '📢 新增类型：<b>' || kind || '</b>' ELSE '' END
        || CASE WHEN title <> name THEN chr(10) || '📝 标题：' || title ELSE '' END || chr(10) || '🔗 <a href="http://x/' || c_custkey || '">查看详情</a>' || chr(10)
        || '<i>匹配方式：' || CASE c_custkey % 2 WHEN 0 THEN '项目编号匹配' ELSE '项目关联' END || '</i>' AS message FROM m""")
def favourite_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    name = F.concat("c_name", F.repeat(F.lit("x"), (k % 90).cast("int")))
    title = F.when(k % 4 == 0, F.left(name, F.lit(60))).otherwise(F.concat("c_mktsegment", F.repeat(F.lit("y"), (k % 120).cast("int"))))
    message = selection.favourite_message(F.lit("📄"), name, F.when(k % 3 == 0, "").otherwise("招标公告"), title, F.concat(F.lit("http://x/"), k.cast("string")), F.when(k % 2 == 0, "project_no").otherwise("other"))
    return read(spark, sf_dir, "customer").select("c_custkey", message.alias("message"))


_WANTED = ("steel bolt", "red copper widget", "nothing like it")


@query(f"""WITH d AS (SELECT p_partkey AS id, unnest(regexp_split_to_array(lower(p_name), '[\\s!-/:-@\\[-`{{-~]+')) AS term FROM part), c AS (SELECT id, term, count(*) AS n FROM d WHERE length(term) >= 2 GROUP BY ALL),
    tf AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM c), df AS (SELECT term, ln((SELECT count(*) FROM part) / (count(*) + 1)::DOUBLE) AS idf FROM tf GROUP BY 1),
    q AS (SELECT k, unnest(string_split(k, ' ')) AS term FROM (SELECT unnest({list(_WANTED)}) AS k)), qc AS (SELECT k, term, count(*) AS n FROM q GROUP BY k, term), qt AS (SELECT k, term, n / sum(n) OVER (PARTITION BY k) AS tf FROM qc),
    qw AS (SELECT k, qt.term, qt.tf * coalesce(idf, 0) AS w FROM qt LEFT JOIN df USING (term)), qn AS (SELECT k, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
    w AS (SELECT id, term, tf * idf AS w FROM tf JOIN df USING (term)), n AS (SELECT id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1),
    s AS (SELECT id, k, round(coalesce(sum(w.w * qw.w) / nullif(any_value(n.norm) * any_value(qn.norm), 0), 0), 6) AS s FROM w JOIN qw USING (term) JOIN n USING (id) JOIN qn USING (k) GROUP BY ALL)
    SELECT id AS p_partkey, coalesce(string_agg(k, '|' ORDER BY k) FILTER (WHERE s >= 0.15), '') AS matched, max(s) AS best FROM s GROUP BY 1""")
def keyword_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    keywords = spark.createDataFrame([(k,) for k in _WANTED], "keyword string")
    found = relevance.keyword_matches(read(spark, sf_dir, "part"), "p_partkey", "p_name", keywords, 0.15)
    return found.select(F.col("id").alias("p_partkey"), F.array_join("matched", "|").alias("matched"), "best")


@query("""WITH s AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0), u AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: -x) AS e FROM embeddings WHERE vec_id % 3 = 0 OR vec_id % 2 = 1),
    m AS (SELECT * FROM u UNION ALL SELECT * FROM s WHERE vec_id NOT IN (SELECT vec_id FROM u)), k AS (SELECT * FROM m WHERE vec_id % 10 <> 4)
    SELECT label, count(*) AS n, round(sum(e[1]), 4) AS first FROM k GROUP BY 1""")
def vector_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))
    incoming = table.where("vec_id % 3 = 0 OR vec_id % 2 = 1").withColumn("e", F.transform("e", lambda x: -x))
    gone = table.where("vec_id % 10 = 4").select("vec_id")
    now = merge.without(merge.apply_delta(table.where("vec_id % 2 = 0"), incoming, "vec_id"), gone, "vec_id")
    return now.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("e")[0]), 4).alias("first"))


@query("""WITH g AS (SELECT p_partkey, p_type, lower(replace(p_type, ' ', '')) AS t FROM part)
    SELECT p_partkey, left(sha256(p_type), 32) AS key, greatest(length(t) - 1, 0) + greatest(length(t) - 2, 0) + greatest(length(t) - 3, 0) AS grams FROM g""")
def once_per_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_type")
    return relevance.once_per_text(rows, "p_type", F.size(vectors.char_grams(F.col("p_type"))), "grams").drop("p_type")


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 1), h AS (SELECT vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, q ORDER BY score DESC, vec_id LIMIT 50)
    SELECT doc_id, source, score FROM h JOIN documents ON doc_id = vec_id""")
def vector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    target = [float(x) for x in table.where("vec_id = 1").first()["embedding"]]  # one query vector
    hits = relevance.nearest(table, F.col("embedding"), F.array(*[F.lit(x) for x in target]), 50, "vec_id")
    return read(spark, sf_dir, "documents").join(hits, F.col("doc_id") == F.col("vec_id")).select("doc_id", "source", "score").orderBy(F.desc("score"), "doc_id")


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS query, v.vec_id AS id, round(list_cosine_similarity(v.e, q.e), 6) AS score FROM v q JOIN v ON q.vec_id % 100 = 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS place FROM s)
    SELECT query, id, score, place::INT AS place, true AS enough FROM k WHERE place <= 20""")
def indexed_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector asks the index for 20, with as many lists as were measured to do and with all; the latter's exact hits, and
    whether the former had nine of ten of them."""
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = table.where("vec_id % 100 = 0")
    index = vector_index.build(table, "vec_id", "embedding")
    found = settle(index.search(asked, "vec_id", "embedding", 20, index.probes_for(20)))
    exact = settle(index.search(asked, "vec_id", "embedding", 20, len(index.centroids)))
    enough = vector_index.recall(found, exact) >= 0.9
    return exact.withColumn("enough", F.lit(enough))
