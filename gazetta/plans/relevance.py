"""Classification, scoring, similarity and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import classify, vectors
from ..operators import conversations, dedup, relevance, set_search, text_vectors
from ..sources.tables import read
from .registry import query

_RULES = [("licence", ("licensed", "license"), ("mit",)), ("contact", ("@", "phone"), ()), ("list", (" | ",), ("%%%",))]


@query("""SELECT doc_id, concat_ws(',', CASE WHEN (contains(t, 'licensed') OR contains(t, 'license')) AND NOT contains(t, 'mit') THEN 'licence' END,
       CASE WHEN contains(t, '@') OR contains(t, 'phone') THEN 'contact' END, CASE WHEN contains(t, ' | ') AND NOT contains(t, '%%%') THEN 'list' END) AS labels FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def type_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(classify.labels(F.lower("text"), _RULES), ",").alias("labels"))


_HITS = "contains(t, ' the ')::INT + contains(t, ' and ')::INT + contains(t, ' of ')::INT AS en, contains(t, ' der ')::INT + contains(t, ' und ')::INT + contains(t, ' die ')::INT AS de, contains(t, ' le ')::INT + contains(t, ' et ')::INT + contains(t, ' des ')::INT AS fr"


@query(f"""WITH h AS (SELECT doc_id, {_HITS} FROM (SELECT doc_id, lower(text) AS t FROM documents))
    SELECT doc_id, CASE WHEN greatest(en, de, fr) = 0 THEN 'other' WHEN en = greatest(en, de, fr) THEN 'en' WHEN de = greatest(en, de, fr) THEN 'de' ELSE 'fr' END AS category FROM h""")
def category_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"en": (" the ", " and ", " of "), "de": (" der ", " und ", " die "), "fr": (" le ", " et ", " des ")}
    return read(spark, sf_dir, "documents").select("doc_id", classify.best_label(F.lower("text"), rules, "other").alias("category"))


@query("""WITH m AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'HTTP 503 Service Unavailable' WHEN 1 THEN 'Read timed out' WHEN 2 THEN 'selector missing' ELSE 'oops' END AS msg FROM events)
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'server_error' WHEN 1 THEN 'network_timeout' WHEN 2 THEN 'parse_error' ELSE 'unknown' END AS kind,
           CASE event_id % 4 WHEN 0 THEN 'wait_and_retry' WHEN 1 THEN 'retry_quick' WHEN 2 THEN 'adapt_selector' ELSE 'retry_quick' END AS action FROM m""")
def error_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    message = F.when(k == 0, "HTTP 503 Service Unavailable").when(k == 1, "Read timed out").when(k == 2, "selector missing").otherwise("oops")
    return read(spark, sf_dir, "events").select("event_id", classify.failure_kind(message, F.lit(200)).alias("x")).select("event_id", "x.kind", "x.action")


@query("""
    WITH d AS (SELECT doc_id, text, left(string_split(text, chr(10))[1], 40) AS title, CASE WHEN doc_id % 3 = 0 THEN n_chars || '元' WHEN doc_id % 3 = 1 THEN '' ELSE n_chars::VARCHAR END AS budget,
               CASE WHEN doc_id % 2 = 0 THEN '2024-03-0' || (doc_id % 9 + 1) ELSE '' END AS due, source AS contact, doc_id % 5 AS files FROM documents),
    p AS (SELECT doc_id, CASE WHEN title = '' THEN 0 WHEN length(title) >= 10 THEN 10 ELSE length(title) / 2 END
            + CASE WHEN length(text) >= 2000 THEN 15 WHEN length(text) >= 1000 THEN 12 WHEN length(text) >= 500 THEN 8 WHEN length(text) >= 200 THEN 4 WHEN length(text) >= 1 THEN 2 ELSE 0 END
            + CASE WHEN budget = '' THEN 0 WHEN contains(budget, '元') THEN 5 ELSE 2 END + CASE WHEN due = '' THEN 0 ELSE 5 END AS c,
          10 + CASE WHEN due = '' THEN 0 ELSE 15 END AS f, 15 - CASE WHEN doc_id % 3 = 2 THEN 5 ELSE 0 END AS a,
          4 + CASE WHEN files >= 3 THEN 7 WHEN files >= 1 THEN 4 ELSE 0 END
            + CASE WHEN np >= 10 THEN 5 WHEN np >= 5 THEN 3 WHEN np >= 1 THEN 1 ELSE 0 END AS r
          FROM (SELECT *, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS np FROM d)),
    t AS (SELECT doc_id, round(least(100.0, c / 35.0 * 100 * 0.35 + f / 25.0 * 100 * 0.25 + a / 20.0 * 100 * 0.2 + r / 20.0 * 100 * 0.2) + 1e-9, 2) AS total FROM p)
    SELECT doc_id, total, CASE WHEN total >= 80 THEN 'A' WHEN total >= 60 THEN 'B' WHEN total >= 40 THEN 'C' ELSE 'D' END AS grade FROM t""")
def quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", "text", F.left(F.element_at(F.split("text", "\n"), 1), F.lit(40)).alias("title"), F.when(k % 3 == 0, F.concat(F.col("n_chars").cast("string"), F.lit("元"))).when(k % 3 == 1, "").otherwise(F.col("n_chars").cast("string")).alias("budget"),
        F.when(k % 2 == 0, F.concat(F.lit("2024-03-0"), (k % 9 + 1).cast("string"))).otherwise("").alias("due"), "source", (k % 5).alias("files"))
    c = F.col
    parts = classify.quality_parts(c("title"), c("text"), c("budget"), c("due"), F.lit("2024-01-01"), c("source"), c("files"), nudge=1e-9)
    return docs.select("doc_id", parts["total"].alias("total")).withColumn("grade", classify.grade(c("total")))


@query("""
    WITH o AS (SELECT o_orderkey, o_totalprice / 100 AS wan, DATE '2001-08-01' - o_orderdate::DATE AS age, CASE o_orderstatus WHEN 'F' THEN 'http://www.ccgp.gov.cn/' WHEN 'O' THEN 'http://bidding.example' ELSE '' END AS url, o_orderpriority FROM orders),
    s AS (SELECT o_orderkey, CASE WHEN wan >= 10000 THEN 25 WHEN wan >= 1000 THEN 20 WHEN wan >= 500 THEN 15 WHEN wan >= 100 THEN 10 ELSE 5 END + CASE WHEN age <= 3 THEN 25 WHEN age <= 7 THEN 20 WHEN age <= 14 THEN 15 WHEN age <= 30 THEN 10 ELSE 5 END
        + least(25, 10 + 8 * (contains(o_orderpriority, 'URGENT')::INT + contains(o_orderpriority, 'HIGH')::INT)) + CASE WHEN contains(url, 'ccgp') THEN 25 WHEN contains(url, 'bidding') THEN 18 ELSE 5 END AS total FROM o)
    SELECT o_orderkey, total::DOUBLE AS total, CASE WHEN total >= 80 THEN 'P0' WHEN total >= 60 THEN 'P1' WHEN total >= 40 THEN 'P2' ELSE 'P3' END AS level FROM s""")
def priority_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    age = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    url = F.when(F.col("o_orderstatus") == "F", "http://www.ccgp.gov.cn/").when(F.col("o_orderstatus") == "O", "http://bidding.example").otherwise("")
    parts = classify.notice_score(F.col("o_totalprice") / 100, age, 8 * classify.hits(F.col("o_orderpriority"), ("URGENT", "HIGH")), url)
    return read(spark, sf_dir, "orders").select("o_orderkey", parts["total"].alias("total"), parts["level"].alias("level"))


_TF = """
    w AS (SELECT doc_id AS id, unnest(regexp_split_to_array(lower(text), '[\\s!-/:-@\\[-`{-~]+')) AS term FROM documents),
    c AS (SELECT id, term, count(*) AS n FROM w WHERE length(term) >= 2 GROUP BY ALL), tf AS (SELECT id, term, n / sum(n) OVER (PARTITION BY id) AS tf FROM c),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), nd AS (SELECT count(*) AS nd FROM documents),
    v AS (SELECT id, term, tf * ln(nd / (df + 1)::DOUBLE) AS w FROM tf JOIN df USING (term), nd)"""


@query(f"""WITH {_TF}, norms AS (SELECT id, sqrt(sum(w * w)) AS norm FROM v GROUP BY 1),
    s AS (SELECT q.id AS query, v.id, sum(v.w * q.w) AS dot FROM v JOIN v q USING (term) WHERE q.id % 100 = 0 AND v.id <> q.id GROUP BY ALL),
    r AS (SELECT query, s.id, coalesce(dot / nullif(a.norm * b.norm, 0), 0) AS similarity FROM s JOIN norms a ON a.id = s.id JOIN norms b ON b.id = query)
    SELECT query, id, round(similarity, 6) AS similarity, row_number() OVER (PARTITION BY query ORDER BY round(similarity, 6) DESC, id) AS place FROM r QUALIFY place <= 5""")
def tfidf_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return relevance.similar_texts(docs, "doc_id", "text", F.col("doc_id") % 100 == 0, 5)


@query("""WITH p AS (SELECT p_partkey, list_distinct(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS k FROM part)
    SELECT a.p_partkey AS query, b.p_partkey, round(len(list_intersect(a.k, b.k)) / len(list_distinct(a.k || b.k))::DOUBLE, 6) AS similarity
    FROM p a JOIN p b ON a.p_partkey % 100 = 0 AND a.p_partkey <> b.p_partkey WHERE len(list_intersect(a.k, b.k)) >= 2""")
def jaccard_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts that share two words with every hundredth part."""
    words = F.split(F.concat("p_name", F.lit(" "), "p_type", F.lit(" "), "p_brand"), " ")
    found = set_search.sharing_sets(read(spark, sf_dir, "part"), "p_partkey", words, F.col("p_partkey") % 100 == 0, 2)
    return found.select("query", F.col("id").alias("p_partkey"), "similarity")


@query("""WITH q AS (SELECT embedding FROM embeddings WHERE vec_id = 0), s AS (SELECT vec_id, label, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings e, q)
    SELECT * FROM s ORDER BY score DESC, vec_id LIMIT 20""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    target = table.where("vec_id = 0").select(F.col("embedding").alias("q")).limit(1)
    scored = table.join(F.broadcast(target)).select("vec_id", "label", F.round(vectors.cosine(F.col("embedding"), F.col("q")), 6).alias("score"))
    return scored.orderBy(F.desc("score"), "vec_id").limit(20)


@query("""SELECT vec_id, round(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE)), 6) AS energy FROM embeddings""")
def cosine_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = vectors.resized(F.col("embedding"), 16)
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.dot(cut, cut), 6).alias("energy"))


@query("""WITH g AS (SELECT lower(replace(p_name, ' ', '')) AS t, p_partkey FROM part)
    SELECT p_partkey, greatest(length(t) - 1, 0) + greatest(length(t) - 2, 0) + greatest(length(t) - 3, 0) AS grams FROM g""")
def char_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.size(vectors.char_grams(F.col("p_name"))).alias("grams"))


@query(r"""WITH t AS (SELECT p_partkey, regexp_replace(lower(p_name), '\s\s+', ' ', 'g') AS t FROM part),
    g AS (SELECT p_partkey, substr(t, i, n) AS gram FROM t, (SELECT unnest([2, 3, 4]) AS n), LATERAL (SELECT unnest(range(1, length(t) - n + 2)) AS i)),
    c AS (SELECT p_partkey, gram, count(*) AS n FROM g GROUP BY ALL), f AS (SELECT gram, sum(n) AS n, count(*) AS df FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 256),
    w AS (SELECT p_partkey, gram, c.n * (ln((1 + (SELECT count(*) FROM part)) / (1 + df)) + 1) AS w FROM c JOIN f USING (gram))
    SELECT p_partkey, gram, round(w / sqrt(sum(w * w) OVER (PARTITION BY p_partkey)), 6) AS w FROM w""")
def gram_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    model = text_vectors.fit(rows, "p_name")
    return model.weights(rows, "p_partkey", "p_name").select(F.col("id").alias("p_partkey"), "gram", F.round("w", 6).alias("w"))


@query("""WITH q AS (SELECT label, embedding AS q FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1),
    s AS (SELECT vec_id, max(round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6)) AS best FROM embeddings, q GROUP BY 1)
    SELECT * FROM s WHERE best >= 0.6""")
def semantic_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings")
    first = table.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))).where("n = 1").select(F.col("embedding").alias("q"))
    lists = first.agg(F.collect_list("q").alias("qs"))  # one vector a label, a small fixed set of labels
    best = F.array_max(F.transform("qs", lambda q: F.round(vectors.cosine(F.col("embedding"), q), 6)))
    return table.join(F.broadcast(lists)).select("vec_id", best.alias("best")).where("best >= 0.6")


@query("""WITH c AS (SELECT source AS document, doc_id AS chunk, (doc_id % 97) / 97.0::DOUBLE AS v, (doc_id % 53) / 53.0::DOUBLE AS t FROM documents),
    r AS (SELECT *, 0.7 * v + 0.3 * t AS score, row_number() OVER (PARTITION BY document ORDER BY 0.7 * v + 0.3 * t DESC, chunk) AS n FROM c)
    SELECT document, chunk, round(score, 6) AS score FROM r WHERE n = 1 AND score >= 0.5""")
def best_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("chunk"))
    found = relevance.best_chunks(chunks, "document", "chunk", (F.col("chunk") % 97) / F.lit(97.0), (F.col("chunk") % 53) / F.lit(53.0), 0.5)
    return found.withColumn("score", F.round("score", 6))


#: Matching-blocks ratio of the pairs (k, t) of a table ``pair``: the longest common run, first in k, then in t, and the same left and right of it.
_RATIO = """seg AS (SELECT k, t, k AS a, t AS b, 0 AS m FROM pair
        UNION ALL SELECT s.k, s.t, CASE WHEN side = 0 THEN substr(a, 1, c.i - 1) ELSE substr(a, c.i + c.n) END,
               CASE WHEN side = 0 THEN substr(b, 1, instr(b, substr(a, c.i, c.n)) - 1) ELSE substr(b, instr(b, substr(a, c.i, c.n)) + c.n) END, CASE WHEN side = 0 THEN c.n ELSE 0 END
        FROM (SELECT *, list_max(list_filter(flatten(list_transform(range(1, length(a) + 1), lambda x: list_transform(range(1, length(a) - x + 2), lambda y: [y, -x]))),
                     lambda z: contains(b, substr(a, -z[2], z[1])))) AS best FROM seg WHERE a <> '' AND b <> '') s, LATERAL (SELECT s.best[1] AS n, -s.best[2] AS i) c, (SELECT unnest([0, 1]) AS side) WHERE s.best IS NOT NULL),
    ratio AS (SELECT k, t, 2.0::DOUBLE * sum(m) / (length(k) + length(t)) AS ratio FROM seg GROUP BY k, t)"""
_FUZZY = [("Steel bolt", "fuzzy", 0.5), ("red", "partial", 0.3), ("copper", "exact", 0.8), ("blue steel widget", "partial", 0.6), ("old widgets", "fuzzy", 0.8)]


@query(f"""WITH RECURSIVE w AS (SELECT unnest({[k for k, _, _ in _FUZZY]}) AS keyword, unnest({[m for _, m, _ in _FUZZY]}) AS mode, unnest({[x for _, _, x in _FUZZY]}) AS least), n AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_name <> ''),
    pair AS (SELECT DISTINCT lower(keyword) AS k, t FROM w, n), {_RATIO},
    s AS (SELECT t, keyword, mode, least, ratio, CASE WHEN mode <> 'partial' AND contains(t, k) THEN 1.0 WHEN mode = 'partial' AND length(k) <= 3 AND starts_with(t, k) THEN 1.0 WHEN mode = 'partial' AND length(k) <= 3 AND contains(t, k) THEN 0.95
                 WHEN mode <> 'exact' AND ratio >= least THEN ratio END AS score FROM w JOIN ratio ON k = lower(keyword))
    SELECT p_partkey, keyword, mode, round(score, 6)::DOUBLE AS score FROM part JOIN s ON t = lower(p_name) WHERE score IS NOT NULL""")
def fuzzy_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relevance.keyword_scores(read(spark, sf_dir, "part"), "p_partkey", "p_name", _FUZZY).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE w AS (SELECT unnest(['Old Widgets', 'cold bold', 'ring', 'large rode', 'zzz']) AS keyword, unnest([1, 2, 3, 4, 5]) AS place), n AS (SELECT DISTINCT lower(p_name) AS t FROM part WHERE p_name <> '' AND NOT contains(lower(p_name), 'hot')),
    pair AS (SELECT DISTINCT lower(keyword) AS k, t FROM w, n), {_RATIO}, h AS (SELECT t, keyword, place FROM w JOIN ratio ON k = lower(keyword) WHERE contains(t, k) OR ratio >= 0.8)
    SELECT p_partkey, string_agg(keyword, '|' ORDER BY place) AS matched FROM part JOIN h ON t = lower(p_name) GROUP BY 1""")
def fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles in which a keyword stands, or that are nearly one, without those that hold an excluded word."""
    found = relevance.title_keywords(read(spark, sf_dir, "part"), "p_name", ["Old Widgets", "cold bold", "ring", "large rode", "zzz"], ["HOT"])
    return found.where(F.size("matched") > 0).select("p_partkey", F.array_join("matched", "|").alias("matched"))


@query("""
    WITH t AS (SELECT *, greatest(floor(length(text) / 4.0), 1) AS tokens FROM conversations), s AS (
        SELECT *, sum(tokens) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM t)
    SELECT conv_id, turn, role, text FROM s WHERE NOT (total > 240 AND age > 3)
    UNION ALL SELECT conv_id, min(turn) - 1, 'summary', printf('[%d turns: %d user, %d assistant]', count(*), count(*) FILTER (WHERE role = 'user'), count(*) FILTER (WHERE role = 'assistant'))
    FROM s WHERE total > 240 AND age > 3 GROUP BY conv_id""")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.compact(read(spark, sf_dir, "conversations"), budget=300, keep=3)


def _duplicable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as notices: titles with few forms, budgets with and without unit, days of one month or another."""
    key = F.col("p_partkey")
    title = F.concat_ws(" ", "p_name", "p_brand")
    budget = F.when(key % 7 == 0, "").otherwise(F.concat(F.format_string("%.2f", "p_retailprice"), F.lit("元")))
    day = F.concat(F.lit("2024-0"), (key % 2 + 1).cast("string"), F.lit("-1"), (key % 3).cast("string"))
    return read(spark, sf_dir, "part").select(key.alias("id"), title.alias("title"), budget.alias("budget"), F.col("p_type").alias("kind"), day.alias("day"))


_DUPLICATES = f"""r AS (SELECT p_partkey AS id, p_name || ' ' || p_brand AS title, CASE WHEN p_partkey % 7 <> 0 THEN printf('%.2f', p_retailprice)::DOUBLE END AS yuan, p_type AS kind, '2024-0' || (p_partkey % 2 + 1) || '-1' || p_partkey % 3 AS day FROM part),
    m AS (SELECT x.id AS a, y.id AS b, x.title AS k, y.title AS t, CASE WHEN x.yuan IS NULL AND y.yuan IS NULL THEN 0 WHEN x.yuan IS NULL OR y.yuan IS NULL THEN 0.3 ELSE coalesce(round(least(x.yuan, y.yuan) / nullif(greatest(x.yuan, y.yuan), 0), 3), 0) END AS budget,
              CASE WHEN x.kind = y.kind AND x.kind <> '' THEN 1.0 ELSE 0.0 END AS kind, 0.0 AS url, CASE WHEN x.day = y.day THEN 1.0 WHEN left(x.day, 7) = left(y.day, 7) THEN 0.7 ELSE 0.4 END AS day
          FROM r x JOIN r y ON lower(trim(left(x.title, 6))) = lower(trim(left(y.title, 6))) AND x.id < y.id),
    pair AS (SELECT DISTINCT k, t FROM m), {_RATIO}, q AS (SELECT k, t, CASE WHEN contains(k, t) OR contains(t, k) THEN greatest(round(ratio, 3), 0.85) ELSE round(ratio, 3) END AS title FROM ratio),
    d AS (SELECT a, b, round(0.4 * title + 0.2 * budget + 0.15 * kind + 0.15 * url + 0.1 * day, 3)::DOUBLE AS score, title::DOUBLE AS title, budget::DOUBLE AS budget, kind::DOUBLE AS kind, url::DOUBLE AS url, day::DOUBLE AS day FROM m JOIN q USING (k, t)),
    l AS (SELECT * FROM d WHERE score >= 0.6)"""


@query(f"WITH RECURSIVE {_DUPLICATES} SELECT * FROM l")
def blocked_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_pairs(_duplicable(spark, sf_dir), 0.6)


@query(f"""WITH RECURSIVE {_DUPLICATES}, e AS (SELECT id, lower(trim(left(title, 6))) AS block, row_number() OVER (PARTITION BY lower(trim(left(title, 6))) ORDER BY id) AS n, (SELECT list(a ORDER BY a) FROM l WHERE l.b = r.id) AS near FROM r),
    g AS (SELECT block, n, id, NULL::BIGINT AS head, [id] AS heads FROM e WHERE n = 1
          UNION ALL SELECT e.block, e.n, e.id, c.head, CASE WHEN c.head IS NULL THEN g.heads || [e.id] ELSE g.heads END FROM g JOIN e ON e.block = g.block AND e.n = g.n + 1, LATERAL (SELECT list_filter(coalesce(e.near, []), lambda x: list_contains(g.heads, x))[1] AS head) c)
    SELECT g.id, g.head, score, title, budget, kind, url, day, concat_ws(',', CASE WHEN title >= 0.6 THEN 'title' END, CASE WHEN budget >= 0.8 THEN 'budget' END, CASE WHEN kind >= 1 THEN 'kind' END, CASE WHEN url >= 1 THEN 'url' END, CASE WHEN day >= 0.7 THEN 'day' END) AS matched
    FROM g JOIN l ON l.a = g.head AND l.b = g.id""")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_groups(_duplicable(spark, sf_dir), 0.6)
