"""The registered queries of the training-data operators, with oracle SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, filter_audit, language_model, line_dedup, mixing, ngram_join, quality, sharding, spelling, toxicity, vector_search
from .common import read


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.quality(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.item_id", "leak.containment")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_boilerplate(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "text")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.toxicity(docs, read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, t, r, "</s>[INST] ok [/INST]") for t, r in enumerate(("user", "assistant"))], turns.schema)
    return chat.digests(chat.format_windows(turns.unionByName(probe)))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"), keep="largest")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents").select("doc_id")).select("doc_id", "slot", "shard")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(read(spark, sf_dir, "documents").select("doc_id", "text", "lang"), read(spark, sf_dir, "labels"))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.exact_topk(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_decontamination, op3_line_dedup, op4_toxicity, op5_chat_formatting, op6_exact_dedup, op7_ngram_join, op8_sharding,
        op9_mixing, op10_lm_scoring, op11_spelling, op12_filter_audit, op13_exact_topk, pipeline,
    )
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SHINGLES = rf"""
        words AS (SELECT 'd' AS kind, doc_id AS id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') AS t FROM documents
                  UNION ALL SELECT 'b', item_id, regexp_extract_all({_FOLD}, '[^\x20\x09-\x0D]+') FROM benchmark),
        sh AS (SELECT DISTINCT kind, id, len(t) >= 5 AS enough, unnest(CASE WHEN len(t) >= 5 THEN list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' '))
                  WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM words)"""

ORACLE_SQL = {
    "op2_decontamination": f"""
        WITH {_SHINGLES}, n AS (SELECT id, count(*) AS n FROM sh WHERE kind = 'b' AND enough GROUP BY 1),
             hit AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM sh d JOIN sh b ON d.g = b.g AND d.kind = 'd' AND b.kind = 'b' AND b.enough GROUP BY ALL)
        SELECT doc_id, item_id, shared / n::DOUBLE AS containment FROM hit JOIN n ON n.id = item_id WHERE shared / n::DOUBLE >= 0.8
        UNION SELECT d.id, b.id, 1.0 FROM words b JOIN words d ON b.kind = 'b' AND d.kind = 'd' AND len(b.t) BETWEEN 1 AND 4
              AND contains(' ' || array_to_string(d.t, ' ') || ' ', ' ' || array_to_string(b.t, ' ') || ' ')""",
    "op3_line_dedup": """
        WITH lines AS (SELECT doc_id, coalesce(source, chr(1)) AS site, unnest(string_split(text, chr(10))) AS line,
                              generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
             bad AS (SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT site) >= 10),
             marked AS (SELECT l.*, b.line IS NOT NULL AS gone FROM lines l LEFT JOIN bad b ON trim(l.line, ' ') = b.line)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
               coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
        FROM marked GROUP BY doc_id""",
    "op5_chat_formatting": r"""
        WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
             k AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\f\r\x0B]+')) + 4 AS tokens, floor(coalesce(turn, 0) / 512) AS block,
                          12 + length(role) + 1 + length(regexp_replace(text, '([<\[])(~*)(\||/?s>|/?INST\])', '\1~\2\3', 'g')) + 11 AS chars,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM t),
             sys AS (SELECT conv_id, CASE WHEN role = 'system' THEN tokens ELSE 0 END AS held, CASE WHEN role = 'system' THEN chars ELSE 0 END AS sys_chars, role = 'system' AS has FROM k WHERE n = 1),
             m AS (SELECT k.*, held, sys_chars, has, sum(tokens) OVER (PARTITION BY k.conv_id ORDER BY n) AS stop FROM k JOIN sys USING (conv_id)),
             g AS (SELECT conv_id, n, block, n AS win, tokens AS used, 512 AS lim FROM m WHERE n = 1
                   UNION ALL SELECT m.conv_id, m.n, m.block, CASE WHEN c.new THEN m.n ELSE g.win END, CASE WHEN c.new THEN m.tokens ELSE g.used + m.tokens END,
                                    CASE WHEN c.new THEN greatest(416 - held, 1) ELSE g.lim END
                   FROM g JOIN m ON m.conv_id = g.conv_id AND m.n = g.n + 1, LATERAL (SELECT m.block <> g.block OR g.used + m.tokens > g.lim AS new) c),
             w AS (SELECT m.*, win FROM m JOIN g USING (conv_id, n)),
             s AS (SELECT conv_id, win, sum(tokens) AS size, sum(chars) AS own, any_value(held) AS held, any_value(sys_chars) AS sys_chars, any_value(has) AS has, min(stop - tokens) AS begins FROM w GROUP BY ALL),
             h AS (SELECT s.conv_id, s.win, sum(m.chars) AS past FROM s JOIN m ON m.conv_id = s.conv_id AND m.n < s.win AND NOT (m.n = 1 AND s.has)
                   WHERE s.begins - (m.stop - m.tokens) <= least(96, 512 - s.held - s.size) GROUP BY ALL),
             f AS (SELECT conv_id, sum(own + CASE WHEN win > 1 THEN sys_chars ELSE 0 END + coalesce(past, 0))::BIGINT AS formatted_chars, count(*) AS n_windows FROM s LEFT JOIN h USING (conv_id, win) GROUP BY 1),
             d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                          coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
                          sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256 FROM t GROUP BY 1)
        SELECT d.*, formatted_chars, n_windows FROM d JOIN f USING (conv_id)""",
    "op6_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_FOLD} AS norm FROM documents),
             g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM n JOIN g USING (norm)""",
    "op7_ngram_join": f"""
        WITH RECURSIVE {_SHINGLES}, sets AS (SELECT id, md5(string_agg(g, chr(1) ORDER BY g)) AS node, count(*) AS n FROM sh WHERE kind = 'd' GROUP BY 1),
             nodes AS (SELECT node, min(id) AS rep, count(*) AS copies, min(n) AS n FROM sets GROUP BY 1),
             gr AS (SELECT node, g FROM sh JOIN nodes ON kind = 'd' AND id = rep),
             shared AS (SELECT a.node AS x, b.node AS y, count(*) AS c FROM gr a JOIN gr b ON a.g = b.g AND a.node < b.node GROUP BY ALL),
             links AS (SELECT x, y FROM shared JOIN nodes p ON p.node = x JOIN nodes q ON q.node = y WHERE c >= 0.8 * (p.n + q.n - c)),
             sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
             reach AS (SELECT node AS x, node AS y FROM nodes UNION SELECT r.x, s.y FROM reach r JOIN sym s ON s.x = r.y),
             cls AS (SELECT x AS node, min(rep) AS class_id FROM reach JOIN nodes ON nodes.node = y GROUP BY 1),
             deg AS (SELECT x AS node, count(*) AS texts, sum(copies) AS docs FROM sym JOIN nodes ON nodes.node = y GROUP BY 1)
        SELECT d.doc_id, coalesce(class_id, d.doc_id) AS class_id, coalesce(copies - 1, 0) + coalesce(docs, 0)::BIGINT AS n_links, coalesce(texts, 0) AS n_text_links
        FROM documents d LEFT JOIN sets ON d.doc_id = sets.id LEFT JOIN nodes ON nodes.node = sets.node LEFT JOIN cls ON cls.node = sets.node LEFT JOIN deg ON deg.node = sets.node""",
    # The table of slots as text, three hex digits a slot; the rule that fills it is tested on its own.
    "op8_sharding": f"""
        WITH t AS (SELECT '{"".join(f"{s:03x}" for s in sharding.fill_table())}' AS slots),
             d AS (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.TABLE_SIZE} AS slot FROM documents)
        SELECT doc_id, slot, ('0x' || substr(slots, slot * 3 + 1, 3))::INT AS shard FROM d, t""",
    "op9_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
             s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
             w AS (SELECT *, (r - 1) % 3 + 1 AS weight, sum(source_size) OVER () AS total FROM s),
             l AS (SELECT *, (total - coalesce(sum(3 * source_size) OVER before, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
                   FROM w WINDOW before AS (ORDER BY 3.0 * source_size / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
             lv AS (SELECT level FROM l WHERE 3 * source_size >= level * weight ORDER BY 3.0 * source_size / weight, r LIMIT 1),
             t AS (SELECT source, source_size, least((3 * source_size)::DOUBLE, lv.level * weight) AS target FROM w, lv),
             p AS (SELECT d.doc_id, size, source_size, target,
                          CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
                          ('0x' || substr(md5('mix:' || CASE WHEN t.source IS NULL THEN 'true:' ELSE 'false:' || t.source END), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u,
                          row_number() OVER (PARTITION BY t.source ORDER BY length(bin(size::BIGINT)) * 8 + (size::BIGINT >> greatest(length(bin(size::BIGINT)) - 3, 0)),
                              ('0x' || substr(h, 14, 8))::BIGINT % 4096, size, h, d.doc_id) AS k
                   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
             c AS (SELECT *, least(floor(k * rate + u) - floor((k - 1) * rate + u), 3)::BIGINT AS copies FROM p)
        SELECT doc_id, size::BIGINT AS size, source_size, target, copies * size::BIGINT AS taken, copies FROM c""",
    "op11_spelling": r"""
        WITH RECURSIVE run AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w
                   FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')) AS r FROM documents)),
             held AS (SELECT id, w, count(*) AS times FROM run WHERE length(w) >= 7 GROUP BY ALL),
             crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) r(n)),
             h AS (SELECT s.*, xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(id || ':' || w)), '..'), lambda x: ('0x' || x)::BIGINT),
                       lambda c, x: xor(t[xor(c, x) % 256 + 1], c >> 8)), 4294967295) AS h FROM held s, crc),
             cut AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, times FROM h),
             v AS (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY 1 HAVING sum(times) >= 2),
             d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)),
             near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
                      UNION SELECT a.word, b.word, b.n FROM d a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM d a JOIN v b ON a.rest = b.word),
             best AS (SELECT word, count(*) AS n_near, min((-other_n, other)) AS first FROM near GROUP BY 1),
             f AS (SELECT v.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -first[1] >= 10 * n THEN first[2] END AS form, CASE WHEN -first[1] >= 10 * n THEN -first[1] END AS form_n
                   FROM v LEFT JOIN best ON v.word = best.word),
             chain AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM chain c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n::BIGINT AS form_n FROM f JOIN chain c ON c.word = f.word JOIN f e ON e.word = c.root WHERE e.form IS NULL""",
    "op12_filter_audit": r"""
        WITH x AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
             first AS (SELECT text, min(doc_id) AS least FROM x GROUP BY 1),
             w AS (SELECT doc_id, part, x.text, coalesce(doc_id > least, false) AS again, regexp_extract_all(x.text, '[^\x20\x09-\x0D]+') AS words FROM x JOIN first USING (text)),
             m AS (SELECT w.doc_id, part, (CASE WHEN len(words) < 100 THEN 'A' ELSE '' END) || (CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END)
                       || (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END)
                       || (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END) || (CASE WHEN again THEN 'E' ELSE '' END) AS fails FROM w),
             l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY 1),
             g AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(bad), 0) AS bad FROM m LEFT JOIN l ON m.doc_id = l.doc_id GROUP BY ALL),
             k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
             o AS (SELECT a.k || b.k || c.k || d.k || e.k AS filter_order FROM k a JOIN k b ON b.k <> a.k JOIN k c ON c.k NOT IN (a.k, b.k) JOIN k d ON d.k NOT IN (a.k, b.k, c.k)
                   JOIN k e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
             s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[:step - 1] AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
             r AS (SELECT part, filter_order, step, f, sum(CASE WHEN translate(fails, before || f, '') = fails THEN n ELSE 0 END)::BIGINT AS kept,
                       sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN n ELSE 0 END)::BIGINT AS removed,
                       sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') <> fails THEN n ELSE 0 END)::BIGINT AS redundant,
                       sum(CASE WHEN fails = f THEN n ELSE 0 END)::BIGINT AS unique_fails,
                       sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN good ELSE 0 END)::BIGINT AS good_lost,
                       sum(CASE WHEN contains(fails, f) AND translate(fails, before, '') = fails THEN bad ELSE 0 END)::BIGINT AS toxic_lost
                   FROM g, s GROUP BY ALL)
        SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r""",
    "op13_exact_topk": """
        WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS x FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
             s AS (SELECT q.r AS qr, q.vec_id AS query_id, v.vec_id, list_inner_product(q.x, v.x)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.r <> v.r),
             k AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM k WHERE rank <= 20""",
}
