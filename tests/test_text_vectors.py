"""The vectoriser against plain counting."""

import collections
import math
import re

from gazetta.operators import text_vectors


def runs(text):
    t = re.sub(r"\s\s+", " ", (text or "").lower())
    return [t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1)]


def test_against_plain_counting(spark):
    words = "道路 改造 abc 系统 Données x 设备  采购".split(" ")
    texts = [" ".join(words[(i * k) % len(words)] for k in range(1, 2 + i % 7)) for i in range(200)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(500, None), (501, ""), (502, "zz"), (None, texts[3]), (3, texts[3]), (3, "a  b\t\tc")]
    table = spark.createDataFrame(rows, "id int, t string")
    n, df = collections.Counter(), collections.Counter()
    for _, t in rows:
        n.update(runs(t))
        df.update(set(runs(t)))
    kept = sorted(sorted(n, key=lambda g: (-n[g], g))[:40])
    idf = {g: math.log((1 + len(rows)) / (1 + df[g])) + 1 for g in kept}
    model = text_vectors.fit(table, "t", 40)
    assert [r.gram for r in model.features.orderBy("at").collect()] == kept
    got = {(r.id, tuple(round(x, 9) for x in r.vector)) for r in model.vectors(table, "id", "t").collect()}
    expected = set()
    for i, t in rows:
        w = [collections.Counter(runs(t))[g] * idf[g] for g in kept]
        norm = math.sqrt(sum(x * x for x in w)) or 1
        expected.add((i, tuple(round(x / norm, 9) for x in w)))
    assert got == expected
    other = model.vectors(spark.createDataFrame([(1, "道路 改造")], "id int, t string"), "id", "t").first().vector
    assert len(other) == 40 and abs(sum(x * x for x in other) - 1) < 1e-9
    empty = text_vectors.fit(table.where("false"), "t", 5)
    assert empty.vectors(table.where("id = 1"), "id", "t").first().vector == [0.0] * 5


def test_weights_are_made_text_by_text(spark):
    from pyspark.sql import functions as F

    rows = spark.range(5000).select("id", F.concat(F.lit("ab "), (F.col("id") % 7).cast("string")).alias("t"))
    found = text_vectors.fit(rows, "t").weights(rows.unionByName(rows), "id", "t")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan
    lengths = found.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n"))
    assert lengths.count() == 5000 and lengths.where("abs(n - 1) > 1e-9").count() == 0
