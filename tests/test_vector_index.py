"""The inverted file against comparison with every vector."""

import numpy as np
from pyspark.sql import functions as F

from gazetta.operators import vector_index


def brute(rows, queries, k):
    ids, vecs = [i for i, _ in rows], vector_index.unit(np.array([v for _, v in rows], float))
    out = {}
    for q, v in queries:
        scores = np.round(vecs @ vector_index.unit(np.array([v], float))[0], 6)
        out[q] = [(ids[i], scores[i]) for i in sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]]
    return out


def test_recall_on_the_table_of_embeddings(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    index = vector_index.build(table, "vec_id", "embedding")
    assert index.rows.count() == len(rows) == index.rows.select("id").distinct().count() and index.centroids.shape == (45, 64)
    asked = table.where("vec_id % 10 = 3")
    exact = brute(rows, [r for r in rows if r[0] % 10 == 3], 20)
    probes = index.probes_for(20)
    found = index.search(asked, "vec_id", "embedding", 20, probes)
    truth = spark.createDataFrame([(q, i) for q, hits in exact.items() for i, _ in hits], "query bigint, id bigint")
    assert vector_index.recall(found, truth) >= 0.9 and probes < len(index.centroids)
    every = {}
    for r in index.search(asked, "vec_id", "embedding", 20, len(index.centroids)).collect():
        every.setdefault(r["query"], []).append((r.place, r.id, r.score))
    assert {q: [x[1:] for x in sorted(v)] for q, v in every.items()} == exact


def test_clustered_vectors_need_few_lists(spark):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(20, 16))
    rows = [(i, (middles[i % 20] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    table = spark.createDataFrame(rows, "id bigint, v array<double>")
    index = vector_index.build(table, "id", "v", lists=40)
    probes = index.probes_for(10)
    assert probes <= 6
    asked = [rows[i] for i in range(7, 2000, 40)]
    truth = spark.createDataFrame([(q, i) for q, hits in brute(rows, asked, 10).items() for i, _ in hits], "query bigint, id bigint")
    assert vector_index.recall(index.search(spark.createDataFrame(asked, table.schema), "id", "v", 10, probes), truth) >= 0.9


def test_odd_vectors_long_lists_and_changes(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "PART", 50)
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(200)]
    odd = [(900, None), (901, [1.0, None, 2.0, 3.0]), (902, [float("nan")] * 4), (903, [1.0]), (904, [])]
    table = spark.createDataFrame(rows + odd, "id bigint, v array<double>")
    index = vector_index.build(table, "id", "v", lists=6)
    assert index.rows.count() == 500
    asked = table.where("id IN (5, 301, 900, 902, 903)")
    got = {}
    for r in index.search(asked, "id", "v", 25, 6).collect():
        got.setdefault(r["query"], []).append((r.place, r.id, r.score))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute(rows, [rows[5], rows[301]], 25)
    less = index.remove(spark.createDataFrame([(5,), (301,)], "id bigint"))
    more = less.add(spark.createDataFrame([(5, [9.0, 0.0, 0.0, 0.0])], "id bigint, v array<double>"), "id", "v")
    assert less.rows.count() == 498 and more.rows.count() == 499
    first = more.search(spark.createDataFrame([(1, [2.0, 0.0, 0.0, 0.0])], "id bigint, v array<double>"), "id", "v", 1, 6).first()
    assert (first["query"], first.id, first.score) == (1, 5, 1.0)
    none = vector_index.build(table.where("false"), "id", "v")
    assert none.rows.count() == 0 and none.search(table.where("false"), "id", "v").count() == 0
    assert vector_index.recall(none.rows.select(F.lit(1).alias("query"), "id"), none.rows.select(F.lit(1).alias("query"), "id")) == 1.0
