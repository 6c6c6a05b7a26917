"""Search for similar sets against comparison with every row."""

import random

from pyspark.sql import functions as F

from gazetta.operators import set_search


def plain(rows, asked, k):
    out = set()
    for q, mine in rows:
        mine = {w for w in mine or () if w is not None}
        if not asked(q) or not mine:
            continue
        scored = []
        for i, other in rows:
            other = {w for w in other or () if w is not None}
            if i != q and mine & other:
                scored.append((-round(len(mine & other) / len(mine | other), 6), i))
        out |= {(q, i, -s, place) for place, (s, i) in enumerate(sorted(scored)[:k], 1)}
    return out


def test_similar_sets_against_every_row(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, rng.choices(words, [60 / (j + 1) for j in range(60)], k=rng.randint(1, 9))) for i in range(260)]
    rows += [(1000 + i, ["common", "w0"]) for i in range(60)] + [(2000, []), (2001, None), (2002, [None]), (2003, ["alone"]), (2004, [None, "w1", "w1"])]
    table = spark.createDataFrame(rows, "i int, words array<string>")
    for k in (3, 20, 400):
        got = {(r["query"], r.id, r.similarity, r.place) for r in set_search.similar_sets(table, "i", F.col("words"), F.col("i") % 7 == 0, k).collect()}
        assert got == plain(rows, lambda q: q % 7 == 0, k)
    assert set_search.similar_sets(table.where("false"), "i", F.col("words"), F.lit(True), 5).count() == 0


def test_all_that_share_enough_words(spark):
    rows = spark.createDataFrame([(k, text) for k, text in enumerate(["a b c", "c b a", "a b d", "a x", None, *["a b"] * 40])], "k long, t string")
    got = {(r.query, r.id): r.similarity for r in set_search.sharing_sets(rows, "k", F.split("t", " "), F.col("k") == 0, 2).collect()}
    assert got == {(0, 1): 1.0, (0, 2): 0.5} | {(0, k): 0.666667 for k in range(5, 45)}
