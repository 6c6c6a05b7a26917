"""Groups of similar titles against the plain walk over all titles in order."""

import math
import random

import pytest

from gazetta.operators import titles


def walk(links, nodes):
    near, head = {n: set() for n in nodes}, {}
    for a, b in links:
        near[a].add(b)
    for n in sorted(nodes):
        if n not in head:
            head[n] = n
            for b in near[n]:
                head.setdefault(b, n)
    return {n: h for n, h in head.items() if n != h}


@pytest.mark.parametrize("seed", range(3))
def test_groups_around_first_titles(spark, seed):
    rng = random.Random(seed)
    links = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(45)}
    found = titles.around_first(spark.createDataFrame(sorted(links), "a bigint, b bigint"))
    assert {r.id: r.head for r in found.collect()} == walk(links, range(40))


def test_no_links(spark):
    assert titles.around_first(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_of_rows(spark):
    rows = [(5, "Road works in Basel"), (2, "road works in basel "), (9, "Road works in Basel north"), (1, None), (3, ""), (7, "School desks"), (8, "?!")]
    out = titles.title_groups(spark.createDataFrame(rows, "id bigint, title string"), "id", "title", 0.7)
    assert {tuple(r) for r in out.collect()} == {(2, 2, 3), (5, 2, 3), (9, 2, 3)}


def test_empty_table(spark):
    assert titles.title_groups(spark.createDataFrame([], "id bigint, title string"), "id", "title").count() == 0


def test_title_groups_equal_walk(spark, sf_dir):
    from gazetta.plans import load, titles as plan

    rows = {r.page_id: (r.title or "").strip(" ").lower() for r in plan._titled(spark, sf_dir).collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    pairs = {(r.a, r.b) for r in load().QUERIES["title_pairs"](spark, sf_dir).collect()}
    heads = walk(pairs, [i for t, i in first.items() if t])
    group = {i: heads.get(first[t], first[t]) for i, t in rows.items() if t}
    sizes = {g: list(group.values()).count(g) for g in group.values()}
    want = {(i, g, sizes[g]) for i, g in group.items() if sizes[g] > 1}
    assert {tuple(r) for r in load().QUERIES["title_groups"](spark, sf_dir).collect()} == want


@pytest.mark.parametrize("held", (7, 16_384))
def test_parts_of_titles_meet(spark, monkeypatch, held):
    monkeypatch.setattr(titles, "HELD", held)
    monkeypatch.setattr(titles, "CELLS", 50)
    rng = random.Random(5)
    said = {i: " ".join(rng.choice(["road", "works", "desk", "north", "basel", "x", "tree", "wall"]) for _ in range(rng.randint(0, 5))) for i in range(60)}
    got = titles.similar_titles(spark.createDataFrame(sorted(said.items()), "id bigint, title string"), 0.6)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # candidates are never rows
    words = {i: [w for w in t.split() if len(w) > 1] for i, t in said.items()}
    df = {w: sum(w in x for x in words.values()) for x in words.values() for w in x}
    vectors = {i: {w: x.count(w) / len(x) * (math.log(61 / (df[w] + 1)) + 1) for w in x} for i, x in words.items() if x}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    dots = {(a, b): sum(x * vectors[b].get(w, 0) for w, x in v.items()) / norm[a] / norm[b] for a, v in vectors.items() for b in vectors if a < b}
    assert {(r.a, r.b): round(r.similarity, 9) for r in got.collect()} == {p: round(s, 9) for p, s in dots.items() if s >= 0.6 - 1e-9}
