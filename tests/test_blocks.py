"""Sequences in blocks against plain loops: hot and null keys, ties, halos and blocks of a few rows."""

import random

import pytest
from pyspark.sql import functions as F

from gazetta.operators import blocks, health


@pytest.fixture(scope="module")
def events(spark):
    dice = random.Random(4)
    made = [(dice.choice([1, 1, 1, 2, None]), dice.randrange(300), k, dice.random() < 0.6, dice.choice([None, 1.0, 2.5, 30.0])) for k in range(900)]
    return made, spark.createDataFrame(made, "source int, us long, event_id long, ok boolean, response double").repartition(7)


def of_sources(made):
    out = {}
    for row in sorted(made, key=lambda r: (r[1], r[2])):
        out.setdefault(row[0], []).append(row)
    return out


def test_numbers_and_halos(events):
    made, df = events
    known = {r[2]: n for rows in of_sources(made).values() for n, r in enumerate(rows, 1)}
    got = blocks.numbered(df, "source", ["us", "event_id"])
    assert {r.event_id: r.n for r in got.collect()} == known
    cut = blocks.blocked(got, 3, size=10).collect()
    assert sorted(r.event_id for r in cut if r.own) == sorted(known)
    assert {(r.n, r.block) for r in cut if not r.own} == {(n, (n - 1) // 10 + 1) for n in known.values() if (n - 1) % 10 >= 7}


def test_rolling_in_small_blocks(events, monkeypatch):
    made, df = events
    monkeypatch.setattr(health, "LONG", 30)
    monkeypatch.setattr(blocks, "BLOCK", 40)
    got = {r.event_id: r for r in health.rolling(df, ["us", "event_id"]).collect()}
    assert len(got) == len(made)
    for rows in of_sources(made).values():
        failures = 0
        for i, r in enumerate(rows):
            failures = 0 if r[3] else failures + 1
            last = rows[max(0, i - 29):i + 1]
            assert got[r[2]].failures == failures
            assert got[r[2]].rate_long == pytest.approx(sum(x[3] for x in last) / len(last))


def test_running_mean_demand_and_edges(events):
    made, df = events
    running = {r.event_id: r.running for r in health.running_mean(df, "response", ["us", "event_id"]).collect()}
    demand = {r.event_id: r.demand for r in health.demand(df, "us", 25).collect()}
    begun = {r.event_id for r in health.edges(df, ~F.col("ok"), ["us", "event_id"]).collect()}
    for rows in of_sources(made).values():
        for i, r in enumerate(rows):
            known = [x[4] for x in rows[:i + 1] if x[4] is not None]
            assert running[r[2]] == (pytest.approx(sum(known) / len(known)) if known else None)
            assert demand[r[2]] == sum(r[1] - 25 <= x[1] <= r[1] for x in rows)
            assert (r[2] in begun) == (not r[3] and (i == 0 or rows[i - 1][3]))


def test_empty_log(events):
    nothing = events[1].where("false")
    assert health.rolling(nothing, ["us", "event_id"]).count() == 0
    assert health.sustained(nothing, F.col("ok"), "us", 5).count() == 0


def test_latest_is_the_newest_row_of_the_rolling_statistics(spark):
    from pyspark.sql import functions as F

    from gazetta.operators import health

    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("source"), F.col("id").alias("us"), (F.xxhash64("id") % 5 != 0).alias("ok"), (F.abs(F.xxhash64("id")) % 90).cast("double").alias("response"))
    rows = rows.unionByName(spark.createDataFrame([(9, i, i < 2, 1.0) for i in range(7)] + [(8, 1, False, None)], rows.schema))
    columns = ("rate_short", "rate_long", "mean_response", "variation", "trend", "failures")
    whole = {r.source: r.x for r in health.rolling(rows, ["us"]).groupBy("source").agg(F.max_by(F.struct(*columns), "n").alias("x")).collect()}
    quick = {r.source: r for r in health.latest(rows, ["us"]).collect()}
    assert set(whole) == set(quick) == {None, 1, 2, 8, 9} and quick[1].held == 500 and quick[9].held == 7
    for source, r in quick.items():
        assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in ((r[c], whole[source][c]) for c in columns))
