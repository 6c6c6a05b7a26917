"""Sinks with literal contents, queues and caches on small rows, pages of unknown orders."""

from pathlib import Path

from pyspark.sql import functions as F

from gazetta.functions import amounts, extract
from gazetta.operators import merge, ranking
from gazetta.sources import tables


def test_csv_starts_with_a_mark(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "k long, v string").coalesce(1)
    tables.csv_sink(rows, str(tmp_path / "out"), {"value": F.col("v"), "key": F.col("k")}, mark=True)
    text = next(Path(tmp_path / "out").glob("*.csv")).read_bytes()
    assert text.startswith("﻿value,key\n".encode())
    assert b'"a ""b"", c",1\n' in text


def test_totals_of_nothing(spark, tmp_path):
    nothing = spark.createDataFrame([], "k long, v double")
    tables.snapshot_sink(nothing, str(tmp_path), {"n": F.count(F.lit(1)), "total": F.sum("v")})
    assert spark.read.schema("n long, total double").json(str(tmp_path / "totals")).collect() == [(0, None)]


def test_levels_without_lines(spark):
    lines = spark.createDataFrame([], "at timestamp, level string")
    got = tables.levels_of_late(lines, F.col("at"), F.col("level"), ("INFO", "ERROR"), 300).collect()
    assert {tuple(r) for r in got} == {("INFO", 0), ("ERROR", 0)}


def test_every_add_extends_the_stay(spark):
    adds = [(1, "a", 0), (2, "a", 9), (3, "a", 18), (4, "a", 28), (5, "b", 28), (6, None, 1), (7, None, 2), (8, "a", 28)]
    got = merge.admitted(spark.createDataFrame(adds, "id long, url string, at long"), "url", "at", "id", 10).collect()
    assert {r.id for r in got} == {1, 4, 5, 6}


def test_codes_without_changes_stay(spark):
    stored = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, code string")
    changed = spark.createDataFrame([("a",), (None,), ("a",)], "code string")
    assert [r.id for r in merge.affected(stored, changed, "code").collect()] == [1]


def test_unknown_order_is_the_first(spark):
    rows = spark.createDataFrame([(1, None), (2, 5), (3, 7), (4, 7)], "id long, day long")
    orders = {"desc": ("day", True), "asc": ("day", False)}
    ids = lambda asked: [r.id for r in ranking.ordered_page(rows, orders, asked, "id", 1, 10).collect()]
    assert ids("day; drop") == ids(None) == [4, 3, 2, 1]
    assert ids("asc") == [2, 4, 3, 1]


def test_forms_of_budgets_and_urls(spark):
    budgets = [("3亿", 3e8, 3.0), ("约1,200.5万元", 12_005_000.0, 1200.5), ("面议", None, None), ("1.2.3", 1.2, None), (None, None, None)]
    rows = spark.createDataFrame(budgets, "text string, large double, digits double")
    for r in rows.select("*", amounts.amount_in_large_units(F.col("text")).alias("a"), amounts.amount_of_digits(F.col("text")).alias("b")).collect():
        assert (r.a, r.b) == (r.large, r.digits), r.text
    urls = [("/014005/014005002/", "变更公告", ""), ("x?categoryNum=014005002001", "", "变更公告"), ("/014005/014005003/", "", ""), (None, "", "")]
    rows = spark.createDataFrame(urls, "url string, c string, p string")
    for r in rows.select("*", extract.collector_type(F.col("url")).alias("a"), extract.parameter_type(F.col("url")).alias("b")).collect():
        assert (r.a, r.b) == (r.c, r.p), r.url
