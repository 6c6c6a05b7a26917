"""Literal cases of the scalar functions."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from gazetta.functions import amounts, classify, dates, predicates, text, vectors
from gazetta.operators import dedup, merge, ranking


def values(spark, make, inputs):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r.x for r in frame.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_keywords():
    assert predicates.parse_keywords("  Road, -Bridge  road - tunnel") == (["road"], ["bridge", "tunnel"])
    assert predicates.parse_keywords(None) == ([], [])
    assert predicates.parse_keywords("-") == ([], [])
    assert predicates.parse_keywords("a-b,c，d") == (["a-b", "c", "d"], [])


def test_period():
    assert predicates.period("quarter", 2024, 1) == (date(2024, 1, 1), date(2024, 3, 31), "2024Q1")
    assert predicates.period("quarter", 2024, 4)[1] == date(2024, 12, 31)
    assert predicates.period("year", 2023)[0] == date(2023, 1, 1)
    for bad in (("quarter", 2024, 5), ("custom",), ("month", 2024)):
        with pytest.raises(ValueError):
            predicates.period(*bad)


def test_amounts(spark):
    got = values(spark, amounts.parse_amount, ["12.78元", "1234.56万元", "1,234.56元", "￥12.78", "12.785", "面议", "--", "", None])
    assert got == [Decimal("12.78"), Decimal("12345600.00"), Decimal("1234.56"), Decimal("12.78"), Decimal("12.78"), None, None, None, None]
    assert values(spark, amounts.level, ["6000万", "1000", "100.5", "3", "", None, "1.2.3"]) == ["超大", "大", "中", "小", "小", "小", "小"]
    assert values(spark, amounts.repair_unit, ["150000万元", "12万元", "x", None]) == ["15.00万元", "12万元", "x", None]


def test_project_names(spark):
    got = values(spark, text.project_name, ["某路改造工程二次招标公告", "A 楼（一期）公开招标公告", "设备采购第2次", "", None])
    assert got == ["某路改造工程公告", "a楼一期", "设备", "", ""]
    numbers = values(spark, lambda c: text.project_number(c, F.lit("")), ["项目编号：ABC-123", "x [CQ2024-00012] y", "(ABC12345)", "AB-2024-001 x", "none", None])
    assert numbers == ["ABC-123", "CQ2024-00012", "ABC12345", "AB-2024-001", None, None]
    # The order of the forms decides, not the place in the text.
    several = ["项目编号：AAA-1 招标编号：BBB-2", "招标编号：BBB-2，项目编号：AAA-1", "采购编号：C-1 项目号：P-1，Q-2", "[CQ2024-0001] 编号：N-1", "项目 编码 500001202401 招标编号：X-1"]
    assert values(spark, lambda c: text.project_number(c, F.lit("")), several) == ["BBB-2", "BBB-2", "P-1，Q-2", "N-1", "500001202401"]


def test_masks(spark):
    assert values(spark, text.mask_email, ["tester@example.com", "ab@x.org", "no address", ""]) == ["t***r@example.com", "a***@x.org", "no address", ""]
    assert values(spark, text.mask_phone, ["13812345678", "call 023-12345678 now"])[0] == "138****5678"
    assert text.is_sensitive("contact_phone") and not text.is_sensitive("title")


def test_text(spark):
    assert values(spark, text.squeeze, ["a　 b\n", "", None]) == ["a b", "", None]
    assert values(spark, text.token_estimate, ["", "abcdefgh", "中文中文中文"]) == [1, 2, 4]
    links = values(spark, text.anchors, ['<a href="/x">one</a> <A HREF=\'/y\'>two</A> <a href="/x">again</a>'])[0]
    assert [(x.href, x.label) for x in links] == [("/x", "one"), ("/y", "two")]


def test_dates(spark):
    assert values(spark, dates.parse_date, ["2024-1-5", "2024/03/09 10:00", "2024年3月9日", "soon", "", None]) == [date(2024, 1, 5), date(2024, 3, 9), date(2024, 3, 9), None, None, None]
    assert values(spark, dates.deadline, ["截止 2024年3月9日 9:30", "2024-01-02", "x"]) == ["2024-03-09 09:30", "2024-01-02", None]
    assert values(spark, dates.url_date, ["http://x/20240309/1.html", "http://x/2024/03/09/", "http://x/"]) == [date(2024, 3, 9), date(2024, 3, 9), None]


def test_classes(spark):
    assert values(spark, classify.is_aborted, ["本项目已废标", "招标失败", "中标公告", "", None]) == [True, True, False, False, False]
    assert values(spark, classify.region, ["成都某项目", "重庆市", "其他", ""]) == ["四川", "重庆", "全国", "全国"]
    kinds = values(spark, lambda c: classify.failure_kind(c, F.lit(0)), ["HTTP 502", "read timeout", "?", None])
    assert [k.kind for k in kinds] == ["server_error", "network_timeout", "unknown", "unknown"]


def test_vectors(spark):
    row = spark.range(1).select(vectors.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("c"), vectors.resized(F.array(F.lit(1.0)), 3).alias("r")).first()
    assert abs(row.c - 0.70710678) < 1e-6 and row.r == [1.0, 0.0, 0.0]


def test_upsert_policies(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "", "2")], "url string, c string, d string")
    new = spark.createDataFrame([("a", "", "9"), ("b", "y", None), ("c", "z", "3")], "url string, c string, d string")
    got = {r.url: (r.c, r.d, r.action) for r in merge.upsert(old, new, "url", {"c": "keep_if_blank", "d": "keep_if_null"}).collect()}
    assert got == {"a": ("x", "9", "updated"), "b": ("y", "2", "updated"), "c": ("z", "3", "inserted")}


def test_suppression_counts_from_the_last_sent(spark):
    times = spark.createDataFrame([("u", t) for t in (0, 200, 400, 700)], "user string, s int").withColumn("at", F.timestamp_seconds("s"))
    assert sorted(r.sent_us // 1_000_000 for r in merge.suppress(times, ["user"], "at", 300).collect()) == [0, 400, 700]


def test_duplicates(spark):
    rows = spark.createDataFrame([(1, "某道路工程招标", "10万元", "工程", "2024-01-01"), (2, "某道路工程招标(二次)", "10万元", "工程", "2024-01-02"), (3, "别的", "", "货物", "")], "id int, title string, budget string, kind string, day string")
    assert [(r.a, r.b) for r in dedup.duplicate_pairs(rows, 0.6).collect()] == [(1, 2)]


def test_empty_ranking(spark):
    empty = spark.createDataFrame([], "winner string, project bigint, amount double, score double, day date")
    assert ranking.rank_winners(empty).count() == 0
