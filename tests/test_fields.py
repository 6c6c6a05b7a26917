"""Fields by forms, qualifications, favourites, sliding rates and restarted sums on odd and small tables."""

import datetime

from pyspark.sql import functions as F

from gazetta.functions import fields
from gazetta.operators import conversations, matching, qualifications, rates
from tests.test_functions import values


def test_forms_of_pages(spark):
    got = values(spark, fields.page_fields, ["项目预算：5元 采购预算：6万元\n联系地址：某路\n联系电话：1-2", None, "地址：甲街 电话：3\n手机：4"])
    assert (got[0].budget, got[0].phone, got[0].address, got[0].region) == ("6", "1-2", "某路", "重庆市")
    assert got[1].budget is None and got[1].region == "重庆市" and got[1].due is None and (got[2].address, got[2].phone) == ("甲街", "3")
    at = datetime.datetime
    assert values(spark, fields.moment, ["2024年5月6日 9时5分", "2024-05-06 09:05:07", "2024/5/6 23:59", "2024-05-06", "", None]) == [at(2024, 5, 6, 9, 5), at(2024, 5, 6, 9, 5, 7), at(2024, 5, 6, 23, 59), None, None, None]
    assert values(spark, lambda t: fields.line_at(t, ("甲", "乙"), context=30), ["甲短\n乙" + "长" * 40, "无", None]) == ["乙" + "长" * 29, "", ""]
    assert values(spark, fields.region, ["永川区与渝中区", "两江新区"]) == ["渝中区", "两江新区"]


def test_qualifications(spark):
    notices = spark.createDataFrame([(1, "施工一级，软件", None), (2, "", "物业"), (3, None, None), (4, "乙级", "施工")], "id int, text string, title string")
    held = spark.createDataFrame([(1, "某建筑", "建筑", "一级", "有效"), (2, "某软件公司", None, None, "待审核"), (3, "物业保洁", "服务", "二级", "过期"), (4, "软件与施工", "其他", "?", "有效"), (5, None, None, None, None)], "q int, name string, category string, level string, status string")
    needs = qualifications.requirements(notices, "id", "text", "title")
    got = {(r.id, r.q): (r.score, r["class"]) for r in qualifications.matches(needs, held, "q").collect()}
    assert got == {(1, 1): (80, "full"), (1, 4): (60, "partial"), (4, 4): (40, "partial"), (3, 4): (50, "partial")}
    told = {r.id: (r.matched, r.partial, r.missing, r.coverage) for r in qualifications.coverage(needs, held, "q").collect()}
    assert told == {1: (1, 1, "IT", 50.0), 2: (0, 0, "服务", 0.0), 3: (0, 1, "", 0.0), 4: (0, 1, "", 0.0)}
    assert qualifications.coverage(needs, held.where("false"), "q").where("missing <> ''").count() == 2


def test_favourites_and_their_status(spark):
    records = spark.createDataFrame([(1, "u1", "abcdefgh", "n1"), (2, "", "abcdef", None), (3, None, None, "n1"), (4, "u4", "zz", "")], "r int, url string, name string, number string")
    held = spark.createDataFrame([(10, "a", "u1", "other", None), (11, "a", "u9", "abcdef", "n1"), (12, "a", "u9", "abcdefgh", None), (13, "b", "", "", "n1"), (14, None, "u4", "zz", "")], "f int, user string, url string, name string, number string")
    got = sorted((x.r, x.f, x.match_type) for x in matching.favourite_matches(records, held, "r", "f").collect())
    assert got == [(1, 10, "url"), (1, 11, "name_contains"), (1, 13, "project_no"), (2, 11, "name"), (3, 11, "project_no"), (3, 13, "project_no"), (4, 14, "url")]
    states = spark.createDataFrame([(1, "u1", "n", "active"), (2, "u1", "n", "archived"), (3, "", "m", "archived"), (4, None, "m", "archived"), (5, "x", "", "done")], "f int, url string, name string, status string")
    asked = spark.createDataFrame([("u1", "n"), ("zz", "n"), (None, "m"), ("x", None), (None, None)], "url string, name string")
    assert {(r.url, r.name): r.status for r in matching.favourite_status(asked, states, "f").collect()} == {("u1", "n"): "archived", ("zz", "n"): "active", (None, "m"): "archived", ("x", None): "done", (None, None): None}


def test_sliding_rates_over_blocks(spark):
    rows = [(k, t, t % 3 == 0) for k in ("a", None) for t in range(0, 400, 7)] + [("b", 5, True), ("b", None, True)]
    events = spark.createDataFrame(rows, "k string, t int, bad boolean")
    sources = spark.createDataFrame([("a",), ("b",), (None,), ("quiet",)], "k string")
    counts = rates.filled(rates.sliding(events, "k", F.col("t"), F.col("bad"), 10, 50), sources, "k", 0, 44)
    got = {(r.k, r.step): (r.n, r.hits, r.firing) for r in rates.alerts(counts, "k", 50, 0.3, 3, block=8).collect()}
    assert len(got) == 4 * 45

    def plain(k, step):
        mine = [bad for name, t, bad in rows if name == k and t is not None and step * 10 - 40 <= t < step * 10 + 10]
        return len(mine), sum(mine)

    for k in ("a", "b", None, "quiet"):
        for step in range(45):
            last = [plain(k, s) for s in range(step - 2, step + 1) if s >= 0]
            assert got[k, step] == (*plain(k, step), len(last) == 3 and all(n and h / n > 0.3 for n, h in last))


def test_restarted_sums(spark):
    rows = [("a", i, float(v)) for i, v in enumerate([5, 5, 1, 30, 2, 2, None or 0, 9])] + [(None, i, 4.0) for i in range(5)] + [("n", 0, None)] + [("long", i, 1.0) for i in range(30_000)]
    got = {(r.k, r.i): (r.part, r.used) for r in conversations.restarted(spark.createDataFrame(rows, "k string, i int, v double").repartition(5), "k", ["i"], "v", 10).collect()}
    expected, now, part, used = {}, 0, 0, 0.0
    for k, i, v in rows:
        v = v or 0.0
        part, used = (1, v) if k != now else (part + 1, v) if used + v > 10 else (part, used + v)
        now = k
        expected[k, i] = (part, used)
    assert got == expected
