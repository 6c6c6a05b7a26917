"""Literal cases of extraction, scheduling, sources and sinks."""

from decimal import Decimal
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from gazetta.functions import extract
from gazetta.functions import text as text_functions
from gazetta.operators import conversations, facets, health, matching, relevance, scheduling
from gazetta.sources import tables
from tests.test_functions import values


def test_winner_names(spark):
    cases = {
        "重庆某建设有限公司 资质：一级": "重庆某建设有限公司", "某公司（联合体牵头人：甲）": "某公司", "某设计院&nbsp;业绩：三项": "某设计院", "无": None, "": None, "   ": None, None: None,
        "甲有限公司，企业资质：甲级": "甲有限公司", "甲有限公司 1.中标候选人的资质：CMA": "甲有限公司", "甲有限公司 1．中标候选人的资质：CMA": "甲有限公司", "甲有限公司 公司业绩：道路": "甲有限公司",
        "甲有限公司（联合体：乙公司） 资质等级：二级": "甲有限公司", "甲有限公司 资质：二级 第二中标候选人：乙公司 资质：三级": "甲有限公司", "北京城建联合体有限公司": "北京城建联合体有限公司",
        "资质：建筑工程施工总承包二级": None, "甲有限公司 详见附表": "甲有限公司", "详见": None, "见附": None, "甲&amp;乙有限公司": "甲&乙有限公司", "甲有限公司，建筑工程施工总承包一级": "甲有限公司",
        "甲有限公司 中标候选人资格：甲级": "甲有限公司", "甲有限公司 无 详细描述": "甲有限公司", "甲有限公司 1.": "甲有限公司", "某某": None, "甲店": "甲店", "甲有限公司 企业": "甲有限公司", "长" * 90 + "公司": "长" * 80,
    }
    assert dict(zip(cases, values(spark, extract.winner_name, list(cases)), strict=True)) == cases
    assert values(spark, extract.winners, ["甲公司、乙公司;丙公司：备注,无", "", None, "甲公司 社会信用代码：91500000MA5U000000 法定代表人：某", "甲公司(联合体成员) 电话：1", "企业资质：甲,详见附件", "长" * 60]) == [
        ["甲公司", "乙公司", "丙公司"], [], [], ["甲公司"], ["甲公司"], [], ["长" * 50]]


def test_awards(spark):
    text = "包号：1 供应商名称：甲有限公司 供应商地址：x\n中标（成交）金额：12.5万元\n包号：2\n供应商名称：乙公司\n中标（成交）金额：￥1,000元\n包号：3\n无"
    got = values(spark, extract.package_awards, [text, "", None])
    assert [(x.package_no, x.winner, x.amount) for x in got[0]] == [("1", "甲有限公司", Decimal("125000.00")), ("2", "乙公司", Decimal("1000.00"))] and got[1:] == [[], []]
    text = "三、内容:\n第一中标候选人：甲公司 投标报价：100万元\n评审得分：98.87\n第二中标候选人（名称）：乙公司\n地址：某路\n得分：1.2.3\n第三中标候选人:丙公司"
    got = values(spark, extract.candidate_awards, [text, None, "第六中标候选人：某公司 第十一中标候选人：另一公司 投标报价：3元", "第一中标候选人无"])
    assert [(x.rank, x.winner, x.amount, x.score) for x in got[0]] == [(1, "甲公司", Decimal("1000000.00"), Decimal("98.87")), (2, "乙公司", None, None), (3, "丙公司", None, None)] and got[1] == got[3] == []
    assert [(x.rank, x.amount) for x in got[2]] == [(6, None), (11, Decimal("3.00"))]
    assert values(spark, extract.numeral, ["一", "十", "十二", "二十", "九十九", "", "百", "二三"]) == [1, 10, 12, 20, 99, None, None, None]
    assert [x.winner for x in values(spark, extract.unnumbered_awards, ["中标候选人：甲公司\n投标单位：乙公司"])[0]] == ["甲公司", "乙公司"]


def test_letters_and_links(spark):
    plain = lambda t: sorted(f"{c}{t[:i].count(c)}" for i, c in enumerate(t))
    texts = ["", "a", "aabbbca", "第一 第二 第一", "x" * 50 + "y" * 12]
    assert [sorted(x) for x in values(spark, text_functions.letters, texts)] == [plain(t) for t in texts]
    html = '<a href="/b"><b>B</b></a><a class=x href=\'/a\'>A1</a><a href="">none</a><a href="/b">B2</a> <A HREF = "/c" >C</A><a href="/a">A2</a>'
    assert [(x.href, x.label) for x in values(spark, text_functions.anchors, [html])[0]] == [("/b", "<b>B</b>"), ("/a", "A1"), ("/c", "C")]
    many = "".join(f'<a href="/{i % 3000}">{i}</a>' for i in range(6000))
    assert [(x.href, x.label) for x in values(spark, text_functions.anchors, [many])[0]] == [(f"/{i}", str(i)) for i in range(3000)]


def test_types_and_intents(spark):
    urls = ["http://x/014005/014005002/1.html", "http://x/014001/014001020/", "http://x/014001/014005001/", "", None]
    assert values(spark, extract.info_type, urls) == ["答疑变更", "合同签订基本信息公示", "其他", "其他", "其他"]
    assert values(spark, extract.intent, ["谁中标了，结果公告", "预算金额多少钱", "", None]) == ["中标结果", "预算金额", "招标公告", "招标公告"]
    assert values(spark, lambda c: extract.labelled_field(c, ("联系人", "联系方式")), ["联系方式：张三\n地址：x", "无"]) == ["张三", None]
    assert values(spark, extract.level_named, ["具备壹级资质", "无"]) == ["一级", ""]


def test_timeliness_curve(spark):
    row = lambda h, d, rising=True: spark.range(1).select(scheduling.timeliness(F.lit(h).cast("double"), F.lit(d).cast("double"), rising).alias("t")).first().t
    assert [round(row(None, d), 2) for d in (0, 1, 3, 7, 8)] == [1.0, 0.89, 0.66, 0.2, 0.2] and row(None, None) == 0.3
    assert row(-1, None) == 1.0 and row(200, None) == 0.3 and row(1, None) > row(40, None) and row(1, None, False) < row(40, None, False)


def test_scaling_rules(spark):
    ask = lambda found, rate, trend, hour, odd=False: spark.range(1).select(scheduling.scaling(F.lit(found), F.lit(rate), F.lit(trend), F.lit(odd), F.lit(hour), 50, 10).alias("a")).first().a
    assert [ask(60, 0.9, "rising", 3), ask(60, 0.4, "rising", 3), ask(60, 0.9, "stable", 10), ask(5, 0.9, "falling", 3), ask(5, 0.9, "falling", 10), ask(60, 0.9, "rising", 3, True)] == [
        "scale_up", "scale_down", "scale_up", "scale_down", "maintain", "maintain"]


def test_token_bucket(spark):
    rows = spark.createDataFrame([("a", t) for t in (0.0, 0.1, 0.2, 0.3, 10.0)], "source string, s double")
    assert [(r.asked, r.granted) for r in health.token_bucket(rows, "s", 2, 0.5).collect()] == [(5, 3)]


def test_compaction(spark):
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], "x" * 400) for i in range(8)] + [(2, 0, "user", "hi")], "conv_id int, turn int, role string, text string")
    got = sorted((r.conv_id, r.turn, r.role) for r in conversations.compact(turns, 500, 3).collect())
    assert got == [(1, -1, "summary"), (1, 5, "assistant"), (1, 6, "user"), (1, 7, "assistant"), (2, 0, "user")]


def test_first_match_prefers_the_earlier_rule(spark):
    records = spark.createDataFrame([(1, "u1", "n1"), (2, "u9", "n2"), (3, "u9", "n9")], "id int, url string, name string")
    known = spark.createDataFrame([(7, "u1", "n2"), (8, "u2", "n1")], "fav int, f_url string, f_name string")
    got = {r.id: (r.fav, r.match_type) for r in matching.first_match(records, known, "id", "fav", [("url", "url", "f_url"), ("name", "name", "f_name")]).collect()}
    assert got == {1: (7, "url"), 2: (7, "name")}


def test_fuzzy_and_jaccard(spark):
    rows = spark.createDataFrame([(1, "Steel bolt M8"), (2, "steel bold"), (3, None), (4, ""), (5, "a red bolt"), (6, "Red"), (7, "reed")], "id int, t string")
    asked = [("Steel bolt", "fuzzy", 0.85), ("red", "partial", 0.8), ("bolt", "exact", 0.5), ("bolt m8", "partial", 0.9)]
    wanted = set()
    for r in rows.collect():
        for k, mode, least in asked:
            word, t = k.lower(), (r.t or "").lower()
            ratio = SequenceMatcher(None, word, t).ratio()
            if mode != "partial":
                score = 1.0 if word in t else ratio if mode == "fuzzy" and ratio >= least else None
            else:
                score = 1.0 if len(word) <= 3 and t.startswith(word) else 0.95 if len(word) <= 3 and word in t else ratio if ratio >= least else None
            if t and score is not None:
                wanted.add((r.id, k, round(score, 6)))
    assert {(r.id, r.keyword, round(r.score, 6)) for r in relevance.keyword_scores(rows, "id", "t", asked).collect()} == wanted
    row = spark.range(1).select(relevance.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))).alias("j")).first()
    assert row.j == 0.5


def test_week_grid_is_zero_filled(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:00",), ("2024-01-07 23:59:59",), ("2024-01-08 00:00:00",), (None,)], "at string")
    assert [r.n for r in facets.week_grid(rows, F.to_timestamp("at"), "2024-01-01").orderBy("day").collect()] == [1, 0, 0, 0, 0, 0, 1]


def test_sources_and_sinks(spark, tmp_path):
    a = spark.createDataFrame([("u1", "x"), ("u2", "y")], "url string, title string")
    b = spark.createDataFrame([("u2", 5)], "url string, budget int")
    both = {r.url: (r.source, r.title, r.budget) for r in tables.unify({"a": a, "b": b}, "url").collect()}
    assert both == {"u1": ("a", "x", None), "u2": ("b", None, 5)}
    tables.csv_sink(a, f"{tmp_path}/csv", {"link": F.col("url"), "name": F.col("title")})
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").columns == ["link", "name"]
    tables.ndjson_sink(a, f"{tmp_path}/json")
    assert spark.read.json(f"{tmp_path}/json").count() == 2
    tables.routed_sink(a, f"{tmp_path}/routed", F.when(F.col("url") == "u1", "one").otherwise("other"))
    assert {r.target_table for r in spark.read.parquet(f"{tmp_path}/routed").collect()} == {"one", "other"}
    (tmp_path / "log.txt").write_text("2024-01-01 ERROR boom\nnoise\n2024-01-01 INFO fine\n")
    assert sorted(r.level for r in tables.log_lines(spark, f"{tmp_path}/log.txt", r"^(\S+) (ERROR|INFO) (.*)$", ("day", "level", "said")).collect()) == ["ERROR", "INFO"]


def test_every_package_has_its_award(spark):
    text = "".join(f"包号：{i}\n供应商名称：第{i}有限公司\n中标（成交）金额：{i}元\n" for i in range(1, 1301))
    got = values(spark, extract.package_awards, [text])[0]
    assert [x.package_no for x in got] == [str(i) for i in range(1, 1301)] and got[-1].winner == "第1300有限公司" and got[-1].amount == Decimal("1300.00")
