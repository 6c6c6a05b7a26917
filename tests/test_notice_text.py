"""Literal cases of page texts, overviews, certificates, award grammars and JSON sources."""

import json
from datetime import date
from decimal import Decimal

from pyspark.sql import functions as F

from gazetta.functions import award_text, certificates, classify, notice_text, overview
from gazetta.operators import health, merge, scheduling
from gazetta.sources import json_pages
from tests.test_functions import values


def test_page_furniture(spark):
    assert values(spark, notice_text.clean_text, ["首页 > 交易信息 > 政府采购 > 某项目 一、项目 打印 关闭 正文　内容", "【】【 】 一、项目号", "版权所有 x", "", None]) == ["一、项目 正文 内容", "一、项目号", "", "", ""]
    assert values(spark, notice_text.is_empty_page, ["暂无内容" + "x" * 60, "短", "正文" * 20, None]) == [True, True, False, True]
    assert values(spark, notice_text.site_text, ["APP下载 首页 .a .b{x:1} 项目编号：1 内容 请点击这里", "正文 请点击这里\n更多", None]) == ["项目编号：1 内容", "正文 更多", None]


def test_titles_are_dropped(spark):
    title = "某 (项目) A+B"
    got = values(spark, lambda c: notice_text.drop_title(c, F.lit(title)), [f"{title}\n\n项目编号：1\n{title}", f"{title} {title} 正文", f"正文 {title}", None, title, f"首页 {title} 页\n正文"])
    assert got == [f"项目编号：1\n{title}", "正文", f"正文 {title}", "", "", "正文"]
    assert values(spark, lambda c: notice_text.drop_title(c, F.lit(None).cast("string")), ["a b"]) == ["a b"]
    assert values(spark, lambda c: notice_text.preview(c, F.lit("标题"), 5), ["标题 标题 一二三四五六", "标题", "", None]) == ["一二三四五...", "", "", ""]


def test_attachments(spark):
    got = values(spark, notice_text.attachment_note, ["2026-01-02 补遗.pdf 2026-01-03 a.doc b.zip c.rar", "2026-01-02", "无", None])
    assert got == ["包含 2 个版本 (2026-01-02~2026-01-03) | 附件: 补遗.pdf, a.doc, b.zip 等", "包含 1 个版本 (2026-01-02)", "", ""]


def test_divs(spark):
    pages = ['<div class="x"><div class="app-detail y">a<div>b</div>c</div>d</div>', "<p>x</p>", None, '<div class="app-detail">open', '<div class="app-detail">1</div><div class="app-detail">2</div>']
    assert values(spark, lambda c: notice_text.div_text(c, "app-detail"), pages) == ["a b c", "", "", "", "2"]


def test_publish_dates(spark):
    cases = {
        "发布日期：2026-06-09 正文": date(2026, 6, 9), "公告时间：2026年6月20日": date(2026, 6, 20), "截止日期：2026-07-15 发布日期：2026-06-10": date(2026, 6, 10), "于 2026年7月1日 14:00 前递交投标文件 ... 2026年6月9日": date(2026, 6, 9),
        "开标时间：2026-07-01 14:00 ... 2026年6月15日": date(2026, 6, 15), "截止：2026-07-15 发布：2026-06-10": date(2026, 6, 10), "递交截止时间：2026-07-15 14:00": None,
        "获取文件期限：2026年6月9日 至 2026年6月16日。 ... 2026年7月1日 14:00 前递交": date(2026, 6, 9), "发布日期：2026-13-01 公告时间：2026年6月3日": date(2026, 6, 3), "": None, "无日期": None,
    }
    assert dict(zip(cases, values(spark, notice_text.publish_date, list(cases)), strict=True)) == cases
    assert values(spark, notice_text.publish_date, [None]) == [None]


def test_overviews(spark):
    cases = [
        ("采购公告", "政府采购", "", "", "投标截止：2026年4月8日9时30分\n一、项目基本情况\n  采购  设备", "📌 投标截止时间：2026-04-08 09:30\n一、项目基本情况 采购 设备"),
        ("采购公告", "x", "10万元", "2026-05-01 10:00", "采购方式：竞争性磋商", "📌 投标截止时间：2026-05-01 10:00\n📋 采购方式：竞争性磋商\n💰 最高限价：10万元"),
        ("招标公告", "x", "5万", "", "招标范围：道路工程施工以及附属设施的建设", "💰 最高限价：5万\n🎯 招标范围：道路工程施工以及附属设施的建设"),
        ("采购结果公告", "", "", "", "包号：1\n成交供应商：甲公司\n成交金额：10万元", "📦 1\n🏢 甲公司\n💵 10万元"),
        ("招标计划", "", "", "", "招标人：某局\n项目名称：路\n项目名称：大桥项目\n招标方式：公开", "🏗️ 招标人：某局\n📋 大桥项目\n⚙️ 招标方式：公开"), ("答疑变更", "", "", "", "现将原内容更正如下\n没有", "现将原内容更正如下"),
        ("中标结果公示", "", "", "", "", "无结果信息"), ("其他", "", "", "", "无关文字", "无关文字"), (None, None, None, None, None, "无有效信息"),
    ]
    frame = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, k string, b string, m string, d string, t string")
    assert [r.x for r in frame.select("i", overview.overview(*map(F.col, "kbmdt")).alias("x")).orderBy("i").collect()] == [c[5] for c in cases]


def test_certificates(spark):
    texts = [
        "企业名称：某建设有限公司\n统一社会信用代码：91500000MA5UABCD1X\n法定代表人：张三\n注册地址：重庆市渝中区某路1号。\n营业执照\n有效期：2020年1月2日至2030年3月4日\n发证机关：某局",
        "姓名：李四\n一级建造师\n注册编号：AB-12345\n有效期至2028-05-06", "公民身份号码 50010119900101123x", None,
    ]
    a, b, c, none = values(spark, certificates.fields, texts)
    assert (a.certificate_type, a.name, a.certificate_no, a.legal_person, a.address, a.valid_from, a.valid_to, a.issuer) == (
        "营业执照", "某建设有限公司", "91500000MA5UABCD1X", "张三", "重庆市渝中区某路1号", "2020-01-02", "2030-03-04", "某局")
    assert (b.certificate_type, b.name, b.title, b.level, b.construction_no, b.valid_to) == ("建造师", "李四", "一级建造师", "一级", "AB-12345", "2028-05-06")
    assert (c.certificate_type, c.id_number) == ("身份证", "50010119900101123X") and none.certificate_type == "资质证书" and none.name is None


def test_award_grammars(spark):
    table = values(spark, award_text.table_candidates, ["第一名 甲公司 71558384.20 1 98.87\n第2名 乙集团 5 6 90", "无", None])
    assert [tuple(x) for x in table[0]] == [(1, "甲公司", Decimal("71558384.20"), Decimal("98.87")), (2, "乙集团", Decimal("5.00"), Decimal("90.00"))] and table[1:] == [[], []]
    texts = ["拟 中 标 人 某园林公司 中标金额 (万元) 3044 工商注册号 9", "中标人信息\n单位名称 甲公司、乙公司\n中标金额（费率、单价等） 1180000.00元", "中标人名称：丙公司\n中标金额：100万元", "", None]
    got = [[(x.winner, x.amount) for x in row] for row in values(spark, award_text.result_awards, texts)]
    assert got == [[("某园林公司", Decimal("30440000.00"))], [("甲公司", Decimal("1180000.00")), ("乙公司", Decimal("1180000.00"))], [("丙公司", Decimal("1000000.00"))], [], []]
    assert values(spark, lambda c: award_text.awards(c, F.lit("中标结果公示")), ["中标人：丙公司\n本次采购招标失败", None]) == [[], []]


def test_json_sources(spark):
    page = {"data": {"records": [{"id": "7", "title": " a ", "type": 2, "createTime": 1700000000000, "money": "1320000", "depict": "简介", "intentionDetaileList": [{"title": "t", "money": "9"}, {"content": "c"}], "annex": [{"filePath": "/x"}]}, {"title": "no id"}]}}
    (row,) = json_pages.list_pages(spark.createDataFrame([(json.dumps(page),), ("bad",), (None,)], "value string")).collect()
    assert (row.source_id, row.title, row.info_type, row.publish_date, row.budget, row.deadline, row.files) == ("7", "a", "采购意向", date(2023, 11, 14), "132.00万元", None, ["/x"])
    assert row.full_content == "【项目简介】\n简介\n\n【采购明细】\n▸ t\n  预算：9万元\n\n  明细：c"
    array = [{"infoId": 1, "categorynum": 2, "title": 3, "infodate": 4}, "id1", "014", "题目", 9, {"infoId": 1, "categorynum": 2, "title": 2}, {"infoId": 99, "categorynum": "7", "title": "x"}, {"infoId": 5}]
    got = json_pages.referring_records(spark.createDataFrame([(json.dumps(array),), ("{}",), ("nope",), (None,)], "value string")).collect()
    assert sorted((r.infoId, r.categorynum, r.title, r.infodate) for r in got) == [("99", "7", "x", ""), ("id1", "014", "题目", "9")]


def test_failures_and_issues(spark):
    kinds = values(spark, lambda c: classify.failure_kind(c, F.lit(0))["kind"], ["HTTP 429", "Captcha required", "ETIMEDOUT", "KeyError: x", "502 Bad Gateway", "oops", None])
    assert kinds == ["rate_limit", "ban", "network_timeout", "parse_error", "server_error", "unknown", "unknown"]
    assert values(spark, lambda c: classify.failure_kind(c, F.lit(451))["action"], ["x"]) == ["switch_proxy"]
    parts = lambda c: classify.quality_parts(c, F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.lit(0))
    assert values(spark, lambda c: classify.quality_issues(parts(c), c), ["一个足够长的项目标题名称", None]) == [
        ["内容完整度不足", "时效性较差（无有效截止时间）", "信息丰富度低（缺少联系方式/附件）"], ["内容完整度不足", "时效性较差（无有效截止时间）", "信息丰富度低（缺少联系方式/附件）", "标题过短或缺失"]]


def test_intervals_and_deferral(spark):
    assert values(spark, lambda c: health.adjusted_interval(F.lit(100.0), c), ["low", "medium", "high", "critical"]) == [100.0, 150.0, 300.0, 600.0]
    assert values(spark, lambda c: scheduling.deferred(F.lit(0.4), c, F.lit(0.2)), ["low", "high", "critical"]) == [None, "high", "critical"]


def test_keys_and_quarantine(spark):
    assert values(spark, lambda c: merge.entity_key(c, F.lit("n")), ["7", "", None]) == ["no:7", "name:n", "name:n"]
    rows = spark.createDataFrame([(1, 5.0), (2, None), (3, -1.0)], "i int, x double")
    assert {r.i: r.reason for r in merge.quarantine(rows, {"x": F.col("x") > 0}).collect()} == {1: None, 2: "x", 3: "x"}


def test_text_is_cleaned_once(spark):
    rows = spark.createDataFrame([("标题 正文", "标题")], "a string, b string").select(notice_text.preview(F.col("a"), F.col("b")).alias("x"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("加入收藏") == 1
