"""Short overviews of notices by their type: which fields are shown under which mark, and what stands in for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dates import deadline
from .text import squeeze

_DAY = r"(\d{4}[年\-/]\d{1,2}[月\-/]\d{1,2}日?(?:\s*\d{1,2}[时:：]\d{1,2}(?:分|秒)?)?)"
#: Fields of each type of notice: (mark, patterns of which the first with a hit counts, how many hits) (fixed values).
FIELDS = {
    "采购结果公告": (
        ("📦 ", (r"(?:包号|标的|品目)[：:]\s*([^\n]{1,100})",), 5), ("🏢 ", (r"(?:中标|成交)供应商[：:]\s*([^\n]{2,80})",), 5),
        ("💵 ", (r"(?:中标|成交|合同)金额[：:]\s*([^\n]{1,80})",), 5),
    ),
    "招标计划": (
        ("🏗️ 招标人：", (r"招标(?:法人|人|单位)[（(]?\s*盖章[）)]?[：:]\s*([^\n]{2,80})", r"招标(?:人|单位)[：:]\s*([^\n]{2,80})"), 1),
        ("📋 ", (r"(?:招标项目名称|项目名称)[：:]\s*([^\n]{2,100})",), 3), ("⚙️ 招标方式：", (r"招标方式[：:]\s*([^\n]{2,30})",), 1),
        ("📅 ", (r"招标文件计划发布时间[：:]\s*([^\n]{2,50})",), 1),
    ),
    "中标候选人公示": (
        ("🏢 ", (r"(?:第[一二三])?\s*中标候选人[（(]?\s*名称\s*[）)]?[：:]\s*([^\n]{2,80})", r"(?:中标候选人|投标单位)[：:]\s*([^\n]{2,80})"), 5),
        ("💵 ", (r"(?:投标报价|报价)[：:]\s*([^\n]{1,80})",), 5),
    ),
    "中标结果公示": (
        ("🏢 ", (r"(?:中标人|中标单位)[：:]\s*([^\n]{2,80})", r"(?:确定|推荐)\s*中标候选人?\s*[：:]\s*([^\n]{2,80})"), 3), ("💵 ", (r"(?:中标|合同)(?:金额|价)[：:]\s*([^\n]{1,80})",), 3),
    ),
}
#: Words of the lines that stand in where no field is found, tried list by list, with the number of lines, and what is said
#: of a notice without content (fixed values). The blank type serves all others.
LINES = {
    "采购公告": ((("采购公告", "采购项目", "供应商", "资质要求", "预算"),), 4, "无有效采购信息"), "答疑变更": ((("更正", "变更", "修改", "调整"), ("原", "现", "调整")), 8, "无更正内容"),
    "采购结果公告": ((("中标", "成交", "候选", "金额"),), 5, "无结果信息"), "招标计划": ((("招标计划", "招标项目", "招标人", "计划发布"),), 6, "无招标计划信息"),
    "招标公告": ((("招标公告", "招标项目", "投标文件", "资质要求", "工期", "评标"),), 5, "无有效招标信息"),
    "答疑补遗": ((("补遗", "答疑", "变更", "澄清", "修改", "问：", "答："), ("问：", "答：", "补充", "调整")), 8, "无补遗内容"), "中标候选人公示": ((("中标候选", "报价", "投标", "候选人"),), 5, "无候选人信息"),
    "中标结果公示": ((("中标", "结果", "成交", "金额"),), 5, "无结果信息"), "": ((("公告", "通知", "说明", "公示", "结果"),), 6, "无有效信息"),
}
#: Announcements: business whose section is quoted, headings of that section, patterns of the deadline, further fields (fixed values).
ANNOUNCED = {
    "采购公告": (
        "政府采购", ("一、项目基本情况", "一、项目情况", "一、项目概述", "项目基本情况"),
        (r"(?:投标|响应|报价)截止[：:]\s*(?:投标截止时间[，\s]下同\)?[：:\s=]*)?" + _DAY, r"投标文件递交[^\n]*截止[：:]\s*" + _DAY, r"截止[：:]\s*" + _DAY),
        (("📋 采购方式：", (r"(?:采购方式|采购组织形式)[：:]\s*(公开招标|竞争性磋商|竞争性谈判|询价采购|单一来源|邀请招标)", r"(?:本次|该)采购采?用?([^\n]{2,30}(?:招标|磋商|谈判|询价|单一来源))"), 1),),
    ),
    "招标公告": (
        "工程建设", ("2.项目概况与招标范围", "二、项目概况与招标范围", "2.项目概况", "二、项目概况", "项目概况与招标范围"), (r"6\.投标文件递交[^\n]*?" + _DAY, _DAY),
        (("🎯 招标范围：", (r"招标范围[：:]\s*([^\n]{10,300})",), 1),),
    ),
}


def _clean(text: Column) -> Column:
    return squeeze(text)


def field(content: Column, mark: str, patterns: tuple[str, ...], most: int) -> Column:
    """Array of marked values: the first ``most`` hits of the first pattern that has any."""
    hits = F.array().cast("array<string>")
    for pattern in reversed(patterns):
        found = F.filter(F.transform(F.slice(F.regexp_extract_all(content, F.lit(pattern), 1), 1, most), _clean), lambda x: x != "")
        hits = F.when(F.size(found) > 0, found).otherwise(hits)
    return F.transform(hits, lambda x: F.concat(F.lit(mark), F.left(x, F.lit(200))))


def lines_with(content: Column, words: tuple[str, ...], most: int) -> Column:
    """The first lines of five characters or more that contain one of the words."""
    kept = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(x)), lambda x: (F.length(x) >= 5) & F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(x, w)))
    return F.slice(F.transform(kept, _clean), 1, most)


def section(content: Column, headings: tuple[str, ...], most: int = 1500) -> Column:
    """Text from the first heading that occurs, by order of the headings, white space squeezed; null without one."""
    return F.coalesce(*[F.when(F.instr(content, h) > 0, squeeze(F.substring(content, F.instr(content, h), F.lit(most)))) for h in headings])


def _filled(texts: Column) -> Column:
    return F.filter(texts, lambda x: x.isNotNull() & (x != ""))


def _stand_in(kind: str, content: Column, found: Column, cut: bool) -> Column:
    """What was found, else lines by words, else the start of the content (``cut``) or a remark."""
    lists, most, remark = LINES[kind]
    out = F.when((content != "") & F.lit(cut), F.array(squeeze(F.left(content, F.lit(200))))).otherwise(F.array(F.lit(remark)))
    for words in reversed(lists):
        hits = lines_with(content, words, most)
        out = F.when(F.size(hits) > 0, hits).otherwise(out)
    return F.when(F.size(found) > 0, found).otherwise(out)


def _announcement(kind: str, business: Column, budget: Column, due: Column, content: Column) -> Column:
    quoted, headings, dates, further = ANNOUNCED[kind]
    said = F.coalesce(*[F.nullif(F.regexp_extract(content, p, 1), F.lit("")) for p in dates], F.nullif(due, F.lit("")))
    first = F.concat(F.lit("📌 投标截止时间："), deadline(said))
    limit = F.concat(F.lit("💰 最高限价："), F.nullif(_clean(budget), F.lit("")))
    extra = F.concat(*[field(content, *f) for f in further])
    others = F.concat(F.array(limit), extra) if kind == "招标公告" else F.concat(extra, F.array(limit))
    return _filled(F.concat(F.array(first), F.when(business == quoted, F.array(section(content, headings))).otherwise(others)))


def overview(info_type: Column, business: Column, budget: Column, due: Column, content: Column) -> Column:
    """Overview of a notice, one line a field. Announcements: deadline, then the section on the project or method, price limit and
    scope. Results, plans and candidates: their fields. The others, and notices without any field: lines with telling words, else
    the first 200 characters, else a remark. Null inputs count as blank."""
    business, budget, due, content = (F.coalesce(c, F.lit("")) for c in (business, budget, due, content))
    none = F.array().cast("array<string>")
    out = _stand_in("", content, none, True)
    for kind in LINES:
        if not kind:
            continue
        if kind in ANNOUNCED:
            lines = _stand_in(kind, content, _announcement(kind, business, budget, due, content), False)
        else:
            found = F.concat(*[field(content, *f) for f in FIELDS[kind]]) if kind in FIELDS else none
            lines = _stand_in(kind, content, found, True)
        out = F.when(info_type == kind, lines).otherwise(out)
    return F.trim(F.array_join(_filled(out), "\n"))
