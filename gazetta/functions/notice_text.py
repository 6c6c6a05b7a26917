"""Text of notices as sites deliver it: page chrome, repeated titles, previews, dates of publication, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squeeze

_SECTIONS = "政府采购|工程招投标|工程建设|土地交易|矿权交易|国企采购"
_STOPS = r"\s+附件\d|\s+一、|\s+本招标|\s+本采购|\s+采购人|\s+项目信息|\s+项目编号|\s+项目编码|\s+招标公告|\s+采购公告|\s+\d{4}年|\s+（\d{4}|\s+\(\d{4}|\Z"
_PATH = rf"首页\s*[>＞]\s*交易信息\s*[>＞]\s*(?:{_SECTIONS})\s*[>＞][^\n]+?(?={_STOPS})"
#: What page furniture looks like, taken out in this order (fixed values).
CHROME = (
    rf"^\s*{_PATH}", rf"\s*{_PATH}", r"(?s)^\s*APP\s*下载[^\n]*?当前位置[：:]\s*[^\n]*", r"^\s*APP\s*下载[^\n]*", r"信息时间[：:]\s*[\d\-]*\s*", r"字号[：:]\s*小\s*中\s*大\s*",
    r"(?:我要)?打印\s*", r"关闭\s*", r"加入收藏\s*", r"(?:立即|我要)报名\s*", r"附件下载\s*",
    r"主办单位[：:][^\n]*?(?=主办单位|承办单位|技术支持|建议反馈|版权所有|\Z)", r"承办单位[：:][^\n]*", r"(?:技术支持|建议反馈)[：:][^\n]*", r"版权所有[^\n]*", r"国家部委网站[^\n]*",
    r"暂无内容|没有找到|未找到相关|页面不存在|内容已被删除", r"^\s*重庆市公共资源交易网[_\-]重庆市公共资源交易中心\s*",
    r"^\s*您当前的位置[：:]\s*首页\s*[>＞]\s*[^\n]*?(?=我要报名|我要打印|【|项目概况|\Z)", r"^\s*您当前的位置[：:][^\n]*?(?=我要报名|【|项目概况|\Z)",
    r"【\s*字号\s*[大小中\s]+?\s*】\s*", r"本项目保证金支持电子投标保函形式[^\n]*?(?=项目概况|项目内容|\Z)", r"(?m)^(?:\s*【\s*】\s*)+",
    r"(?m)^\s*[\d_]+\s*渝公网安备\s*\d+\s*号\s*", r"(?m)^\s*渝公网安备\s*\d+\s*号\s*", r"(?m)^\s*信息时间\s*[\d\-：:]*\s*", r"\s*项目编号[：:]\s*\d{10,}", r"\s*项目编码[：:]\s*[A-Z0-9]{6,}",
    r"(?:^|\s+)招标公告\s+邀标信息\s+答疑补遗\s+中标候选人公示\s+中标结果公告\s+合同签订基本信息公示\s+合同变更基本信息公示\s+相关公告\s+终止公告", r"(?:^|\s+)采购公告\s+单一来源公示\s+答疑变更\s+采购结果公告",
)
#: Marks of a page without content (fixed values).
EMPTY = ("暂无内容", "没有找到", "未找到相关", "页面不存在", "内容已被删除")
#: Where the body of a page begins, words of its navigation, and what stands below the body (fixed values).
BODY = r"[一二三四五六七八九十]+、|(?:项目编号|项目名称|采购人|招标人|中标人|第一中标候选人)\s*[：:]"
NAVIGATION = (
    "APP下载", "用户手册", "交易监督网", "加入收藏", "注册 登录", "首页 资讯动态", "信息汇总", "产权交易", "工程招投标", "采购公告 单一来源", "答疑补遗", "中标候选人公示",
    "重庆公共资源APP", "渝产权APP", "公众号", "人民法院诉讼资产网",
)
TAIL = (r"请到原网址[^\n]*", r"请点击[^\n]*", r"点击前往[^\n]*", r"请到[^\n]*?下载附件[^\n]*")
#: Names of attached files (fixed value).
FILES = r"(?U)[\w一-鿿（）()【】\[\]_-]+\.(?:pdf|docx|doc|rar|zip|xlsx|xls|csv|7z|tar|gz)\b"


def without(text: Column, patterns: tuple[str, ...], flags: str = "(?U)") -> Column:
    """Take out what the patterns match, one pattern after the other."""
    for pattern in patterns:
        text = F.regexp_replace(text, flags + pattern, "")
    return text


def clean_text(text: Column) -> Column:
    """Text without page furniture, white space squeezed; null becomes blank."""
    return squeeze(without(F.coalesce(text, F.lit("")), CHROME, "(?iuU)"))


def is_empty_page(text: Column) -> Column:
    """Whether a page says that it has no content, or has under thirty characters of it."""
    said = F.lit(False)
    for mark in EMPTY:
        said = said | F.contains(F.coalesce(text, F.lit("")), F.lit(mark))
    return said | (F.length(clean_text(text)) < 30)


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+", "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it stands there."""
    return F.transform(F.array(value), use)[0]


def drop_title(text: Column, title: Column, most_lines: int = 10, most_times: int = 21) -> Column:
    """Text without its title at the start.

    Leading lines that contain the title, or are part of it, go first (blank lines between them too, at most ``most_lines`` in
    all), unless nothing would be left; then the title goes as often as it opens the rest. Later mentions stay. A blank title
    leaves the text as it is; null text becomes blank.
    """
    name = F.regexp_replace(F.coalesce(title, F.lit("")), r"(?U)^\s+|\s+$", "")
    quoted = F.concat(F.lit(r"(?U)^(?:\s*"), F.regexp_replace(name, r"([^\p{L}\p{N}\s])", r"\\$1"), F.lit(rf"){{1,{most_times}}}"))

    def opened(x: Column) -> Column:
        lines = F.split(x["text"], "\n")
        told = lambda b: F.when(b != "", F.contains(b, x["bare"]) | F.contains(x["bare"], b))
        marked = F.transform(lines, lambda line: _once(_bare(line), told))  # null: blank, true: repeats the title
        return _once(F.struct(lines.alias("lines"), marked.alias("marked")), lambda y: _once(below(x["text"], y), lambda rest: cut(x, rest)))

    def below(whole: Column, y: Column) -> Column:
        first = F.array_position(y["marked"], False).cast("int")
        rest = F.when((first > 1) & (first <= most_lines + 1), F.array_join(F.slice(y["lines"], F.greatest(first, F.lit(1)), F.size(y["lines"])), "\n")).otherwise(whole)
        return F.when(F.exists(F.slice(y["marked"], 1, most_lines), lambda m: F.coalesce(m, F.lit(False))), rest).otherwise(whole)

    def cut(x: Column, rest: Column) -> Column:
        end = lambda r: F.when(r == x["text"], x["text"]).otherwise(F.regexp_replace(r, r"(?U)^\s+|\s+$", ""))
        return _once(F.regexp_replace(rest, x["quoted"], F.lit("")), end)

    whole = F.struct(F.coalesce(text, F.lit("")).alias("text"), _bare(name).alias("bare"), quoted.alias("quoted"))
    return _once(whole, lambda x: F.when(x["bare"] == "", x["text"]).otherwise(opened(x)))


def attachment_note(content: Column) -> Column:
    """What a page of attachments holds: how many dates and their range, then the first three file names; blank without either."""
    dates = F.regexp_extract_all(content, F.lit(r"\d{4}-\d{2}-\d{2}"), 0)
    files = F.array_distinct(F.regexp_extract_all(content, F.lit(FILES), 0))
    low, high = F.array_min(dates), F.array_max(dates)
    span = F.when(low == high, low).otherwise(F.concat_ws("~", low, high))
    versions = F.when(F.size(dates) > 0, F.concat(F.lit("包含 "), F.size(dates).cast("string"), F.lit(" 个版本 ("), span, F.lit(")")))
    named = F.when(F.size(files) > 0, F.concat(F.lit("附件: "), F.array_join(F.slice(files, 1, 3), ", "), F.when(F.size(files) > 3, " 等").otherwise("")))
    return F.coalesce(F.concat_ws(" | ", versions, named), F.lit(""))


def preview(content: Column, title: Column, most: int = 500) -> Column:
    """Cleaned text without the title, cut at ``most`` characters with an ellipsis; a note of the attachments if nothing is left."""
    told = lambda text: F.when(text == "", attachment_note(content)).otherwise(text)
    short = lambda text: F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)
    return F.coalesce(_once(_once(drop_title(clean_text(content), title), told), short), F.lit(""))


def site_text(text: Column, most: int | None = None) -> Column:
    """Body of a detail page: style rules go, what precedes the first mark of a body goes if the page opens with navigation,
    then hints at the end and superfluous white space."""
    text = without(text, (r"\.[\w-]+(?:\s+[\w-]+)*\s*\{[^{}]*\}", r"\.[^{}]+\{[^{}]*\}"))
    head, opens = F.left(text, F.lit(200)), F.lit(False)
    for word in NAVIGATION:
        opens = opens | F.contains(head, F.lit(word))
    at = F.regexp_instr(text, F.lit(BODY))
    text = F.when(opens & (at > 0), F.substring(text, at, F.length(text))).otherwise(text)
    text = squeeze(without(text, TAIL))
    return F.left(text, F.lit(most)) if most else text


def div_text(html: Column, name: str) -> Column:
    """Text inside the last div whose class contains ``name`` and that isn't inside another such div; inner divs count; blank without.

    The page is cut before every opening and closing div; the pieces are folded with the depth of divs as the state.
    """
    pieces = F.split(F.coalesce(html, F.lit("")), r"(?i)(?=<div\b)|(?<=</div>)")
    whole = F.transform(pieces, lambda x: F.struct(x.alias("said"), F.when(x.rlike("(?i)^<div\\b"), 1).otherwise(0).alias("opens"), F.when(x.rlike("(?i)</div>$"), 1).otherwise(0).alias("closes")))
    named = rf"""(?i)^<div\b[^>]*\bclass\s*=\s*["'][^"'>]*\Q{name}\E"""
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inside"), F.lit("").alias("now"), F.lit("").alias("found"))

    def step(state: Column, piece: Column) -> Column:
        begins = (state["inside"] == 0) & piece["said"].rlike(named)
        depth = state["depth"] + piece["opens"]
        inside = F.when(begins, depth).otherwise(state["inside"])
        now = F.when(begins, piece["said"]).when(inside > 0, F.concat(state["now"], piece["said"])).otherwise("")
        after = F.greatest(depth - piece["closes"], F.lit(0))
        ends = (inside > 0) & (after < inside)
        return F.struct(after.alias("depth"), F.when(ends, 0).otherwise(inside).alias("inside"), F.when(ends, "").otherwise(now).alias("now"), F.when(ends, now).otherwise(state["found"]).alias("found"))

    return squeeze(F.regexp_replace(F.aggregate(whole, start, step, lambda s: s["found"]), "(?s)<[^>]*>", " "))


def publish_date(content: Column) -> Column:
    """Date of publication in a text: the first valid one behind a label, by order of the labels, else the first date that
    is neither near words of a deadline (ten characters before, twenty behind) nor the end of a range; null without."""
    day, bare = r"(20\d{2}[-年]\d{1,2}+[-月]\d{1,2}+日?)", r"(20\d{2}年\d{1,2}+月\d{1,2}+日|20\d{2}-\d{1,2}+-\d{1,2}+)"
    free = (
        r"(?<!(?:截止|开标|递交|截标|截稿)[\s\S]{0,8})(?<![至~～—][\s\S]{0,2})(?<!到 [\s\S]{0,1})" + bare
        + r"(?![\s\S]{0,18}(?:截止|开标|递交|截标|截稿|时止))(?![\s\S]{0,19}[前后])"
    )
    labelled = [F.regexp_extract_all(content, F.lit(rf"(?U){label}\s*[：:]\s*{day}"), 1) for label in ("发布日期", "公告时间", "公告日期", "日期")]
    found = F.concat(*labelled, F.regexp_extract_all(content, F.lit(free), 1))
    dates = F.transform(found, lambda x: F.coalesce(F.try_to_date(x, "yyyy-M-d"), F.try_to_date(F.regexp_replace(x, "日$", ""), "yyyy年M月d")))
    return F.get(F.filter(dates, lambda x: x.isNotNull()), F.lit(0))
