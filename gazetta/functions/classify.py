"""Labels and scores of notices from their words, as Column expressions. Dictionaries are parameters with small defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import PROJECT_TYPES, TRADES
from .predicates import any_of

#: Forms that say a tender was called off (fixed values).
ABORTED = (
    r"本项目.*?(?:废标|流标)", r"(?:予以|决定|宣布).{0,10}(?:废标|流标)", r"(?:废标|流标).{0,10}公告", r"终止.{0,5}采购", r"招标失败", r"项目废标的?原因", r"项目终止的?原因",
    r"本次.{0,10}(?:流标|废标)", r"(?:合格|有效|报价).{0,10}供应商.{0,5}不足", r"(?:合格|有效).{0,10}投标人.{0,5}不足", r"废标（终止）原因",
)
#: Regions and their places (fixed values); the first region with a place in the title counts.
REGIONS = {
    "重庆": ("重庆", "重庆市", "主城区", "渝中", "渝北", "南岸", "沙坪坝", "九龙坡", "江北", "大渡口", "巴南", "北碚"),
    "四川": ("四川", "成都", "绵阳", "德阳", "宜宾", "泸州", "南充", "达州", "乐山"),
    "贵州": ("贵州", "贵阳", "遵义", "六盘水", "安顺", "毕节", "铜仁"),
    "云南": ("云南", "昆明", "曲靖", "玉溪", "保山", "昭通", "丽江"),
}
#: Priorities and their words (fixed values).
PRIORITIES = {5: ("紧急", "急迫", "立即", "限时", "今日", "本周"), 4: ("重点", "重大", "优先", "主要"), 3: ("一般", "普通", "常规")}
#: Kinds of failure, each with signals in the message, status codes, action and severity; the first kind that fits counts (fixed values).
FAILURES = (
    ("rate_limit", ("429", "rate limit", "too many requests", "retry-after"), (429,), "backoff_long", "medium"),
    ("ban", ("403", "forbidden", "access denied", "ip blocked", "captcha", "blocked", "banned", "blacklisted", "请验证"), (403, 451), "switch_proxy", "critical"),
    (
        "network_timeout",
        ("timeout", "timed out", "connection reset", "network unreachable", "no route to host", "connection refused", "temporary failure", "econnrefused", "etimedout", "enetunreach"), (), "retry_quick", "low",
    ),
    (
        "parse_error",
        ("selector", "mismatch", "null field", "parse exception", "no element found", "element not found", "attributeerror", "indexerror", "keyerror", "nonetype", "解析失败", "选择器错误", "字段为空"), (), "adapt_selector", "medium",
    ),
    ("server_error", ("500", "502", "503", "504", "internal server error", "bad gateway", "service unavailable", "gateway timeout"), (500, 502, 503, 504), "wait_and_retry", "medium"),
)
#: Signs of a source in its url and the points of its kind (fixed values); other sources get five.
SOURCES = ((("ccgp", "gov.cn", "ggzy", "cqggzy", "公共资源", "政府采购"), 25.0), (("bidding", "ctex", "chinabidding"), 18.0), (("sina", "sohu", "163", "baidu"), 10.0))


def contains_any(text: Column, words) -> Column:
    return any_of([F.contains(text, F.lit(w)) for w in words])


def hits(text: Column, words) -> Column:
    """How many of the words occur."""
    total = F.lit(0)
    for w in words:
        total = total + F.contains(text, F.lit(w)).cast("int")
    return total


def is_aborted(content: Column) -> Column:
    return F.coalesce(content, F.lit("")).rlike("|".join(f"(?:{p})" for p in ABORTED))


def labels(text: Column, rules: list[tuple[str, tuple, tuple]]) -> Column:
    """All labels, in order, of which a positive word occurs and no negative one does; empty without any."""
    found = [F.when(contains_any(text, yes) & ~contains_any(text, no), F.lit(name)) for name, yes, no in rules]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def first_label(text: Column, rules: dict[str, tuple], otherwise: str) -> Column:
    out = F.lit(otherwise)
    for name, words in reversed(list(rules.items())):
        out = F.when(contains_any(text, words), F.lit(name)).otherwise(out)
    return out


def best_label(text: Column, rules: dict[str, tuple], otherwise: str) -> Column:
    """The label with the most words that occur; the first of equals; ``otherwise`` without any."""
    counts = {name: hits(text, words) for name, words in rules.items()}
    most = F.greatest(*counts.values(), F.lit(0))
    out = F.lit(otherwise)
    for name, n in reversed(list(counts.items())):
        out = F.when((n == most) & (most > 0), F.lit(name)).otherwise(out)
    return out


def region(title: Column) -> Column:
    return first_label(title, REGIONS, "全国")


def priority(text: Column, budget_level: Column) -> Column:
    """Highest priority of its words, 3 without any; large budgets add one, 5 at most."""
    level = F.when(contains_any(text, PRIORITIES[5]), 5).when(contains_any(text, PRIORITIES[4]), 4).otherwise(3)
    return F.least(F.lit(5), level + budget_level.isin("超大", "大").cast("int"))


def failure_kind(message: Column, status: Column) -> Column:
    """Struct (kind, action, severity) of an error."""
    out = F.struct(F.lit("unknown").alias("kind"), F.lit("retry_quick").alias("action"), F.lit("low").alias("severity"))
    low = F.lower(F.coalesce(message, F.lit("")))
    for kind, signals, codes, action, severity in reversed(FAILURES):
        fits = contains_any(low, signals) | F.coalesce(status.isin(*codes), F.lit(False)) if codes else contains_any(low, signals)
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), F.lit(action).alias("action"), F.lit(severity).alias("severity"))).otherwise(out)
    return out


def steps(value: Column, scores: list[tuple[float, float]], otherwise: float) -> Column:
    """Score of the first bound that the value reaches."""
    out = F.lit(float(otherwise))
    for bound, score in reversed(scores):
        out = F.when(value >= bound, F.lit(float(score))).otherwise(out)
    return out


_MONEY, _DAY = r"[0-9,.，]+\s*(?:万元|万|元)", r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}"


def quality_parts(title: Column, content: Column, budget: Column, due: Column, published: Column, contact: Column, attachments: Column, nudge: float = 0.0) -> dict[str, Column]:
    """Completeness, freshness, accuracy and richness from 0 to 100, and the weighted total to two places; ``nudge`` is added before
    rounding, where results are compared with another engine's."""
    blank = lambda c: F.coalesce(c, F.lit("")) == ""
    text = F.coalesce(content, F.lit(""))
    size, dated = F.length(text), lambda c: F.coalesce(c, F.lit("")).rlike(_DAY)
    money = F.coalesce(budget, F.lit("")).rlike(_MONEY)
    complete = (
        F.when(blank(title), 0.0).otherwise(F.least(F.lit(10.0), F.when(F.length(title) >= 10, 10.0).otherwise(F.length(title) / 2)))
        + steps(size, [(2000, 15), (1000, 12), (500, 8), (200, 4), (1, 2)], 0)
        + F.when(blank(budget), 0).when(money, 5).otherwise(2) + F.when(blank(due), 0).when(dated(due), 5).otherwise(2)
    )
    fresh = F.when(dated(published), 10).otherwise(0) + F.when(dated(due), 15).otherwise(0)
    letters = F.array_distinct(F.split(F.coalesce(title, F.lit("")), ""))
    overlap = F.size(F.filter(letters, lambda c: F.contains(text, c))) / F.greatest(F.size(letters), F.lit(1))
    odd = ~blank(budget) & ~money & ~(budget.rlike("[0-9]") & ~F.trim(budget).rlike("^[0-9]+$"))
    exact = F.greatest(F.lit(0), 15 - F.when(odd, 5).otherwise(0) - F.when(~blank(due) & ~dated(due), 3).otherwise(0) - F.when(~blank(title) & (size > 100) & (overlap < 0.05), 5).otherwise(0))
    paragraphs = F.size(F.filter(F.split(text, "\n"), lambda p: F.trim(p) != ""))
    names = F.size(F.filter(F.split(F.replace(F.coalesce(contact, F.lit("")), F.lit("，"), F.lit(";")), ";"), lambda p: F.trim(p) != ""))
    rich = F.least(F.lit(8), names * 4) + F.when(attachments >= 3, 7).when(attachments >= 1, 4).otherwise(0) + F.when(paragraphs >= 10, 5).when(paragraphs >= 5, 3).when(paragraphs >= 1, 1).otherwise(0)
    parts = {"completeness": complete / 35 * 100, "freshness": fresh / 25 * 100, "accuracy": exact / 20 * 100, "richness": rich / 20 * 100}
    total = parts["completeness"] * 0.35 + parts["freshness"] * 0.25 + parts["accuracy"] * 0.2 + parts["richness"] * 0.2
    return {k: F.round(v, 2) for k, v in parts.items()} | {"total": F.round(F.least(F.lit(100.0), total) + nudge, 2)}


def quality_issues(parts: dict[str, Column], title: Column) -> Column:
    """What is wrong with a notice, from its quality parts and its title."""
    found = (
        (parts["completeness"] < 60, "内容完整度不足"), (parts["freshness"] < 50, "时效性较差（无有效截止时间）"), (parts["accuracy"] < 60, "信息准确性存疑"), (parts["richness"] < 40, "信息丰富度低（缺少联系方式/附件）"),
        (F.length(F.coalesce(title, F.lit(""))) < 10, "标题过短或缺失"),
    )
    return F.array_compact(F.array(*[F.when(bad, name) for bad, name in found]))


def grade(total: Column) -> Column:
    return F.when(total >= 80, "A").when(total >= 60, "B").when(total >= 40, "C").otherwise("D")


def notice_score(budget_wan: Column, age_days: Column, words: Column, source_url: Column) -> dict[str, Column]:
    """Four parts of at most 25 points, their sum and its priority level."""
    url = F.lower(F.coalesce(source_url, F.lit("")))
    parts = {
        "budget_points": F.when(budget_wan.isNull(), 5.0).otherwise(steps(budget_wan, [(10_000, 25), (1_000, 20), (500, 15), (100, 10)], 5)),
        "urgency_points": F.when(age_days <= 3, 25.0).when(age_days <= 7, 20.0).when(age_days <= 14, 15.0).when(age_days <= 30, 10.0).otherwise(5.0),
        "keyword_points": F.least(F.lit(25.0), words + 10.0),
        "source_points": F.coalesce(*[F.when(contains_any(url, words), points) for words, points in SOURCES], F.lit(5.0)),
    }
    total = parts["budget_points"] + parts["urgency_points"] + parts["keyword_points"] + parts["source_points"]
    return parts | {"total": total, "level": F.when(total >= 80, "P0").when(total >= 60, "P1").when(total >= 40, "P2").otherwise("P3")}


def trade(text: Column) -> Column:
    """The trade of most words in the text, ``其他`` without any."""
    return best_label(text, TRADES, "其他")


def project_types(title: Column, content: Column, seen: int = 500) -> Column:
    """Types of a project from its title and the start of its content, in order; none without a title."""
    text = F.concat(title, F.when(F.coalesce(content, F.lit("")) != "", F.concat(F.lit("\n"), F.left(content, F.lit(seen)))).otherwise(""))
    return F.when(F.coalesce(title, F.lit("")) == "", F.array().cast("array<string>")).otherwise(labels(text, PROJECT_TYPES))
