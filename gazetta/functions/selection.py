"""What a page of notices shows: presets, types of a category, order by budget, suggested keywords, messages about favourites."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories and the types that belong to them (fixed values).
CATEGORY_TYPES = {"政府采购": ("采购结果公告",), "工程招投标": ("中标候选人公示", "中标结果公示")}
#: Words that are no keywords (fixed values).
STOP_WORDS = ("的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个")
#: How a favourite was recognised (fixed values), and the longest name and title of a message.
MATCH_LABELS = {"url": "URL 精确匹配", "name": "项目名称匹配", "project_no": "项目编号匹配"}
NAME_LENGTH, TITLE_LENGTH = 60, 80


def with_preset(given: dict[str, str], preset: dict[str, str] | None) -> dict[str, str]:
    """Parameters with the preset's values where none was given; without a preset as they are."""
    return {k: v or (preset or {}).get(k, "") for k, v in given.items()}


def types_of(category: str, info_type: str | None = None) -> tuple[str, ...]:
    """Types to show of a category; the one of purchases can't be narrowed. Unknown categories and types raise."""
    if category not in CATEGORY_TYPES:
        raise ValueError(f"category must be one of {', '.join(CATEGORY_TYPES)}")
    types = CATEGORY_TYPES[category]
    if len(types) == 1 or not info_type or info_type == "all":
        return types
    if info_type not in types:
        raise ValueError(f"type must be all or one of {', '.join(types)}")
    return (info_type,)


def budget_number(budget: Column) -> Column:
    """Digits and points of a budget as a number, ten thousand times that if its unit says so; 0 if they are none."""
    digits = F.regexp_replace(F.coalesce(budget, F.lit("")), r"[^0-9.]", "")
    number = F.when(digits.rlike(r"^([0-9]+\.?[0-9]*|\.[0-9]+)$"), digits).cast("double")
    return F.coalesce(number * F.when(F.contains(budget, F.lit("万")), 10_000).otherwise(1), F.lit(0.0))


def candidate_words(text: Column) -> Column:
    """Runs of two to four CJK characters without stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-龥]{2,4}"), 0)
    return F.filter(found, lambda w: ~w.isin(*STOP_WORDS))


def bag_cosine(a: Column, b: Column) -> Column:
    """Cosine of the word counts of two arrays; 0 without a shared word."""
    times = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    squares = lambda words: F.aggregate(F.array_distinct(words), F.lit(0), lambda s, w: s + times(words, w) * times(words, w))
    shared = F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, w: s + times(a, w) * times(b, w))
    return F.coalesce(F.try_divide(shared.cast("double"), F.sqrt(squares(a).cast("double")) * F.sqrt(squares(b).cast("double"))), F.lit(0.0))


def favourite_message(sign: Column, name: Column, info_type: Column, title: Column, url: Column, match_type: Column) -> Column:
    """Message that a favourite has news: long names and titles cut, blank lines and a title that repeats the name left out."""
    name, title = F.left(F.coalesce(name, F.lit("")), F.lit(NAME_LENGTH)), F.left(F.coalesce(title, F.lit("")), F.lit(TITLE_LENGTH))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MATCH_LABELS.items() for x in pair]), match_type), F.lit("项目关联"))
    return F.concat_ws(
        "\n", F.concat(sign, F.lit(" <b>收藏项目有新动态</b>")), F.concat(F.lit("📌 收藏项目：<b>"), name, F.lit("</b>")),
        F.when(F.coalesce(info_type, F.lit("")) != "", F.concat(F.lit("📢 新增类型：<b>"), info_type, F.lit("</b>"))),
        F.when((title != "") & (title != name), F.concat(F.lit("📝 标题："), title)),
        F.concat(F.lit('🔗 <a href="'), F.coalesce(url, F.lit("")), F.lit('">查看详情</a>')), F.concat(F.lit("<i>匹配方式："), label, F.lit("</i>")),
    )
