"""Awards in the text of results: rows of score tables and announcements of a winner, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import parse_amount
from .classify import is_aborted
from .extract import NUMERALS, candidate_awards, let, package_awards, unnumbered_awards, winner_name, winners

#: A row of a score table: rank, bidder, price, any number, score (fixed value).
TABLE_ROW = r"第([一二三四五六七八九十]+|\d+)名\s+(\S+?(?:公司|集团|企业|联合体|事务所|院))\s+([\d.]+)\s+[\d.]+\s+([\d.]+)"
#: How winners and amounts are announced; the first form that is found counts (fixed values).
WINNER_FORMS = (
    r"拟\s*中\s*标\s*人[：:\s]+([^\n]+?)(?=\s*(?:中标金额|工商注册号|组织机构|投诉受理|招标人|社会信用代码|法定代表人|\n|\z))", r"中标人信息[^\n]*\n\s*单位名称\s*([^\n]+)",
    r"(?:中标人|中标单位)(?:\(?单位\)?名称|名称)?[：:]\s*([^\n]{2,80})", r"(?:确定|推荐)\s*中标候选人?[：:]\s*([^\n]{2,80})",
)
AMOUNT_FORMS = (r"中标金额[（(][^）)]*[)）]?\s*([0-9.,]+\s*(?:万元|元))", r"中标金额[：:]?\s*([0-9.,]+\s*(?:万元|元))", r"中标金额[：:]\s*([^\n]{1,80})", r"中标[（(]成交[)）]价[：:]\s*([^\n]{1,80})")
BRACKETED_UNIT = r"中标金额\s*[(（]\s*(万元|元)\s*[)）]\s*([0-9.,]+)"


def table_candidates(content: Column) -> Column:
    """Array of (rank, winner, amount, score) of the rows of a score table."""
    hits = F.regexp_extract_all(F.when(content.rlike("名(?U:\\s)"), content).otherwise(""), F.lit("(?U)" + TABLE_ROW), 0)
    part = lambda x, k: F.regexp_extract(x, "(?U)" + TABLE_ROW, k)

    def row(x: Column) -> Column:
        rank = F.coalesce(part(x, 1).try_cast("int"), F.nullif(F.instr(F.lit(NUMERALS), part(x, 1)), F.lit(0)))
        return F.struct(rank.alias("rank"), winner_name(part(x, 2)).alias("winner"), part(x, 3).try_cast("decimal(18,2)").alias("amount"), part(x, 4).try_cast("decimal(6,2)").alias("score"))

    return F.filter(F.transform(hits, row), lambda x: (x["rank"] > 0) & x["winner"].isNotNull())


def announced_amount(content: Column) -> Column:
    """Amount of a result: a number behind a unit in brackets, else by AMOUNT_FORMS; null without."""
    unit = F.concat(F.nullif(F.regexp_extract(content, BRACKETED_UNIT, 2), F.lit("")), F.regexp_extract(content, BRACKETED_UNIT, 1))
    return let(F.coalesce(unit, *[F.nullif(F.trim(F.regexp_extract(content, f, 1)), F.lit("")) for f in AMOUNT_FORMS]), parse_amount)


def result_awards(content: Column) -> Column:
    """Array of (rank, winner, amount, score) of the announced winners; several are members of one bid, so all rank first."""
    content = F.coalesce(content, F.lit(""))
    found = F.filter(F.array(*[winners(F.regexp_extract(content, f, 1)) for f in WINNER_FORMS]), lambda x: F.size(x) > 0)
    names = F.filter(F.transform(F.coalesce(F.get(found, F.lit(0)), F.array().cast("array<string>")), winner_name), lambda x: x.isNotNull())
    row = lambda amount: lambda x: F.struct(F.lit(1).alias("rank"), x.alias("winner"), amount.alias("amount"), F.lit(None).cast("decimal(6,2)").alias("score"))
    return let(announced_amount(content), lambda amount: F.transform(names, row(amount)))


def awards(content: Column, info_type: Column) -> Column:
    """Array of (rank, winner, amount, score) by the grammar of the type of notice; none for other types and called-off tenders.

    Candidates stand in rows of a score table and under headings that name their rank; lines without a rank are read only where
    there are neither.
    """
    plain = lambda rows, rank: F.transform(rows, lambda x: F.struct(rank(x).alias("rank"), x["winner"].alias("winner"), x["amount"].cast("decimal(18,2)").alias("amount"), F.lit(None).cast("decimal(6,2)").alias("score")))
    ranked = F.concat(table_candidates(content), candidate_awards(content))
    candidates = F.transform(F.array(ranked), lambda x: F.when(F.size(x) > 0, x).otherwise(unnumbered_awards(content)))[0]
    none = F.filter(ranked, lambda x: F.lit(False))
    found = (
        F.when(info_type == "采购结果公告", plain(package_awards(content), lambda x: F.lit(1))).when(info_type == "中标候选人公示", candidates)
        .when(info_type == "中标结果公示", F.transform(result_awards(content), lambda x: F.struct(x["rank"], x["winner"], x["amount"].cast("decimal(18,2)").alias("amount"), x["score"]))).otherwise(none)
    )
    return F.when(F.coalesce(is_aborted(content), F.lit(False)), none).otherwise(found)
