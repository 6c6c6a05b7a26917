"""Notices that sites deliver as JSON: pages of a list service, and arrays whose records refer to values by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape of a page of the list service.
ITEM = (
    "struct<id:string, title:string, type:int, createTime:bigint, endTime:bigint, money:string, depict:string, createRegionName:string, budgetOrgName:string, "
    "intentionDetaileList:array<struct<title:string, depict:string, content:string, money:string, catalogName:string, target:string, requirement:string, quantity:string>>, "
    "annex:array<struct<fileName:string, filePath:string, size:bigint>>>"
)
#: Kinds of the service's records (fixed values).
TYPES = {1: "需求调查", 2: "采购意向"}
#: Parts of a detail and their labels, in the order of the text (fixed values).
DETAIL = (("title", "▸ "), ("catalogName", "  品类："), ("money", "  预算："), ("quantity", "  数量："), ("target", "  目标："), ("requirement", "  要求："))


def _said(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def wan(money: Column) -> Column:
    """Budget text in units of 10,000: numbers above 10,000 are single units; what isn't a positive number is blank."""
    number = _said(money).try_cast("double")
    return F.when(number > 10_000, F.format_string("%.2f万元", number / 10_000)).when(number > 0, F.format_string("%.2f万元", number)).otherwise("")


def details(items: Column) -> Column:
    """Text of a list of details: labelled parts on lines of their own, blank lines between details."""

    def one(d: Column) -> Column:
        parts = [F.concat(F.lit(mark), _said(d[name]), F.lit("万元" if name == "money" else "")) for name, mark in DETAIL]
        return F.concat_ws("\n", *parts, F.concat(F.lit("  明细："), F.coalesce(_said(d["depict"]), _said(d["content"]))))

    return F.array_join(F.filter(F.transform(F.coalesce(items, F.array()), one), lambda x: x != ""), "\n\n")


def list_pages(pages: DataFrame, body: str = "value") -> DataFrame:
    """One row per record of the pages (JSON text with ``data.records``): url id, title, type, dates, region, budget, content, files.

    Pages that aren't JSON give no rows, records without an id neither. Times are milliseconds since 1970; 0 is none.
    """
    parsed = F.from_json(body, f"data struct<records:array<{ITEM}>>")
    rows = pages.select(F.explode(parsed["data"]["records"]).alias("r")).select("r.*").where("id <> ''")
    at = lambda c: F.timestamp_millis(F.nullif(F.col(c), F.lit(0)))
    content = F.concat_ws("\n\n", F.concat(F.lit("【项目简介】\n"), _said(F.col("depict"))), F.concat(F.lit("【采购明细】\n"), F.nullif(details(F.col("intentionDetaileList")), F.lit(""))))
    return rows.select(
        F.col("id").alias("source_id"), F.trim("title").alias("title"), F.element_at(F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv]), F.col("type")).alias("info_type"),
        F.to_date(at("createTime")).alias("publish_date"), at("endTime").alias("deadline"), F.col("createRegionName").alias("region"), F.col("budgetOrgName").alias("buyer"),
        wan(F.col("money")).alias("budget"), content.alias("full_content"), F.left(content, F.lit(300)).alias("content_preview"),
        F.transform(F.coalesce("annex", F.array()), lambda a: a["filePath"]).alias("files"),
    )


def referring_records(pages: DataFrame, body: str = "value", key: str = "infoId", needed: tuple[str, ...] = ("categorynum", "title"), fields: tuple[str, ...] = ("infodate", "linkurl")) -> DataFrame:
    """Records of arrays in which an object's integers are positions of their values in the array; one row a key and page.

    The array is parsed once into its elements' own JSON text, so nothing is known of their shapes in advance. Objects without
    the key or a needed field aren't records; of equal keys in a page the first stays. Text that isn't an array gives no rows.
    """
    parts = pages.select(F.from_json(body, "array<string>").alias("_all")).where(F.col("_all").isNotNull())
    rows = parts.select("_all", F.posexplode("_all").alias("_at", "_item")).where(F.col("_item").startswith("{"))

    def value(name: str) -> Column:
        own = F.try_variant_get(F.try_parse_json("_item"), f"$.{name}", "variant")
        place = F.when(F.schema_of_variant(own) == "BIGINT", F.get_json_object("_item", f"$.{name}").try_cast("int"))
        return F.when((place >= 0) & (place < F.size("_all")), F.get("_all", place)).otherwise(F.get_json_object("_item", f"$.{name}"))

    for name in (key, *needed):
        rows = rows.where(F.get_json_object("_item", f"$.{name}").isNotNull())
    found = rows.select(F.xxhash64("_all").alias("_page"), "_at", *[F.trim(F.coalesce(value(f), F.lit(""))).alias(f) for f in (key, *needed, *fields)]).where(F.col(key) != "")
    first = found.groupBy("_page", key).agg(F.min_by(F.struct(*needed, *fields), "_at").alias("r"))
    return first.select(key, "r.*")
