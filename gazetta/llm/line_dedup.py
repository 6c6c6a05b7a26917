"""Removal of boilerplate lines that occur on many sites, by mergeable distinct-count sketches per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, fresh, row_name, settle

#: log2 of the sketch's registers, and its relative standard error.
LG_K = 10
ERROR = 1.04 / 2 ** (LG_K / 2)


def line_key(line: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes of a line without its outer spaces; equal lines have equal pairs."""
    line = F.trim(line)
    return F.xxhash64(line), F.xxhash64(F.lit("line"), line)


def boilerplate_lines(docs: DataFrame, text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """Keys (a, b) of the lines that occur on at least ``min_sites`` distinct sites. Null sites count as one site.

    Sketches of sites are built per line where the lines are and merged by the aggregation, so a line on every page costs
    one sketch a task. A line whose estimate is within four standard errors and one site of the bound is counted exactly
    from its distinct sites; the others are decided by the estimate.
    """
    site = F.coalesce(F.col(site_col).cast("string"), F.lit("\0"))
    lines = docs.select(site.alias("site"), F.explode(F.split(F.col(text_col), "\n")).alias("line")).where(F.trim("line") != "")
    a, b = line_key(F.col("line"))
    lines = lines.select("site", a.alias("a"), b.alias("b"))
    sketched = lines.groupBy("a", "b").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    slack = max(1.0, 4 * ERROR * min_sites)
    found = settle(sketched.where(F.col("sites") >= min_sites - slack))
    near = found.where(F.col("sites") <= min_sites + slack)
    exact = lines.distinct().join(near.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("sites") > min_sites + slack).select("a", "b").unionByName(exact.where(F.col("n") >= min_sites).select("a", "b"))


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10) -> DataFrame:
    """All columns of ``docs`` with the boilerplate lines taken out of the text, plus n_lines and n_removed (bigint).

    A line is what stands between newlines; lines are compared without outer spaces; blank lines are never removed. The
    rest of the text is unchanged, null texts stay null with zero lines. Columns n_lines and n_removed are replaced, others stay.

    Positions of the lines to remove are listed per row, a row being named by hashes of id and text; rows without ids, or of one
    id, have lists of their own, and rows that repeat both have equal lines.
    """
    # Written first, so that the join below is between plain exchanges and a line of many documents can be split.
    found = settle(boilerplate_lines(docs, text_col, site_col, min_sites))
    docs = fresh(docs, "n_lines", "n_removed")
    one, two, bad, kept = free(docs, "_one", "_two", "_bad", "_kept")
    named = docs.withColumns(dict(zip((one, two), row_name(id_col, text_col), strict=True)))
    own = named.select(F.col(one).alias("one"), F.col(two).alias("two"), F.posexplode(F.split(F.col(text_col), "\n")).alias("at", "line")).where(F.trim("line") != "")
    a, b = line_key(F.col("line"))
    hits = own.select("one", "two", "at", a.alias("a"), b.alias("b")).join(found, ["a", "b"])
    lists = hits.groupBy(F.col("one").alias(one), F.col("two").alias(two)).agg(F.collect_set("at").alias(bad))
    out = named.join(lists, [one, two], "left")
    split = F.split(F.col(text_col), "\n")
    # Both lists are bound once; what stays is the difference of two lists of positions, in order.
    left = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(bad))
    lines = F.transform(F.array(F.struct(split.alias("lines"), left.alias("left"))), lambda s: F.transform(s["left"], lambda i: F.get(s["lines"], i)))[0]
    out = out.withColumn(kept, F.when(F.col(bad).isNotNull(), lines))
    none = F.lit(0).cast("bigint")
    out = out.withColumn("n_lines", F.when(F.col(text_col).isNull(), none).otherwise(F.size(split).cast("bigint")))
    out = out.withColumn("n_removed", F.when(F.col(bad).isNull(), none).otherwise(F.size(bad).cast("bigint")))
    text = F.when(F.col(bad).isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return out.withColumn(text_col, text).drop(one, two, bad, kept)
