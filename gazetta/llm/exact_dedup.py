"""Exact deduplication by sorting whole contents: sampled splitters, external sort, comparison of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold_ascii, settle, shuffle_width

#: Characters of a text's beginning that place it, and the share of a partition from which on a beginning or a text is hot.
LEAD, HOT_SHARE = 64, 0.25


def _hot(counts: DataFrame, limit: float, key: str, name: str) -> DataFrame:
    """(key, name): keys with more than ``limit`` rows and into how many parts of about ``limit`` rows each is dealt."""
    total = counts.groupBy(key).agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return total.select(key, F.ceil(F.col("n") / limit).cast("int").alias(name))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after folding A-Z; null counts as empty. The row with the smallest (or largest) id of
    equal texts stays; among repeated rows of that id exactly one stays. Null ids order last; if all ids of a group are
    null, one of its rows stays and keep_id is null. An empty input gives an empty result.

    Rows are range-partitioned by the first LEAD characters of the normalised text, sorted by the whole text inside a
    partition, and each text is compared in full with its neighbour. The sampled splitters are of bounded length. A beginning
    with more than HOT_SHARE of a partition's rows is dealt to as many parts as that makes, by a hash of the text, so equal
    texts stay together; a single text with as many rows is dealt on by id (by task where ids are null), and the heads of its
    parts are compared in full afterwards. Hot beginnings and texts are fewer than 1 / HOT_SHARE per partition each, so
    those lists are broadcast.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    n = shuffle_width(docs.sparkSession)
    ordered, best = (F.desc_nulls_last, F.max) if keep == "largest" else (F.asc_nulls_last, F.min)
    rows = docs.select(F.col(id_col).alias("doc_id"), fold_ascii(F.col(text_col)).alias("norm")).select("doc_id", "norm", F.substring("norm", 1, LEAD).alias("lead"))
    # The counts only say how to deal: hashes serve as names here, and two texts with one name would merely be dealt alike.
    counts = settle(rows.groupBy(F.xxhash64("norm").alias("h"), F.xxhash64("lead").alias("l")).agg(F.count(F.lit(1)).alias("n")))
    limit = max(2.0, (counts.agg(F.sum("n")).first()[0] or 0) * HOT_SHARE / n)
    leads, texts = _hot(counts, limit, "l", "deals"), _hot(counts, limit, "h", "salts")
    dealt = rows.withColumns({"h": F.xxhash64("norm"), "l": F.xxhash64("lead")}).join(F.broadcast(leads), "l", "left").join(F.broadcast(texts), "h", "left")
    spread = F.when(F.col("doc_id").isNull(), F.xxhash64(F.spark_partition_id())).otherwise(F.xxhash64("doc_id"))
    dealt = dealt.select(
        "doc_id", "norm", "lead", F.when(F.col("deals").isNotNull(), F.pmod("h", "deals")).otherwise(0).alias("deal"),
        F.when(F.col("salts").isNotNull(), F.pmod(spread, F.col("salts")) + 1).otherwise(0).alias("salt"),
    )
    place = ["lead", "deal", "salt"]
    ranged = dealt.repartitionByRange(n, *place)
    order = Window.partitionBy(*place).orderBy("norm", ordered("doc_id"))
    whole = Window.partitionBy(*place, "run")
    runs = (
        ranged.withColumn("head", ~F.lag("norm").over(order).eqNullSafe(F.col("norm")))
        .withColumn("run", F.sum(F.col("head").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", *place, "run", "head", F.sha2("norm", 256).alias("sha"), F.when(F.col("head") & (F.col("salt") > 0), F.col("norm")).alias("norm"))
        .withColumn("best", best("doc_id").over(whole))
        .withColumn("size", F.count(F.lit(1)).over(whole))
        .select("doc_id", "sha", "salt", "run", "head", "norm", "best", "size")
    )
    runs = settle(runs)
    # Parts of one text: their heads, one a part, are compared in full; the other rows take over the result. If all ids are null,
    # the part of least salt keeps its head.
    heads = runs.where("norm is not null")
    merged = heads.groupBy("sha", "norm").agg(best("best").alias("all_best"), F.sum("size").alias("all_size"), F.min(F.struct("salt", "run")).alias("least"))
    merged = heads.select("sha", "norm", "salt", "run").join(merged, ["sha", "norm"]).drop("norm")
    salted = runs.where("salt > 0").drop("norm").join(merged, ["sha", "salt", "run"])
    chosen = F.col("all_best").isNotNull() | (F.struct("salt", "run") == F.col("least"))

    def result(df: DataFrame, keep_id: str, size: str, also: Column) -> DataFrame:
        kept = F.col("head") & F.col("doc_id").eqNullSafe(F.col(keep_id)) & also
        return df.select("doc_id", F.col(keep_id).alias("keep_id"), F.col(size).alias("group_size"), kept.alias("kept"), F.col("sha").alias("text_sha256"))

    return result(runs.where("salt = 0"), "best", "size", F.lit(True)).unionByName(result(salted, "all_best", "all_size", chosen))
