"""Mixing sources to target weights by systematic sampling over prefix sums of expected copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, global_rank, settle

#: Sub-groups of each size class of a source: a hot source with a third of 100 TB leaves about 1 GB to a task of the prefix sums.
BUCKETS = 4096
ADDED = ("size", "source_size", "target", "copies", "taken")


def uniform(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone: 52 bits of the MD5 of its text."""
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))


def size_class(size: str) -> Column:
    """Grows with the column ``size``: bit length and the two bits after the leading one. Sizes of a class differ by a quarter."""
    return F.expr(f"length(bin({size})) * 8 + shiftright({size}, greatest(length(bin({size})) - 3, 0))")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Target size of each source from (sn, s, source_size), in order of (sn, s): weights repeat along that order.

    Targets share the total by weight but stop at ``cap`` times the source's size; what is above is shared again among
    the others. That is one level L with target = min(cap * size, L * weight); each round fixes the sources that are
    above the cap and divides the rest anew. The rounds pass three sums to the driver, not sources.
    """
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    ranked = settle(global_rank(sizes, ["sn", "s"], "rank").withColumn("weight", weight))
    level, capped, full = None, -1, F.col("source_size") * cap
    while True:
        over = F.lit(False) if level is None else full < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(over, full)).alias("fixed"),
            F.sum(F.when(~over, F.col("weight"))).alias("free"), F.count(F.when(over, 1)).alias("n"),
        ).first()
        if row["n"] == capped or not row["free"]:
            break
        capped, level = row["n"], ((row["total"] or 0) - (row["fixed"] or 0)) / row["free"]
    target = F.least(full.cast("double"), F.lit(level or 0.0) * F.col("weight"))
    return ranked.select("sn", "s", "source_size", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """Add size, source_size, target, copies and taken to every row; other columns stay, clashing ones are replaced.

    Size is the number of words (null text: 0). Every document of a source expects target / source_size copies, at most
    ``cap``. Along the source's order (size class, bucket, size, hash of the id) the expected copies are summed, one offset
    that depends on the source alone is added, and the document is emitted once per integer crossed; ordering by size
    keeps the words taken close to the target. Reruns agree. Null sources are one source, ordered last. Rows that repeat an
    id are separate documents next to each other. A source without words has target 0 and no copies.

    A source is dealt to (size class, bucket) blocks; counts are pre-aggregated per block, so no task holds a source.
    """
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = docs.withColumn("_size", size)
    rows = rows.withColumns({
        "_sn": F.col(source_col).isNull(), "_s": F.coalesce(F.col(source_col).cast("string"), F.lit("")),
        "_hash": F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), "_bin": size_class("_size"),
    }).withColumn("_bucket", F.conv(F.substring("_hash", 14, 8), 16, 10).cast("bigint") % BUCKETS)
    keys = ["_sn", "_s", "_bin", "_bucket"]
    blocks = settle(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_words")))
    sizes = blocks.groupBy(F.col("_sn").alias("sn"), F.col("_s").alias("s")).agg(F.sum("_words").alias("source_size"))
    targets = source_targets(sizes, weights, cap).select(
        F.col("sn").alias("_sn"), F.col("s").alias("_s"), F.col("source_size").alias("_total"), F.col("target").alias("_target")
    )
    # Prefix sums go over the size classes of a source, then over the buckets of a class; a class carries its source's sums along.
    group = keys[:-1]
    along = lambda by, *at: Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    classes = blocks.groupBy(*group).agg(F.sum("_n").alias("_all")).withColumn("_start", F.sum("_all").over(along(["_sn", "_s"], "_bin")) - F.col("_all"))
    classes = classes.drop("_all").join(targets, ["_sn", "_s"])
    placed = blocks.withColumn("_before", F.sum("_n").over(along(group, "_bucket")) - F.col("_n")).drop("_n", "_words").join(classes, group)
    placed = placed.withColumn("_before", F.col("_before") + F.col("_start")).drop("_start")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("_size", "_hash", F.col(id_col)))
    rows = rows.withColumn("_place", inside).join(placed, keys)
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(0.0)
    offset = uniform(F.concat(F.lit(f"{seed}:"), F.col("_sn").cast("string"), F.lit(":"), F.col("_s")))
    end = F.col("_before") + F.col("_place")
    copies = F.least(F.floor(end * rate + offset) - F.floor((end - 1) * rate + offset), F.lit(cap)).cast("bigint")
    rows = rows.withColumn("_copies", copies)
    own = [c for c in docs.columns if c.lower() not in ADDED]
    return rows.select(
        *[F.col(f"`{c}`") for c in own], F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"),
        F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"),
    )


def repeat_copies(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row once per copy, without the columns that ``mix`` added."""
    repeated = mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return fresh(repeated, "_copy", *ADDED)
