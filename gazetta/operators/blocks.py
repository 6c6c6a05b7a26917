"""Sequences of hot keys in blocks: a key's rows in order are cut into blocks that tasks share, and sums of earlier blocks are carried.

A key may be null; its rows form one sequence. The order must be total where rows are numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle

#: Rows of a block.
BLOCK = 8192


def ranged(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows dealt to ranges of (key, order), whose number is ``part``. Rows equal in both share a range. Written once, so that
    the ranges stay the same when lost tasks are run again."""
    return settle(rows.repartitionByRange(key, *order).withColumn("part", F.spark_partition_id()))


def with_earlier(parts: DataFrame, key: str, **sums: Column) -> DataFrame:
    """Add, under the names of ``sums``, what these aggregates add up to in the earlier ranges of the row's key (0 in the first)."""
    names = {name: f"_{name}" for name in sums}
    totals = parts.groupBy(F.col(key).alias("_key"), F.col("part").alias("_part")).agg(*[agg.alias(names[name]) for name, agg in sums.items()])
    upto = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.withColumns({n: F.coalesce(F.sum(n).over(upto), F.lit(0)) for n in names.values()})
    joined = parts.join(earlier, (F.col("part") == F.col("_part")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumnsRenamed({n: name for name, n in names.items()}).drop("_key", "_part")


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Add ``n``: the row's number, from 1, in the sequence of its key."""
    within = F.row_number().over(Window.partitionBy(key, "part").orderBy(*order))
    return with_earlier(ranged(rows, key, order), key, n=F.count(F.lit(1))).withColumn("n", F.col("n") + within).drop("part")


def blocked(rows: DataFrame, halo: int, size: int | None = None) -> DataFrame:
    """Numbered rows with their ``block``; the last ``halo`` rows of a block are given to the next one too, there with ``own`` false,
    so that windows over (key, block) see that many rows before each row of the block."""
    size = max(size or BLOCK, halo)
    block = F.floor((F.col("n") - 1) / size)
    near = (F.col("n") - 1) % size >= size - halo
    copies = F.when(near, F.array(block, block + 1)).otherwise(F.array(block))
    return rows.withColumn("block", F.explode(copies)).withColumn("own", F.col("block") == block)


def timed(rows: DataFrame, at: str, span: int) -> DataFrame:
    """Rows with their ``block`` of ``span`` units of time, each given to the next block too, there with ``own`` false."""
    block = F.floor(F.col(at) / span)
    return rows.withColumn("block", F.explode(F.array(block, block + 1))).withColumn("own", F.col("block") == block)
