"""Session memory: budgets of tokens and compaction of old turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import token_estimate
from . import blocks


def compact(turns: DataFrame, budget: int, keep: int = 5, share: float = 0.8) -> DataFrame:
    """(conv_id, turn, role, text): conversations over ``share`` of the budget keep their last ``keep`` turns; the older ones
    become one summary turn before them that counts them by role. Others stay as they are."""
    sized = turns.select("conv_id", "turn", "role", "text", token_estimate(F.coalesce("text", F.lit(""))).alias("tokens"))
    age = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    # Of a conversation only its total and its last turns leave a task; the rest meets the turn from which on it is kept.
    since = sized.select("conv_id", "turn").withColumn("age", age).where(F.col("age") <= keep).groupBy("conv_id").agg(F.min("turn").alias("since"))
    over = sized.groupBy("conv_id").agg(F.sum("tokens").alias("total")).where(F.col("total") > share * budget).join(since, "conv_id").select("conv_id", "since")
    placed = sized.join(over, "conv_id", "left").withColumn("old", F.coalesce(F.col("turn") < F.col("since"), F.lit(False)))
    said = F.format_string("[%d turns: %d user, %d assistant]", F.count(F.lit(1)), F.count_if(F.col("role") == "user"), F.count_if(F.col("role") == "assistant"))
    summary = placed.where("old").groupBy("conv_id").agg((F.min("turn") - 1).alias("turn"), said.alias("text")).withColumn("role", F.lit("summary"))
    return placed.where("NOT old").select("conv_id", "turn", "role", "text").unionByName(summary.select("conv_id", "turn", "role", "text"))


def used_so_far(turns: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Add ``used``: the sum of the values of the sequence's rows up to here. Ranges of a sequence are summed by many tasks and carried on."""
    rows = blocks.with_earlier(blocks.ranged(turns, key, order), key, before=F.sum(value))
    upto = Window.partitionBy(key, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.col("before") + F.coalesce(F.sum(value).over(upto), F.lit(0))).drop("part", "before")


def restarted(turns: DataFrame, key: str, order: list[str], value: str, budget: float) -> DataFrame:
    """Add ``part`` (from 1) and ``used``: the sum of the values of the sequence's rows in order, which begins anew, with a new part, at a row
    that would take it over the budget. A row above the budget is a part of its own; null values count as 0.

    Where a sum begins depends on all rows before, so no prefix sum gives it. A partition is sorted by key and order, which
    spills, and scanned batch by batch; of a sequence only the running sum is held, but one sequence is one task's scan.
    """
    fields = [*turns.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "part int, used double"])

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, used = object(), 0, 0.0
        for batch in stream:
            names, values = batch.column(key).to_pylist(), batch.column(value).to_pylist()
            parts, sums = np.empty(len(names), np.int32), np.empty(len(names))
            for i, (name, v) in enumerate(zip(names, values, strict=True)):
                v = float(v or 0)
                if name != now:
                    now, part, used = name, 1, v
                elif used + v > budget:
                    part, used = part + 1, v
                else:
                    used += v
                parts[i], sums[i] = part, used
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts), pa.array(sums)], [*batch.schema.names, "part", "used"])

    return turns.repartition(key).sortWithinPartitions(key, *order).mapInArrow(scan, schema)
