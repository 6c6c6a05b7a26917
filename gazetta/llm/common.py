"""What several training-data operators share: reading, lineage cuts, splits and distributed ranks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import settle, ship  # noqa: F401

#: A word: a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_split(key: Column, modulus: int, held: int) -> Column:
    """True for held-out rows: crc32 of the key as text leaves ``held`` when divided by ``modulus``; null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % modulus == held, F.lit(False))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null becomes the empty string."""
    text = F.coalesce(text, F.lit(""))
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def global_rank(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Add the 1-based position of each row in the order of ``keys`` without sending all rows to one task.

    Rows are range-partitioned, counted per partition, and ranked inside it; only one count a partition is gathered.
    """
    n = shuffle_width(df.sparkSession)
    ranged = settle(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()))
    before = (
        ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
        .select("_range", "_before")
    )
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_range", "_before")


def fresh(df: DataFrame, *names: str) -> DataFrame:
    """Drop columns of the input whose names the operator is about to add."""
    taken = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, with lines under them put before each until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def row_name(id_col: str, text_col: str) -> list[Column]:
    """Two 64-bit hashes that name a row by id and text."""
    return [F.xxhash64(id_col, text_col), F.xxhash64(F.lit("row"), text_col, id_col)]


def aside(df: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with the columns that an operator would replace (``names``) under other names, and how to get the columns of
    ``df`` back from what the operator returns."""
    taken = {n.lower() for n in names}
    away = {c: f"_own_{c}" for c in df.columns if c.lower() in taken}
    return df.withColumnsRenamed(away), lambda out: out.select(*[F.col(f"`{away.get(c, c)}`").alias(c) for c in df.columns])
