"""Reading the driver's tables and the source tables of notices; writing results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, *tables: str):
    """One DataFrame a name; a single one is returned by itself."""
    found = [spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables]
    return found[0] if len(found) == 1 else found


def once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Rows with columns that are computed once a row, however often they are used: a generator stands between, across which the optimiser
    doesn't write the expression of a column into each of its uses."""
    held = rows.withColumn("_once", F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))
    return held.withColumns({name: F.col(f"_once.{name}") for name in columns}).drop("_once")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to all cores, for work that costs far more than moving them: a small file is read by one task."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def unify(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """Union of source tables by column name, with a ``source`` column; of equal keys the row of the last source stays."""
    parts = [df.withColumns({"source": F.lit(name), "_rank": F.lit(k)}) for k, (name, df) in enumerate(sources.items())]
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_rank")))
    return both.withColumn("_n", newest).where("_n = 1").drop("_n", "_rank")


def since(df: DataFrame, column: str, start: Column, keep_null: bool = True) -> DataFrame:
    """Rows from ``start`` on, optionally those without a date too; the predicate reaches the scan."""
    recent = F.col(column) >= start
    return df.where(recent | F.col(column).isNull()) if keep_null else df.where(recent)


def log_lines(spark: SparkSession, path: str, pattern: str, fields: tuple[str, ...]) -> DataFrame:
    """Lines of text files that match, one column a group."""
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(*[F.regexp_extract("value", pattern, k + 1).alias(f) for k, f in enumerate(fields)])


def levels_of_late(lines: DataFrame, at: Column, level: Column, levels: tuple[str, ...], seconds: int) -> DataFrame:
    """(level, n) for every one of ``levels``, also those without lines: lines of the last ``seconds`` before the newest one. Lines
    whose time can't be read (null) and other levels don't count."""
    timed = lines.select(at.alias("at"), F.upper(level).alias("level")).where("at IS NOT NULL")
    last = timed.agg(F.max("at").alias("last"))
    late = timed.join(F.broadcast(last)).where(F.col("at") >= F.col("last") - F.make_dt_interval(secs=F.lit(seconds))).groupBy("level").agg(F.count(F.lit(1)).alias("n"))
    every = lines.sparkSession.createDataFrame([(name,) for name in levels], "level string")
    return every.join(late, "level", "left").select("level", F.coalesce("n", F.lit(0)).alias("n"))


def csv_sink(df: DataFrame, path: str, columns: dict[str, Column], mark: bool = False) -> None:
    """CSV with a header, columns chosen, renamed and put in order. ``mark``: files start with the byte order mark that spreadsheets
    look for, which is part of the first header, since every file has one."""
    shown = [c.alias(("\ufeff" if mark and k == 0 else "") + n) for k, (n, c) in enumerate(columns.items())]
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.select(*shown).write.mode("errorifexists").options(header=True, escape='"', **kept).csv(path)


def csv_source(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What ``csv_sink`` wrote, texts with outer blanks and line breaks as they were."""
    return spark.read.options(header=True, escape='"', multiLine=True).schema(schema).csv(path)


def ndjson_sink(df: DataFrame, path: str) -> None:
    """One JSON record a line."""
    df.write.mode("errorifexists").json(path)


def snapshot_sink(df: DataFrame, path: str, totals: dict[str, Column]) -> None:
    """Records as JSON in ``records``, and one JSON object with their totals (aggregates by name) in ``totals``, counted over what was written."""
    ndjson_sink(df, f"{path}/records")
    written = df.sparkSession.read.schema(df.schema).json(f"{path}/records")
    ndjson_sink(written.agg(*[total.alias(name) for name, total in totals.items()]), f"{path}/totals")


def routed_sink(df: DataFrame, path: str, route: Column) -> None:
    """Parquet in one folder a target table; the target is an expression over the row."""
    df.withColumn("target_table", route).write.mode("errorifexists").partitionBy("target_table").parquet(path)
