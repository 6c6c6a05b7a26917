"""A table by key kept as a log of sorted runs: a merge writes what it brings, a read lets newer runs win, runs of like size are joined.

Runs are Parquet folders; which of them make up a version is a small list of its own, written last. Everything is found in the
shared folder, so a new driver goes on where the last one stopped, and a version that is written again replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, IntegerType, LongType, StructField, StructType

#: Keys of newer runs up to which they are sent to the tasks that read the oldest one; beyond, both sides are shuffled.
SHIPPED = 1_000_000
#: A run is at least so many times as long as all newer ones together, else they become one.
FACTOR = 2
_LISTED = "version long, place int, folder string, n long"


@dataclass(frozen=True)
class Run:
    folder: str
    n: int


class DeltaLog:
    """``merge`` and ``remove`` make a version, ``read`` gives the rows of one, ``clean`` deletes what only older versions use."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType, key: str):
        self.spark, self.folder, self.schema, self.key = spark, folder.rstrip("/"), schema, key
        self._kept = StructType([*schema.fields, StructField("_gone", BooleanType())])

    def _lists(self) -> DataFrame | None:
        try:
            return self.spark.read.schema(_LISTED).json(f"{self.folder}/versions/*")
        except AnalysisException:  # no version yet
            return None

    def versions(self) -> list[int]:
        """The versions that ``clean`` has left."""
        lists = self._lists()
        return [] if lists is None else sorted(r[0] for r in lists.select("version").distinct().collect())

    def runs(self, version: int | None = None, before: int | None = None) -> list[Run]:
        """The runs of a version (the last one, or the last one before another), oldest first. Their number grows with the logarithm of
        the rows."""
        known = [v for v in self.versions() if before is None or v < before]
        version = max(known, default=None) if version is None else version
        if version is None or version not in known:
            return []
        rows = self._lists().where(F.col("version") == version).where("place >= 0").orderBy("place").collect()
        return [Run(r["folder"], r["n"]) for r in rows]

    def _rows(self, runs: Iterable[Run]) -> DataFrame:
        """Rows of some runs, with the place of the run."""
        out = self.spark.createDataFrame([], StructType([*self._kept.fields, StructField("_place", IntegerType())]))
        for k, run in enumerate(runs):
            out = out.unionByName(self.spark.read.schema(self._kept).parquet(f"{self.folder}/runs/{run.folder}").withColumn("_place", F.lit(k)))
        return out

    def _newest(self, runs: list[Run]) -> DataFrame:
        """One row a key: that of the newest run, removals included."""
        if len(runs) == 1:
            return self._rows(runs).drop("_place")
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("_place")))
        return self._rows(runs).withColumn("_n", place).where("_n = 1").drop("_n", "_place")

    def _merged(self, runs: list[Run]) -> DataFrame:
        """As ``_newest``, but the oldest run, the long one, is not shuffled while the keys of the newer ones are few."""
        if len(runs) < 2:
            return self._newest(runs)
        newer, old = self._newest(runs[1:]), self._rows(runs[:1]).drop("_place")
        keys = newer.select(F.col(self.key).alias("_key"))
        if sum(run.n for run in runs[1:]) <= SHIPPED:
            keys = F.broadcast(keys)
        return old.join(keys, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti").unionByName(newer)

    def _write(self, rows: DataFrame, folder: str) -> Run:
        path = f"{self.folder}/runs/{folder}"
        rows.select(*self._kept.names).write.mode("overwrite").parquet(path)
        return Run(folder, self.spark.read.schema(self._kept).parquet(path).count())

    def _add(self, rows: DataFrame, version: int) -> None:
        runs = self.runs(before=version)
        new = self._write(rows, f"v{version}")
        if new.n:
            at, total = len(runs), new.n
            while at and runs[at - 1].n < FACTOR * total:
                at, total = at - 1, total + runs[at - 1].n
            if at < len(runs):
                joined = self._newest([*runs[at:], new])
                new = self._write(joined if at else joined.where("NOT _gone"), f"v{version}-joined")
            runs = [*runs[:at], *([new] if new.n else [])]
        listed = [(version, k, run.folder, run.n) for k, run in enumerate(runs)] or [(version, -1, "", 0)]
        self.spark.createDataFrame(listed, _LISTED).coalesce(1).write.mode("overwrite").json(f"{self.folder}/versions/v{version}")

    def merge(self, delta: DataFrame, version: int, order: tuple[str, ...] = ()) -> None:
        """Rows of the delta replace those of their key or are added. Of several of a key the last by ``order`` counts, by default the one of
        greatest hash, so that reruns agree. A null key is a key."""
        by = [F.desc(o) for o in order] or [F.desc(F.xxhash64(*self.schema.names))]
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(*by))
        chosen = delta.select(*self.schema.names).withColumn("_n", place).where("_n = 1")
        self._add(chosen.withColumn("_gone", F.lit(False)), version)

    def remove(self, keys: DataFrame, version: int) -> None:
        """The rows of these keys (a column named like the key) are gone from this version on."""
        kind = self.schema[self.key].dataType
        gone = keys.select(F.col(self.key).cast(kind).alias(self.key)).distinct().withColumn("_gone", F.lit(True))
        blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        self._add(gone.select(self.key, *blank, "_gone"), version)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last version, or of one that is still kept."""
        return self._merged(self.runs(version)).where("NOT _gone").select(*self.schema.names)

    def clean(self, keep: int = 2) -> list[str]:
        """Delete the lists of all but the last ``keep`` versions and the runs that none of those has; return what went."""
        versions = self.versions()
        held = {run.folder for v in versions[-keep:] for run in self.runs(v)}
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        path = lambda *parts: self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        gone = []
        for v in versions[:-keep]:
            files.delete(path("versions", f"v{v}"), True)
        if files.exists(path("runs")):
            for found in files.listStatus(path("runs")):
                name = found.getPath().getName()
                if name not in held:
                    files.delete(found.getPath(), True)
                    gone.append(name)
        return sorted(gone)


class SeenKeys:
    """Keys that were admitted before, kept between runs: a marker holds for ``seconds`` (None: for ever)."""

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: DataType, seconds: int | None):
        schema = StructType([StructField(key, kind), StructField("at", LongType())])
        self.log, self.key, self.seconds = DeltaLog(spark, folder, schema, key), key, seconds

    def _held(self, now: int) -> Column:
        return F.lit(True) if self.seconds is None else F.col("at") > now - self.seconds

    def admit(self, rows: DataFrame, now: int, version: int) -> DataFrame:
        """The rows whose key holds no marker at the time ``now`` (seconds), one row a key, that of least hash; they are marked. Run again, a version
        admits the same rows."""
        runs = self.log.runs(before=version)
        held = self.log._merged(runs).where("NOT _gone").where(self._held(now)).select(F.col(self.key).alias("_key"))
        place = F.row_number().over(Window.partitionBy(self.key).orderBy(F.xxhash64(*rows.columns)))
        first = rows.withColumn("_n", place).where("_n = 1").drop("_n")
        admitted = first.join(held, F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        self.log.merge(admitted.select(self.key, F.lit(now).cast("long").alias("at")), version)
        marked = self.log.spark.read.schema(self.log._kept).parquet(f"{self.log.folder}/runs/v{version}").select(F.col(self.key).alias("_key"))
        return first.join(marked, F.col(self.key).eqNullSafe(F.col("_key")), "left_semi")
