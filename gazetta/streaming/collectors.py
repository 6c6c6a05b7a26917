"""Collectors as state machines on transformWithState: one value with a map, and event-time timers per collector."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds after its start within which a collector should have run, and failures in a row from which on it is degraded.
IDLE, ENOUGH = 300, 3
#: The store that transformWithState needs.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROWS = "at_us bigint, status string, failures int, total_ok int, total_fail int, sources int"


class CollectorStates(StatefulProcessor):
    """A row an event, and one when a collector is found idle.

    ``start`` (again) begins with nothing: counts and sources are cleared, and a timer is set. If no run was told until the timer's time,
    the collector is ``idle``, told once with that time, either when the watermark has passed it or before the first later event;
    it stays so until its first run. A run that isn't ``ok`` counts as a failure; after ENOUGH in a row the status is ``degraded``, until a run is ok.
    Runs before any start are counted, too. The map holds how often each source was collected. A collector's state is read and written once
    a micro-batch, since each access asks the JVM.
    """

    def __init__(self, key: str, idle: int = IDLE, enough: int = ENOUGH):
        self.key, self.idle_us, self.enough = key, idle * 1_000_000, enough

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "failures int, ok int, fail int, due bigint, told boolean, sources map<string, int>")

    def _now(self) -> tuple:
        *counts, sources = self.state.get() or (0, 0, 0, None, False, {})
        return tuple(counts), dict(sources)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.key, "at_us", "status", "failures", "total_ok", "total_fail", "sources"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        (failures, ok, fail, due, idle), sources = self._now()
        timer, out = due if not idle else None, []
        for at, _, kind, source in sorted(r for part in rows for r in zip(part["us"], part["event_id"], part["kind"], part["source"], strict=True)):
            if due is not None and not idle and at > due:
                out.append((key[0], due, "idle", failures, ok, fail, len(sources)))
            if kind == "start":
                sources = {}
                failures = ok = fail = 0
                due = int(at) + self.idle_us
            else:
                failures, ok, fail = (0, ok + 1, fail) if kind == "ok" else (failures + 1, ok, fail + 1)
                due = None
                sources[source] = sources.get(source, 0) + 1
            idle = False
            out.append((key[0], int(at), "degraded" if failures >= self.enough else "ok", failures, ok, fail, len(sources)))
        if timer != due:
            if timer is not None:
                self.handle.deleteTimer(timer // 1000 + 1)
            if due is not None:
                self.handle.registerTimer(due // 1000 + 1)
        self.state.update((failures, ok, fail, due, idle, sources))
        yield self._frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        (failures, ok, fail, due, idle), sources = self._now()
        if due is not None and not idle and expiredTimerInfo.getExpiryTimeInMs() > due // 1000:
            self.state.update((failures, ok, fail, due, True, sources))
            yield self._frame([(key[0], due, "idle", failures, ok, fail, len(sources))])

    def close(self) -> None:
        pass


@contextmanager
def timers_kept(spark: SparkSession) -> Iterator[None]:
    """Queries that start meanwhile use the state store that timers and maps need; others keep theirs."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, STORE)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def collector_states(stream: DataFrame, key: str, kind: Column, source: Column, at: str = "ts", idle: int = IDLE, enough: int = ENOUGH) -> DataFrame:
    """(key, at_us, status, failures, total_ok, total_fail, sources) of a stream with a watermark and columns ``key``, ``event_id`` and ``at``;
    ``kind`` is start, ok or anything else for a failure. Rows whose key is null are one collector's. Start the query within ``timers_kept``."""
    rows = stream.select(key, "event_id", at, F.unix_micros(at).alias("us"), kind.alias("kind"), source.cast("string").alias("source"))
    schema = f"{key} {stream.schema[key].dataType.simpleString()}, {_ROWS}"
    return rows.groupBy(key).transformWithStateInPandas(CollectorStates(key, idle, enough), schema, "append", "eventtime")


def states_of_log(rows: DataFrame, key: str, kind: Column, source: Column, now_us: Column, at: str = "ts", idle: int = IDLE, enough: int = ENOUGH) -> DataFrame:
    """The same rows from a table of all events, by windows; ``now_us`` says up to when timers have run."""
    told = rows.select(key, "event_id", F.unix_micros(F.col(at).cast("timestamp")).alias("us"), kind.alias("kind"), source.cast("string").alias("source"))
    order = Window.partitionBy(key).orderBy("us", "event_id")
    told = told.withColumn("life", F.count_if(F.col("kind") == "start").over(order)).withColumn("next", F.lead("us").over(order)).withColumn("follows", F.lead("kind").over(order))
    life = Window.partitionBy(key, "life").orderBy("us", "event_id")
    run, good = F.col("kind") != "start", F.col("kind") == "ok"
    told = told.withColumn("island", F.count_if(good).over(life))
    spell = Window.partitionBy(key, "life", "island").orderBy("us", "event_id")
    counted = told.select(
        key, "us", "next", "kind", F.count_if(run & ~good).over(spell).cast("int").alias("failures"), F.count_if(good).over(life).cast("int").alias("total_ok"),
        F.count_if(run & ~good).over(life).cast("int").alias("total_fail"), F.size(F.collect_set(F.when(run, F.col("source"))).over(life)).alias("sources"),
    )
    each = counted.select(key, F.col("us").alias("at_us"), F.when(F.col("failures") >= enough, "degraded").otherwise("ok").alias("status"), "failures", "total_ok", "total_fail", "sources")
    due = F.col("us") + idle * 1_000_000
    late = counted.where(F.col("kind") == "start").where((F.col("next").isNotNull() & (F.col("next") > due)) | (F.col("next").isNull() & (F.floor(due / 1000) + 1 <= F.floor(now_us / 1000))))
    zero = F.lit(0).cast("int")
    return each.unionByName(late.select(key, due.alias("at_us"), F.lit("idle").alias("status"), zero.alias("failures"), zero.alias("total_ok"), zero.alias("total_fail"), zero.alias("sources")))
