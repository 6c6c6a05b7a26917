"""Streaming forms of the stateful operators: deduplication, suppression, token buckets, windows, incremental merges.

Event times are timestamps with a watermark. State that has outlived its purpose is dropped by event-time timeouts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import local_folder
from .delta_log import DeltaLog


def table_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The files of a table as a stream; the name is given as a pattern because sources of streams read folders."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{table[:-1]}[{table[-1]}].parquet")


def timed(stream: DataFrame, at: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Give the stream a watermark; times without zone become timestamps of the session's zone first."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay)


def first_seen(stream: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key while the watermark hasn't passed it."""
    return stream.dropDuplicatesWithinWatermark(keys)


def hourly_health(stream: DataFrame, at: str = "ts") -> DataFrame:
    """(from_us, n, failures) per hour, each emitted once when the watermark has passed the hour."""
    hours = stream.groupBy(F.window(at, "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"))
    return hours.select(F.unix_micros("w.start").alias("from_us"), "n", "failures")


def suppress(stream: DataFrame, keys: list[str], seconds: int, at: str = "ts", buckets: int = 1024) -> DataFrame:
    """Keep an event only if the last kept one of its key is at least ``seconds`` older; that time is the key's state.

    Keys share ``buckets`` of state, since a call of Python a key costs more than the work on its events; the number stays with a stream's
    checkpoint. A key leaves its bucket when the watermark has passed its time.
    """
    gap, names = seconds * 1_000_000, [f"_{k}" for k in keys]

    def keep(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *known, times = state.get if state.exists else ([],) * (len(keys) + 1)
        last, now, kept = dict(zip(zip(*known), times)), state.getCurrentWatermarkMs(), []
        if not state.hasTimedOut:
            rows = pd.concat(parts).sort_values("us", kind="stable")
            for key, t in zip(zip(*(rows[n] for n in names)), rows["us"].tolist()):
                if key not in last or t - last[key] >= gap:
                    last[key] = t
                    kept.append((*key, t))
        last = {key: t for key, t in last.items() if (t + gap) // 1000 > now}
        if last:
            state.update((*map(list, zip(*last)), list(last.values())))
            state.setTimeoutTimestamp((min(last.values()) + gap) // 1000)
        elif state.exists:
            state.remove()
        yield pd.DataFrame(kept, columns=[*names, "sent_us"])

    said = stream.select(F.pmod(F.xxhash64(*keys), F.lit(buckets)).alias("_bucket"), *[F.col(k).cast("string").alias(n) for k, n in zip(keys, names)], F.col(at), F.unix_micros(at).alias("us"))
    shown, held = ", ".join(f"{n} string" for n in names), ", ".join(f"{n} array<string>" for n in names)
    kept = said.groupBy("_bucket").applyInPandasWithState(keep, f"{shown}, sent_us bigint", f"{held}, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return kept.select(*[F.col(n).cast(stream.schema[k].dataType).alias(k) for k, n in zip(keys, names)], "sent_us")


def token_bucket(stream: DataFrame, key: str, capacity: float, rate: float, at: str = "ts") -> DataFrame:
    """(key, asked, granted) of each batch: requests against a bucket of tokens per key, whose level and time are the state."""

    def take(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times = sorted(x for part in parts for x in part["us"])
        tokens, last = state.get if state.exists else (capacity, times[0] / 1e6)
        granted = 0
        for t in times:
            tokens, last = min(capacity, tokens + (t / 1e6 - last) * rate), t / 1e6
            if tokens >= 1:
                tokens, granted = tokens - 1, granted + 1
        state.update((tokens, last))
        yield pd.DataFrame({key: [name[0]], "asked": [len(times)], "granted": [granted]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.withColumn("us", F.unix_micros(at)).groupBy(key).applyInPandasWithState(take, f"{key} {kind}, asked int, granted int", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def collector_states(stream: DataFrame, key: str, ok: str, at: str = "ts", enough: int = 3) -> DataFrame:
    """(key, at_us, failures, total, status) per event: failures in a row and status ``degraded`` from ``enough`` on, else ``ok``.
    The state of a key is two counters."""

    def follow(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failures, total = state.get if state.exists else (0, 0)
        out = []
        for t, _, good in sorted(r for part in parts for r in zip(part["us"], part["event_id"], part[ok], strict=True)):
            failures, total = (0 if good else failures + 1), total + 1
            out.append((name[0], t, failures, total, "degraded" if failures >= enough else "ok"))
        state.update((failures, total))
        yield pd.DataFrame(out, columns=[key, "at_us", "failures", "total", "status"])

    kind = stream.schema[key].dataType.simpleString()
    rows = stream.withColumn("us", F.unix_micros(at))
    return rows.groupBy(key).applyInPandasWithState(follow, f"{key} {kind}, at_us bigint, failures int, total int, status string", "failures int, total int", "append", GroupStateTimeout.NoTimeout)


def watchdog(stream: DataFrame, key: str, seconds: int, quiet: tuple[int, int] = (22, 7), again: int = 1800, at: str = "ts") -> DataFrame:
    """(key, last_us) of sources that have been silent for ``seconds`` of event time, told by the watermark.

    An alert is raised when the watermark passes the last event by that much, and again after ``again`` more seconds of silence.
    In the quiet hours (UTC) it waits for their end. The state of a source is its last time; a timer wakes it.
    """

    def guard(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        if state.hasTimedOut:
            last = state.get[0]
            hour = now // 3_600_000 % 24
            silent = (hour >= quiet[0] or hour < quiet[1]) if quiet[0] > quiet[1] else quiet[0] <= hour < quiet[1]
            state.update((last,))
            state.setTimeoutTimestamp(now + (1000 * 300 if silent else again * 1000))
            if not silent:
                yield pd.DataFrame({key: [name[0]], "last_us": [last]})
            return
        last = max([int(x) for part in parts for x in part["us"]] + list(state.get if state.exists else ()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, now + 1))

    kind = stream.schema[key].dataType.simpleString()
    return stream.withColumn("us", F.unix_micros(at)).groupBy(key).applyInPandasWithState(guard, f"{key} {kind}, last_us bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def shared_folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or local_folder(spark.sparkContext, "gazetta-streams")
    return f"{base}/{uuid.uuid4().hex}"


def drained(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """Run the stream over all that is available now, into files of the shared folder, and read those."""
    folder = shared_folder(spark)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def merge_into_log(spark: SparkSession, stream: DataFrame, stored: DataFrame, key: str, keep: int = 3) -> DataFrame:
    """Merge every micro-batch into a log of runs by key, whose versions are named by the batches. Returns the last state."""
    folder = shared_folder(spark)
    log = DeltaLog(spark, f"{folder}/table", stored.schema, key)
    log.merge(stored, 0)

    def merge(batch: DataFrame, number: int) -> None:
        log.merge(batch, number + 1)
        log.clean(keep)

    merging = stream.writeStream.foreachBatch(merge)
    merging.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return log.read()
