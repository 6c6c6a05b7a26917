"""Upserts as joins: policies per column, first or last rows of a key, deltas, patches. Results are new snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocked, numbered

#: What a column of the merged row is, given the stored and the incoming value (both keys exist).
POLICIES = {
    "overwrite": lambda old, new: new,
    "keep_if_blank": lambda old, new: F.coalesce(F.nullif(new, F.lit("")), old),
    "keep_if_null": lambda old, new: F.coalesce(new, old),
    "keep_existing": lambda old, new: F.coalesce(F.nullif(old, F.lit("")), new),
}


def first_rows(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a total order. Rows with a null in a key never conflict and all stay."""
    blank = F.lit(False)
    for k in keys:
        blank = blank | F.col(k).isNull()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(blank | (F.col("_place") == 1)).drop("_place")


def upsert(stored: DataFrame, incoming: DataFrame, key: str, policies: dict[str, str]) -> DataFrame:
    """Stored rows merged with incoming ones by key: (key, columns of ``policies``, action: inserted, updated or kept)."""
    old, new = stored.alias("old"), incoming.alias("new")
    both = old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer")
    is_new, is_old = F.col(f"old.{key}").isNull(), F.col(f"new.{key}").isNull()

    def merged(c: str, policy: str) -> Column:
        a, b = F.col(f"old.{c}"), F.col(f"new.{c}")
        return F.when(is_new, b).when(is_old, a).otherwise(POLICIES[policy](a, b)).alias(c)

    action = F.when(is_new, "inserted").when(is_old, "kept").otherwise("updated")
    return both.select(F.coalesce(f"old.{key}", f"new.{key}").alias(key), *[merged(c, p) for c, p in policies.items()], action.alias("action"))


def patch(stored: DataFrame, changes: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """Overwrite the allowed columns where the change is neither null nor blank; other keys and columns stay."""
    named = changes.select(F.col(key), *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in allowed])
    joined = stored.join(named, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in allowed}).drop(*[f"_{c}" for c in allowed])


def apply_delta(stored: DataFrame, delta: DataFrame, key: str, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows of the delta replace stored rows of their key or are added; one exchange by key. Of several delta rows of a key the
    last by ``order`` counts (by default the one of greatest hash, so that reruns agree)."""
    tagged = stored.withColumn("_delta", F.lit(0)).unionByName(delta.withColumn("_delta", F.lit(1)), allowMissingColumns=True)
    by = [F.desc(o) for o in order] if order else [F.desc(F.xxhash64(*[c for c in tagged.columns if c != "_delta"]))]
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_delta"), *by))
    return tagged.withColumn("_place", place).where("_place = 1").drop("_place", "_delta")


def without(stored: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Stored rows whose key is not among ``gone``."""
    return stored.join(gone.select(key), key, "left_anti")


def suppress(events: DataFrame, keys: list[str], at: str, seconds: int) -> DataFrame:
    """Keep an event only if the last kept one of its key is at least ``seconds`` older (not merely the last event).

    A partition is sorted by key and time, which spills, and scanned: of a key only the time of the last kept event is held.
    """
    gap = seconds * 1_000_000

    def keep(column: np.ndarray, state: int | None) -> tuple[np.ndarray, int | None]:
        kept, i = [], 0
        while i < len(column):  # from one kept event to the next
            i = i if state is None else max(i, int(np.searchsorted(column, state + gap)))
            if i < len(column):
                state = int(column[i])
                kept.append(state)
        return np.array(kept, np.int64), state

    rows = events.select(*keys, F.unix_micros(F.col(at).cast("timestamp")).alias("sent_us"))
    return scan_sorted(rows, keys, "sent_us", keep)


def admitted(adds: DataFrame, key: str, at: str, tie: str, span: int) -> DataFrame:
    """Adds that a queue takes: those of keys it hasn't seen for ``span`` units of time, every add counting as seen (also one that
    isn't taken). ``tie`` orders adds of the same time. A hot key's rows are shared by tasks in blocks."""
    rows = blocked(numbered(adds, key, [at, tie]), 1)
    before = F.lag(at).over(Window.partitionBy(key, "block").orderBy("n"))
    return rows.withColumn("_before", before).where(F.col("own") & (F.col("_before").isNull() | (F.col(at) - F.col("_before") >= span))).select(*adds.columns)


def affected(stored: DataFrame, changed: DataFrame, code: str) -> DataFrame:
    """Stored rows that changes make stale: those of the codes that occur among the changed rows. Rows without a code stay valid."""
    return stored.join(changed.select(code).where(F.col(code).isNotNull()).distinct(), code, "left_semi")


def scan_sorted(rows: DataFrame, keys: list[str], value: str, step) -> DataFrame:
    """Scan each key's values in order with ``step(values, state) -> (values to emit, state)``: a run of a key's sorted values
    at a time, first with the state None. Rows are (keys, value); values of all keys but the current one's state are dropped."""

    def scan(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in stream:
            named, values = [batch.column(k).to_pylist() for k in keys], batch.column(value).to_numpy(zero_copy_only=False)
            names = list(zip(*named, strict=True))
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]] + [len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if names[a] != now:
                    now, state = names[a], None
                kept, state = step(values[a:b], state)
                if len(kept):
                    yield pa.RecordBatch.from_arrays([*(pa.array([x] * len(kept), batch.schema.field(k).type) for k, x in zip(keys, now, strict=True)), pa.array(kept)], [*keys, value])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*keys).sortWithinPartitions(*keys, value).mapInArrow(scan, kinds)


def quarantine(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reason``: the first rule (name -> what must hold) that a row breaks, null for good rows. A null verdict breaks the
    rule. Bad rows are set aside by this column, so that one of them fails neither its batch nor its neighbours."""
    return df.withColumn("reason", F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def entity_key(number: Column, name: Column) -> Column:
    """Key of an entity known by number, or by name where the number is blank; the two never meet."""
    return F.coalesce(F.concat(F.lit("no:"), F.nullif(number, F.lit(""))), F.concat(F.lit("name:"), name))


def latest_of(df: DataFrame, key: Column, order: list) -> DataFrame:
    """The last row of each key in a total order; rows without a key go."""
    place = F.row_number().over(Window.partitionBy("_key").orderBy(*order))
    return df.withColumn("_key", key).where("_key IS NOT NULL").withColumn("_place", place).where("_place = 1").drop("_place", "_key")


def changes_since(tables: list[DataFrame], key: str, updated: str, tie: str, since: Column | None, most: int) -> DataFrame:
    """Rows of several tables that changed after ``since``, the ``most`` oldest changes of each (all rows of all tables where ``since``
    is None), one a key: that of the earliest table, there the oldest. Adds ``place``, the table's number. Rows without a key go."""
    parts = []
    for place, table in enumerate(tables):
        changed = table if since is None else table.where(F.col(updated) > since).orderBy(updated, tie).limit(most)
        parts.append(changed.withColumn("place", F.lit(place)))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part, allowMissingColumns=True)
    return latest_of(both, F.col(key), ["place", updated, tie])
