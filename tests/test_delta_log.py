"""The log of runs: what a merge writes follows the delta, versions survive a new driver object, a rerun replaces itself."""

import random
from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from gazetta.streaming import delta_log
from gazetta.streaming.delta_log import DeltaLog, SeenKeys

SCHEMA = "k long, v string"


def written(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def state(log, version=None):
    return {r.k: r.v for r in log.read(version).collect()}


def test_versions_removals_and_recovery(spark, tmp_path):
    stored = spark.createDataFrame([(k, "old") for k in range(40)], SCHEMA)
    log = DeltaLog(spark, str(tmp_path / "t"), stored.schema, "k")
    assert log.read().count() == 0 and log.versions() == []
    log.merge(stored, 0)
    log.merge(spark.createDataFrame([(3, "one"), (100, "one"), (None, "none")], SCHEMA), 1)
    again = DeltaLog(spark, str(tmp_path / "t"), stored.schema, "k")
    for _ in range(2):  # the second time as after a crash
        again.merge(spark.createDataFrame([(3, "two"), (4, "a"), (4, "b")], SCHEMA), 2, order=("v",))
    again.remove(spark.createDataFrame([(5,), (100,), (777,), (None,)], "k int"), 3)
    again.merge(spark.createDataFrame([], SCHEMA), 4)
    after = {k: "old" for k in range(40)} | {3: "two", 4: "b"}
    del after[5]
    assert state(log) == after and state(log, 0) == {k: "old" for k in range(40)}
    assert state(log, 1) == {k: "old" for k in range(40)} | {3: "one", 100: "one", None: "none"}
    again.merge(spark.createDataFrame([(5, "back")], SCHEMA), 5)
    assert state(log) == after | {5: "back"}


def test_random_versions_against_a_plain_dictionary(spark, tmp_path, monkeypatch):
    rng, plain, kept = random.Random(5), {}, {}
    log = DeltaLog(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "k")
    for version in range(14):
        monkeypatch.setattr(delta_log, "SHIPPED", 0 if version % 2 else 1000)
        keys = rng.sample(range(60), rng.choice([1, 3, 30]))
        if version % 4 == 3:
            log.remove(spark.createDataFrame([(k,) for k in keys], "k long"), version)
            plain = {k: v for k, v in plain.items() if k not in keys}
        else:
            log.merge(spark.createDataFrame([(k, f"v{version}") for k in keys], SCHEMA), version)
            plain |= {k: f"v{version}" for k in keys}
        kept[version] = dict(plain)
        assert state(log) == plain
        sizes = [run.n for run in log.runs()]
        assert all(a >= 2 * sum(sizes[i + 1 :]) for i, a in enumerate(sizes))
    log.clean(keep=3)
    assert log.versions() == [11, 12, 13] and all(state(log, v) == kept[v] for v in (11, 12, 13))
    assert {p.name for p in (tmp_path / "t" / "runs").iterdir()} == {run.folder for v in (11, 12, 13) for run in log.runs(v)}


def test_bytes_written_follow_the_delta(spark, tmp_path):
    rows = lambda low, high, v: spark.range(low, high).select(F.col("id").alias("k"), F.sha2(F.concat(F.lit(v), F.col("id").cast("string")), 256).alias("v"))
    log = DeltaLog(spark, str(tmp_path / "t"), spark.createDataFrame([], SCHEMA).schema, "k")
    log.merge(rows(0, 200_000, "a"), 0)
    base = written(tmp_path)
    costs = []
    for version in range(1, 9):
        before = written(tmp_path)
        log.merge(rows(version * 50, version * 50 + 400, f"b{version}"), version)
        costs.append(written(tmp_path) - before)
    assert max(costs) < 0.05 * base and sum(costs) < 0.12 * base and len(log.runs()) <= 5
    assert log.read().count() == 200_000 and log.read().where(F.col("v") == F.sha2(F.lit("b8500"), 256)).count() == 1
    plan = log.read()._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    log.clean(keep=1)
    assert written(tmp_path) < 1.1 * base


def test_markers_of_keys_against_plain_sets(spark, tmp_path):
    rng = random.Random(1)
    for name, seconds in (("day", 86_400), ("ever", None)):
        seen, plain = SeenKeys(spark, str(tmp_path / name), "k", StringType(), seconds), {}
        for version in range(4):
            now = version * 50_000
            keys = [rng.choice("abcdefghijkl") for _ in range(6)] + [None]
            rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, i int")
            expected = sorted({k for k in keys if k not in plain or (seconds is not None and plain[k] <= now - seconds)}, key=repr)
            for _ in range(2):
                assert sorted((r.k for r in seen.admit(rows, now, version).collect()), key=repr) == expected
            plain |= dict.fromkeys(expected, now)
