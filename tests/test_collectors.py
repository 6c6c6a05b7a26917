"""The state machine of collectors against a plain loop, over several batches and across a restart from its checkpoint."""

import datetime
import random

from pyspark.sql import functions as F

from gazetta.streaming import collectors, flows

SCHEMA = "event_id long, ts timestamp, name string, kind string, source string"
START = datetime.datetime(2024, 3, 1, tzinfo=datetime.UTC)


def plain(events, now_s):
    out = []
    for name in {e[2] for e in events}:
        failures = ok = fail = 0
        due, idle, seen = None, False, set()
        for _, at, _, kind, source in sorted((e for e in events if e[2] == name), key=lambda e: (e[1], e[0])):
            if due is not None and not idle and at > due:
                out.append((name, due, "idle", 0, 0, 0, 0))
            if kind == "start":
                failures = ok = fail = 0
                due, idle, seen = at + 300, False, set()
            else:
                due = None
                seen.add(source)
                failures, ok, fail = (0, ok + 1, fail) if kind == "ok" else (failures + 1, ok, fail + 1)
            out.append((name, at, "degraded" if failures >= 3 else "ok", failures, ok, fail, len(seen)))
        if due is not None and due < now_s:
            out.append((name, due, "idle", 0, 0, 0, 0))
    return sorted(out, key=repr)


def test_states_over_batches_and_a_restart(spark, tmp_path):
    rng, events, t = random.Random(2), [], 0
    for i in range(240):
        t += rng.choice([5, 60, 200])
        name = rng.choice(["a", "b", "c", None])
        events.append((i, t, name, rng.choices(["start", "ok", "failed", "degraded"], [2, 3, 4, 3])[0], rng.choice(["cq", "fa", "manual"])))
    events.append((998, 10, "quiet", "start", None))  # never runs
    events.append((999, t + 20_000, "last", "ok", "cq"))  # moves the watermark

    def run(part):
        spark.createDataFrame([(i, START + datetime.timedelta(seconds=at), n, k, s) for i, at, n, k, s in part], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = flows.timed(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), delay="10 seconds")
        told = collectors.collector_states(stream, "name", F.col("kind"), F.col("source"))
        with collectors.timers_kept(spark):
            query = told.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        query.awaitTermination()

    events.sort(key=lambda e: e[1])
    for low, high in ((0, 90), (90, 91), (91, 300)):  # each run is a new query that goes on from the checkpoint
        run(events[low:high])
    base = int(START.timestamp())
    got = sorted([(r.name, r.at_us // 1_000_000 - base, r.status, r.failures, r.total_ok, r.total_fail, r.sources) for r in spark.read.parquet(str(tmp_path / "out")).collect()], key=repr)
    assert got == plain(events, t + 19_990) and {r[2] for r in got} == {"ok", "degraded", "idle"}
    table = spark.createDataFrame([(i, START + datetime.timedelta(seconds=at), n, k, s) for i, at, n, k, s in events], SCHEMA)
    twin = collectors.states_of_log(table, "name", F.col("kind"), F.col("source"), F.lit((base + t + 19_990) * 1_000_000))
    assert sorted([(r.name, r.at_us // 1_000_000 - base, r.status, r.failures, r.total_ok, r.total_fail, r.sources) for r in twin.collect()], key=repr) == got
