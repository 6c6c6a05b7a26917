"""Steps that once cost a call or an expression too many: state by buckets, one read of state a batch, texts computed once."""

import pandas as pd
from pyspark.sql import functions as F

from gazetta.functions import extract
from gazetta.operators import relevance
from gazetta.plans import load
from gazetta.sources.tables import once
from gazetta.streaming import flows
from gazetta.streaming.collectors import CollectorStates


def test_suppression_keeps_keys_in_buckets(spark, tmp_path):
    keys = [(k, None if k % 7 == 0 else f"t{k % 3}") for k in [*range(40), 2**60 + 1]] + [(None, "t")]
    rows = [(k, kind, 1_000 + h * 3_600) for k, kind in keys for h in (0, 1, 9)]
    spark.createDataFrame(rows, "k bigint, kind string, at long").select("k", "kind", F.timestamp_seconds("at").alias("ts")).write.parquet(f"{tmp_path}/rows.parquet")
    stream = flows.suppress(flows.timed(flows.table_stream(spark, str(tmp_path), "rows")), ["k", "kind"], 7_200, buckets=4)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= 4
    want = {(k, kind, at * 1_000_000) for k, kind, at in rows if at != 4_600}
    assert {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_a_batch_reads_and_writes_state_once():
    asked = []

    class Value:
        held = None

        def get(self):
            asked.append("get")
            return self.held

        def update(self, value):
            asked.append("update")
            self.held = value

    class Handle:
        timers = set()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, t):
            self.timers.add(t)

        def deleteTimer(self, t):
            self.timers.remove(t)

    states, handle = CollectorStates("c", 300), Handle()
    states.init(handle)
    frame = lambda kinds, at: pd.DataFrame([(at + k, k, x, x) for k, x in enumerate(kinds)], columns=["us", "event_id", "kind", "source"])
    out = pd.concat(states.handleInputRows(("a",), iter([frame(["ok"] * 50 + ["start"], 0)]), None))
    assert asked == ["get", "update"] and handle.timers == {300_001} and len(out) == 51
    pd.concat(states.handleInputRows(("a",), iter([frame(["failed"], 99)]), None))
    assert asked == ["get", "update"] * 2 and handle.timers == set()


def test_keyword_ratios_once_a_text(spark):
    rows = spark.createDataFrame([(k, "Steel bolts") for k in range(50)] + [(50, None), (51, "")], "id bigint, name string")
    found = relevance.keyword_scores(rows, "id", "name", [("steel bold", "fuzzy", 0.8)])
    assert {r.id for r in found.collect()} == set(range(50))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.rindex("Aggregate [_text")  # compared after equal texts are one


def test_texts_are_composed_once(spark, sf_dir):
    for name, said in (("page_field_forms", "项目概况：道路改造"), ("certificate_forms", "统一社会信用代码：91500000MA5U"), ("award_grammars", "三、中标候选人公示内容")):
        plan = load().QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(said) == 1, name
    rows = once(spark.range(3), a=F.col("id") + 1, b=F.lit(None).cast("string"))
    assert sorted(map(tuple, rows.collect())) == [(0, 1, None), (1, 2, None), (2, 3, None)]


def test_signs_of_remarks_miss_none(spark):
    said = ["甲公司1. 资质：一级", "乙公司，业绩:无", "丙公司 其他详见后", "丁公司(联合体)", "戊公司 无", "己公司、建筑工程类", "庚公司 电话：1", "辛公司（联合体牵头人）", "壬公司 招标文件规定"]
    got = spark.createDataFrame([(s,) for s in said], "s string").select(extract.winner_name(F.col("s")).alias("n")).collect()
    assert [r.n for r in got][:2] + [r.n for r in got][3:4] == ["甲公司", "乙公司", "丁公司"]
