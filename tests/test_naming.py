"""Edges of entity matches, publishable columns and forecasts."""

from pyspark.sql import functions as F

from gazetta.functions import text
from gazetta.operators import matching, scheduling

RULES = [("number", "number", "k_number"), ("name", "name", "k_name")]


def test_earliest_candidate_prefers_place_then_number(spark):
    known = spark.createDataFrame([(1, "n1", "alpha"), (2, "n2", "alpha"), (3, "n2", "beta"), (4, None, None)], "place int, k_number string, k_name string")
    records = spark.createDataFrame([(10, "n2", "alpha"), (11, "n2", "beta"), (12, "n1", "alpha"), (13, None, "gamma"), (14, None, None)], "id int, number string, name string")
    out = matching.earliest_candidate(records, known, "id", "place", RULES)
    assert {tuple(r) for r in out.collect()} == {(10, 1, "name"), (11, 2, "number"), (12, 1, "number")}
    assert matching.earliest_candidate(records.limit(0), known, "id", "place", RULES).count() == 0


def test_first_match_prefers_rule(spark):
    known = spark.createDataFrame([(1, "n1", "alpha"), (2, "n2", "alpha")], "place int, k_number string, k_name string")
    records = spark.createDataFrame([(10, "n2", "alpha")], "id int, number string, name string")
    assert [tuple(r) for r in matching.first_match(records, known, "id", "place", RULES).collect()] == [(10, 2, "number")]


def test_publishable(spark):
    rows = spark.createDataFrame([(1, "Ann", "1"), (2, "", "2"), (3, None, None)], "id int, who string, ID_card string")
    out = {r.id: r.who for r in text.publishable(rows, ("who",), "s").collect()}
    assert len(out[1]) == 16 and out[2] == "" and out[3] is None
    assert text.publishable(rows).columns == ["id", "who"]


def test_forecast(spark):
    at = F.expr("TIMESTAMP_NTZ'2024-01-06 18:00:00'")  # a Saturday
    history = spark.createDataFrame([("2024-01-01 18:10:00", 10.0), ("2024-01-02 18:20:00", 30.0), ("2024-01-02 03:00:00", 5.0), ("2024-01-02 04:00:00", None)], "t string, found double")
    history = history.select(F.col("t").cast("timestamp_ntz").alias("at"), "found")
    got = [round(r.expected, 6) for r in scheduling.forecast(history, at, 2, peaks=1).orderBy("at").collect()]
    assert got == [12.0, 2.7]
    assert scheduling.forecast(history.limit(0), at).count() == 0
