"""The registered queries on the small tables, and the pipeline against brute force where SQL can't express it."""

import collections
import re

import pytest

import corpus_pipeline
from gazetta.llm import mixing, queries, sharding
from tests.compare import assert_same, connect


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), connect(sf_dir), queries.ORACLE_SQL[name])


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(ids, sets):
    """Groups of documents connected by links, by plain comparison of all pairs."""
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[:k]:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in ids}


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [shingle_set(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_copies", "decontamination", "mixing", "sharding"]
    rows = {r.doc_id: r for r in docs.collect()}
    sets = {i: shingle_set(r.text or "") for i, r in rows.items()}
    for name, stage in corpus_pipeline.STAGES:
        before, given = [r.doc_id for r in docs.select("doc_id").collect()], docs
        docs = corpus_pipeline.settle(stage(spark, docs, sf_dir))
        after = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(after) <= set(before)
        if name == "toxicity":
            scored = {r.doc_id: r.predicted for r in queries.QUERIES["op4_toxicity"](spark, sf_dir).collect()}
            assert sorted(after) == sorted(i for i in before if scored[i] == 0)
        if name == "near_copies":
            assert sorted(after) == sorted(set(classes(sorted(before), sets).values()))
        if name == "decontamination":
            leaks = {i for i in before if any(len(b & sets[i]) >= 0.8 * len(b) for b in bench)}
            assert sorted(after) == sorted(set(before) - leaks)
        if name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(given).collect()}
            assert collections.Counter(after) == collections.Counter({i: n for i, n in copies.items() if n}) and 0 < max(copies.values()) <= 3
        if name == "sharding":
            assert sorted(after) == sorted(before) and {"slot", "shard"} <= set(docs.columns)
            table = sharding.fill_table()
            assert all(table[r.slot] == r.shard for r in docs.select("slot", "shard").distinct().collect())
        else:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    """Nulls in all columns, repeated rows and ids, clashing columns, and no rows at all."""
    text = " ".join(f"word{i}" for i in range(40))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, copies string, Score int, _row int"
    rows = [(1, text, "en", "a", 1, "s", "c", 1, 7)] * 2 + [(None,) * 9, (2, "", None, "b", 0, None, None, 5, 7), (None, text + " more", "en", None, 1, "s", None, 1, 7), (3, "short one", "en", "a", 2, None, "c", None, 7)]
    rows += [(4, "x" * 300_000, "en", "a", 1, None, None, None, None), (5, " ".join(f"long{i}" for i in range(60_000)), "en", "a", 1, None, None, None, None)]
    spark.createDataFrame([(1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, None), (1, ""), (2, "not in any text of these")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.settle(stage(spark, docs, str(tmp_path)))
            if name == "near_copies":
                assert docs.count() == (6 if given else 0) and docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "slot", "copies", "Score", "_row"]
        assert "shard" in docs.columns and (docs.count() > 0) == bool(given)


def test_run_is_the_stages_in_order(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0 and corpus_pipeline.ORACLE_SQL is None
