"""Every registered query of the library against its oracle SQL, and replay of streams against batches."""

import pytest

from gazetta.plans import load
from tests.compare import assert_same, connect

REGISTRY = load()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY.ORACLE_SQL))
def test_matches_oracle(spark, sf_dir, con, name):
    assert_same(REGISTRY.QUERIES[name](spark, sf_dir), con, REGISTRY.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(REGISTRY.QUERIES) - set(REGISTRY.ORACLE_SQL)))
def test_runs(spark, sf_dir, name):
    assert REGISTRY.QUERIES[name](spark, sf_dir).columns


def test_stream_of_requests_equals_batch(spark, sf_dir):
    stream = {(r.user_id, r.asked, r.granted) for r in REGISTRY.QUERIES["stream_token_bucket"](spark, sf_dir).collect()}
    batch = {(r.source, r.asked, r.granted) for r in REGISTRY.QUERIES["token_bucket"](spark, sf_dir).collect()}
    assert stream == batch


def test_entry():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
