"""From raw documents to a sharded, deduplicated, decontaminated mix: five stages, each run on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazetta.llm import decontaminate, mixing, ngram_join, sharding, toxicity
from gazetta.llm.common import aside, crc_split, read, settle


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; the network learns from labelled documents of this input."""
    held = crc_split(F.col("doc_id"), 5, 0)
    net = toxicity.train(docs, read(spark, sf_dir, "labels"), held)
    renamed, back = aside(docs, "score", "predicted")
    return back(toxicity.score_toxicity(renamed, net).where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near copies."""
    return ngram_join.one_per_class(docs).select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_leaks(docs, read(spark, sf_dir, "benchmark")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: up to three times, or not at all."""
    renamed, back = aside(docs, *mixing.ADDED)
    return back(mixing.repeat_copies(mixing.mix(renamed)))


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their slot and shard; columns of these names are replaced."""
    return sharding.assign_shards(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: SQL can't express the first stage, a trained network.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents. Between stages the rows are cut off from what made them."""
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = settle(docs) if k + 1 < len(STAGES) else docs
    return docs
