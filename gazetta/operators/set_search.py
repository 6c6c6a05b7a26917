"""Exact search for the most similar sets of words: equal sets once, rare words first, and common words only where they can still matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .matching import in_lists


def _jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.round(both / (F.size(a) + F.size(b) - both), 6)


def distinct_sets(rows: DataFrame, id_col: str, words: Column, k: int) -> DataFrame:
    """(node, set, ids): every set once with its ``k`` least ids in order. No task gives away more than k ids of a set. Empty sets are left out."""
    told = rows.select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("set")).where(F.size("set") > 0)
    place = F.row_number().over(Window.partitionBy("set").orderBy(F.asc_nulls_last("id")))
    few = told.withColumn("place", place).where(F.col("place") <= k)
    grouped = few.groupBy("set").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("ids"))
    return settle(grouped.select(F.monotonically_increasing_id().alias("node"), "set", F.transform("ids", lambda x: x["id"]).alias("ids")))


def _met(asked: DataFrame, words: Column, postings: DataFrame, sets: DataFrame) -> DataFrame:
    """(query, node, similarity, ids) of the sets that share one of the ``words`` of a query and are neither too short nor too long for its bar."""
    terms = asked.select("query", F.explode(words).alias("word"))
    pairs = terms.join(postings, "word").select("query", "node").distinct()
    full = pairs.join(sets, "node").join(asked.select("query", F.col("set").alias("wanted"), "bar"), "query")
    sizes = F.least(F.size("set"), F.size("wanted")) / F.greatest(F.size("set"), F.size("wanted"))
    return full.where(sizes >= F.col("bar")).select("query", "node", _jaccard(F.col("wanted"), F.col("set")).alias("similarity"), "ids")


def similar_sets(rows: DataFrame, id_col: str, words: Column, is_query: Column, k: int) -> DataFrame:
    """(query, id, similarity, place): for each row that ``is_query`` marks the ``k`` other rows of greatest Jaccard similarity (six places, ties by
    id) among those that share a word with it, exactly. Rows with equal sets are compared once; a row without words finds nothing.

    1. A query meets the sets that have its rarest word; the k-th of them is its bar.
    2. A set at the bar t shares at least t of the query's words, so it has one of the rarest (1 - t) of them and one more. Only these
       words are looked up, and sets whose size rules them out are dropped before they are compared.
    """
    sets = distinct_sets(rows, id_col, words, k + 1)
    postings = settle(sets.select("node", F.explode("set").alias("word")))
    counts = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    own = rows.where(is_query).select(F.col(id_col).alias("id"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("set")).where(F.size("set") > 0)
    asked = sets.join(own.select("set").distinct(), "set", "left_semi").select(F.col("node").alias("query"), "set")
    ranked = asked.select("query", F.explode("set").alias("word")).join(counts, "word").groupBy("query").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("w"))
    asked = settle(asked.join(ranked, "query").select("query", "set", F.transform("w", lambda x: x["word"]).alias("rare"), F.lit(0.0).alias("bar")))
    first = settle(_met(asked, F.slice("rare", 1, 1), postings, sets))
    more = k + 1
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "node"))
    bars = first.withColumn("place", place).where(F.col("place") == more).select("query", F.greatest(F.col("similarity") - 1e-6, F.lit(0.0)).alias("bar"))
    barred = asked.drop("bar").join(bars, "query", "left").withColumn("bar", F.coalesce("bar", F.lit(0.0)))
    needed = F.size("rare") - F.ceil(F.col("bar") * F.size("rare")).cast("int") + 1
    further = barred.withColumn("rare", F.slice("rare", 2, F.greatest(F.least(needed, F.size("rare")) - 1, F.lit(0))))
    found = first.unionByName(_met(further, F.col("rare"), postings, sets)).dropDuplicates(["query", "node"])
    entry = found.select("query", "similarity", F.explode("ids").alias("id"))
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), F.asc_nulls_last("id")))
    lists = entry.withColumn("place", best).where(F.col("place") <= more).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "similarity"))).alias("hits"))
    named = lists.join(asked.select("query", "set"), "query").select("set", "hits")
    answered = own.select(F.col("id").alias("query"), "set").join(named, "set")
    others = F.slice(F.filter("hits", lambda h: ~h["id"].eqNullSafe(F.col("query"))), 1, k)
    return answered.select("query", F.posexplode(others).alias("at", "hit")).select("query", "hit.id", "hit.similarity", (F.col("at") + 1).alias("place"))


def sharing_sets(rows: DataFrame, id_col: str, words: Column, is_query: Column, least: int) -> DataFrame:
    """(query, id, similarity): for each row that ``is_query`` marks all other rows whose sets share at least ``least`` words with its own, with their
    Jaccard similarity (six places). Equal sets are compared once; their rows meet in lists."""
    told = rows.select(F.col(id_col).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asked"), F.array_sort(F.array_distinct(F.array_compact(words))).alias("set")).where(F.size("set") > 0)
    sets = settle(told.groupBy("set").agg(F.bool_or("asked").alias("asked")).withColumn("node", F.monotonically_increasing_id()))
    words_of = sets.select("node", "asked", F.size("set").alias("n"), F.explode("set").alias("word"))
    wanted = words_of.where("asked").select(F.col("node").alias("own"), F.col("n").alias("m"), "word")
    shared = words_of.join(wanted, "word").groupBy("own", "node", "n", "m").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= least)
    alike = shared.select("own", "node", F.round(F.col("both") / (F.col("n") + F.col("m") - F.col("both")), 6).alias("similarity"))
    named = settle(told.join(sets.select("set", "node"), "set").select("id", "node", "asked"))
    asked = named.where("asked").select(F.col("id").alias("query"), F.col("node").alias("own")).join(alike, "own").select("query", "node", "similarity")
    return in_lists(named.select("id", "node"), ["node"], asked).where("query <> id").select("query", "id", "similarity")
