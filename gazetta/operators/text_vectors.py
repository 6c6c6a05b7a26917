"""Vectors of texts: the most frequent character n-grams of a table, weighted by how rare they are, scaled to length one.

A vectoriser is fitted over a whole table and used again on any other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import grams
from ..session import settle

#: Dimensions of a vector, and the sizes of the runs of characters.
FEATURES, LOW, HIGH = 256, 2, 4
#: Texts that are weighed at a time.
TEXTS = 2048


def plain_of(text: Column | str) -> Column:
    """The lower-cased text, in which several blanks are one."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "(?U)\\s\\s+", " ")


def _runs(text: Column) -> Column:
    """Runs of LOW to HIGH characters of the plain text."""
    return F.transform(F.array(plain_of(text)), lambda x: grams(x, LOW, HIGH))[0]


def _weighed(known: dict[str, tuple[int, int, float]]):
    """The weights of one text at a time, so that a task holds no more than a batch. ``known``: n-gram -> (its place among them, number, idf)."""
    words, at, idf = pa.array(list(known), pa.string()), np.array([v[1] for v in known.values()], np.int32), np.array([v[2] for v in known.values()], float)

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS):
                part = batch.slice(low, TEXTS)
                owner, places, counts = [], [], []
                for row, text in enumerate(part.column("plain").to_pylist()):
                    found = Counter(known[g][0] for n in range(LOW, HIGH + 1) for k in range(len(text) - n + 1) if (g := text[k:k + n]) in known)
                    owner += [row] * len(found)
                    places += found.keys()
                    counts += found.values()
                row, place = np.array(owner, np.int64), np.array(places, np.int64)
                w = np.array(counts, float) * idf[place]
                length = np.sqrt(np.bincount(row, w * w, part.num_rows))
                columns = [part.column("id").take(pa.array(row)), part.column("text").take(pa.array(row)), words.take(pa.array(place)), pa.array(at[place], pa.int32()), pa.array(w / length[row])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "text", "gram", "at", "w"])

    return weights


@dataclass
class GramVectors:
    """``features`` is (gram, at, idf): the n-grams in code-point order, numbered from 0; ``size`` of them at most, so they are sent to every task."""

    features: DataFrame
    size: int

    def weights(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, gram, at, w) of the n-grams of each row's text that are features, where w is count times idf at length one. Rows that repeat id and
        text are one row; a text without features has none."""
        known = {r.gram: (k, r.at, r.idf) for k, r in enumerate(self.features.collect())}  # ``size`` rows at most
        told = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).distinct().select("id", F.xxhash64("_text").alias("text"), plain_of("_text").alias("plain"))
        kind = told.schema["id"].dataType.simpleString()
        return told.mapInArrow(_weighed(known), f"id {kind}, text bigint, gram string, at int, w double")

    def vectors(self, rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """(id, vector) of each different row of id and text; zeros for a text without features."""
        dense = F.transform(F.sequence(F.lit(0), F.lit(self.size - 1)), lambda k: F.coalesce(F.try_element_at("_w", k), F.lit(0.0)))
        found = self.weights(rows, id_col, text_col).groupBy("id", "text").agg(F.map_from_entries(F.collect_list(F.struct("at", "w"))).alias("_w"))
        every = rows.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text")).distinct()
        joined = every.join(found, F.col("_id").eqNullSafe(F.col("id")) & (F.col("_text") == F.col("text")), "left")
        none = F.array_repeat(F.lit(0.0), self.size)
        return joined.select(F.col("_id").alias("id"), F.when(F.col("_w").isNull(), none).otherwise(dense).alias("vector"))


def fit(rows: DataFrame, text_col: str, features: int = FEATURES) -> GramVectors:
    """Count the n-grams of all texts (how often, in how many) and keep the most frequent ones, the first in code-point order of equals. The idf is
    ln((1 + texts) / (1 + texts with it)) + 1. Null texts are empty texts."""
    one = lambda n, df: lambda g: F.struct(g.alias("gram"), F.lit(n).alias("n"), F.lit(df).alias("df"))
    both = F.transform(F.array(_runs(F.col(text_col))), lambda r: F.concat(F.transform(r, one(1, 0)), F.transform(F.array_distinct(r), one(0, 1))))[0]
    counts = rows.select(F.explode(both).alias("x")).groupBy("x.gram").agg(F.sum("x.n").alias("n"), F.sum("x.df").alias("df"))
    texts = rows.count()
    kept = counts.orderBy(F.desc("n"), "gram").limit(features)
    numbered = kept.select("gram", (F.row_number().over(Window.orderBy("gram")) - 1).alias("at"), (F.log((1 + F.lit(texts)) / (1 + F.col("df"))) + 1).alias("idf"))
    return GramVectors(settle(numbered), features)
