"""An inverted file over learned centroids: every vector is in the list of its nearest centroid, a query looks into a few lists.

Cosine similarity; vectors are scaled to length one first. The centroids are fitted on a bounded sample, the index covers every
row, and ``relevance.nearest`` is the exact way beside it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle, ship

#: Vectors that centroids are fitted on at most, and lists at most; rounds of fitting.
SAMPLE, LISTS, ROUNDS = 20_000, 4_096, 12
#: Vectors of a list that one task compares; longer lists are cut into parts.
PART = 16_384


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay zero."""
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = ROUNDS, seed: int = 1) -> np.ndarray:
    """Centroids by rounds of assignment and averaging; a centroid without vectors moves to one that lies far from its own."""
    rng = np.random.default_rng(seed)
    sample = unit(sample)
    centroids = sample[rng.choice(len(sample), min(lists, len(sample)), replace=False)]
    for _ in range(rounds):
        scores = sample @ centroids.T
        nearest = scores.argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, sample)
        empty = np.flatnonzero(np.bincount(nearest, minlength=len(centroids)) == 0)
        sums[empty] = sample[np.argsort(scores.max(1))[: len(empty)]]
        centroids = unit(sums)
    return centroids


def _stacked(column: pa.Array, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of the right length without nulls and non-finite numbers, scaled to length one, and the rows that have one."""
    offsets = column.offsets.to_numpy()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    fit = np.flatnonzero((np.diff(offsets) == dims) & column.is_valid().to_numpy(zero_copy_only=False))
    rows = flat[(offsets[fit] - offsets[0])[:, None] + np.arange(dims)] if len(fit) else np.empty((0, dims))
    fine = np.isfinite(rows).all(1)
    return unit(rows[fine]), fit[fine]


@dataclass
class VectorIndex:
    """``rows`` is (list, id, vec): every vector that can be compared, once. ``centroids`` are lists times dimensions."""

    rows: DataFrame
    centroids: np.ndarray

    def _assigned(self, vectors: DataFrame, id_col: str, vector_col: str, probes: int) -> DataFrame:
        """(list, id, vec): each vector under its ``probes`` nearest centroids."""
        dims, shared = self.centroids.shape[1], ship(vectors.sparkSession).sparkContext.broadcast(self.centroids)

        def assign(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batch_iter:
                vecs, at = _stacked(batch.column("vec"), dims)
                scores = vecs @ shared.value.T
                near = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
                index = pa.array(np.repeat(at, near.shape[1]))
                column = pa.array(list(np.repeat(vecs, near.shape[1], axis=0)), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), batch.column("id").take(index), column], ["list", "id", "vec"])

        kind = vectors.schema[id_col].dataType.simpleString()
        rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vec")).where("vec IS NOT NULL")
        return rows.mapInArrow(assign, f"list int, id {kind}, vec array<double>")

    def add(self, vectors: DataFrame, id_col: str, vector_col: str) -> VectorIndex:
        """The index with further vectors; centroids stay."""
        return VectorIndex(self.rows.unionByName(self._assigned(vectors, id_col, vector_col, 1)), self.centroids)

    def remove(self, ids: DataFrame) -> VectorIndex:
        """The index without the ids (column ``id``)."""
        return VectorIndex(self.rows.join(ids.select("id"), "id", "left_anti").select("list", "id", "vec"), self.centroids)

    def probes_for(self, k: int, target: float = 0.95, queries: int = 64) -> int:
        """The least number of lists in which ``target`` of the ``k`` nearest vectors were found, measured with the ``queries`` indexed vectors of
        least hash against all lists. How many it takes depends on how clustered the vectors are."""
        drawn = self.rows.orderBy(F.xxhash64("id"), "id").limit(queries)
        sample = settle(drawn.select("id", "vec"))
        exact = self.search(sample, "id", "vec", k, len(self.centroids)).select("query", "id")
        pairs = exact.join(self.rows.select("id", "list"), "id").select("query", "list").collect()  # ``queries`` times k
        order = {r["id"]: np.argsort(np.argsort(-(self.centroids @ np.array(r["vec"])), kind="stable")) for r in sample.collect()}
        ranks = np.sort([order[r["query"]][r["list"]] for r in pairs])
        return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))))]) + 1 if len(ranks) else 1

    def search(self, queries: DataFrame, id_col: str, vector_col: str, k: int = 20, probes: int = 8) -> DataFrame:
        """(query, id, score, place): the ``k`` vectors of greatest cosine (six places, ties by id) in the ``probes`` nearest lists of each
        query. Lists and the queries that look into them are compared as blocks, part by part; pairs are never rows."""
        asked = self._assigned(queries, id_col, vector_col, probes)
        lengths = self.rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
        lengths = settle(lengths)  # at most as many rows as lists
        held = self.rows.join(F.broadcast(lengths), "list").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts").cast("bigint")).cast("int"))
        sent = asked.join(F.broadcast(lengths), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        kind, query_kind = (df.schema["id"].dataType.simpleString() for df in (self.rows, asked))
        left, right = held.select("list", "part", "id", "vec"), sent.select("list", "part", F.col("id").alias("query"), "vec")
        met = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(_best(k), f"query {query_kind}, id {kind}, score double")
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
        return met.withColumn("place", place).where(F.col("place") <= k)


def _best(k: int, step: int = 1024):
    def best(held: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if held.num_rows and asked.num_rows:
            stack = lambda t: np.stack([np.asarray(v) for v in t["vec"].to_numpy()])
            vectors, queries = stack(held), stack(asked)
            for low in range(0, len(queries), step):
                scores = np.round(queries[low : low + step] @ vectors.T, 6)
                bar = np.partition(scores, -k, axis=1)[:, -k, None] if scores.shape[1] > k else -np.inf
                q, v = np.nonzero(scores >= bar)  # ties at the end are parted by id afterwards
                found.append((q + low, v, scores[q, v]))
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        return pa.table({"query": asked["query"].take(pa.array(q)), "id": held["id"].take(pa.array(v)), "score": pa.array(s, pa.float64())})

    return best


def build(vectors: DataFrame, id_col: str, vector_col: str, lists: int | None = None, sample: int = SAMPLE) -> VectorIndex:
    """Index all vectors of the most frequent length; null vectors and those with nulls or non-finite numbers are in no list. Lists are by default as many as the root of
    the rows, up to LISTS. Centroids are fitted on the ``sample`` rows of least hash."""
    sized = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("dims")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dims")).first()
    dims, n = (sized["dims"], sized["n"]) if sized else (0, 0)
    lists = lists or int(min(LISTS, max(1, round(n**0.5))))
    drawn = vectors.where(F.size(vector_col) == dims).orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(vector_col).cast("array<double>").alias("vec"))
    rows = [r["vec"] for r in drawn.collect() if None not in r["vec"] and np.isfinite(r["vec"]).all()]
    centroids = fit_centroids(np.array(rows), lists) if rows else np.zeros((1, dims))
    empty = VectorIndex(vectors.limit(0), centroids)
    return VectorIndex(settle(empty._assigned(vectors, id_col, vector_col, 1)), centroids)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact hits (query, id) that were found; 1 without any."""
    row = exact.select("query", "id").join(found.select("query", "id", F.lit(1).alias("hit")), ["query", "id"], "left").agg(F.count(F.lit(1)), F.count("hit")).first()
    return row[1] / row[0] if row[0] else 1.0
