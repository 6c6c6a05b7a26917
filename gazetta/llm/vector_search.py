"""Exact top-k search by inner product over vector-approximation files: quantised cells bound every score, few exact vectors are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shuffle_width

#: Bits of a component's cell; queries that share one scan; vectors of a part at least; approximations bounded at once.
BITS, BLOCK, PART, CHUNK = 6, 1024, 16_384, 2048
#: Positions that have cells of their own; later ones share them, so that the table of cells is bounded.
POSITIONS = 4096
#: Whole components from here on could take a score out of the range of a long.
LARGEST = 1 << 27


def whole_vectors(rows: DataFrame, vector_col: str, scale: int) -> Column:
    """floor(scale * x) of each component x as double; null if the vector can't take part."""
    fine = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x.cast("double") * scale) < LARGEST))
    return F.when(fine, F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def fit_cells(vectors: DataFrame, bits: int = BITS) -> np.ndarray:
    """[POSITIONS used, 2^bits + 1] borders: cell c of a position holds the whole numbers from border c up to border c + 1, less one.

    Half of the inner borders are quantiles of all vectors, found by mergeable sketches per position, half cut the range evenly, so that
    rare large components have narrow cells too. The outer borders are the least and the largest value, so a cell always
    bounds its components. The table follows the number of positions, not of vectors.
    """
    half = 1 << (bits - 1)
    parts = [k / half for k in range(1, half)]
    seen = vectors.select(F.posexplode("vec").alias("at", "x")).groupBy((F.col("at") % POSITIONS).alias("at"))
    found = seen.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.percentile_approx("x", parts, 1000).alias("inner")).collect()
    borders = np.zeros((max((r["at"] for r in found), default=0) + 1, (1 << bits) + 1), np.int64)
    for r in found:
        even = np.linspace(r["low"], r["high"] + 1, half + 1)[:-1].round().astype(np.int64)
        borders[r["at"]] = np.sort([*even, *np.clip(r["inner"], r["low"], r["high"]), r["high"], r["high"] + 1])
    return borders


def _bounds(borders: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each component, from codes of shape (vectors, positions)."""
    at = np.arange(codes.shape[1]) % len(borders)
    return borders[at, codes], borders[at, codes + 1] - 1


def encode(vectors: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Cell of each component: the last whose lower border isn't above it."""
    out = np.empty(vectors.shape, np.int64)
    for j in range(vectors.shape[1]):
        out[:, j] = np.searchsorted(borders[j % len(borders)][1:-1], vectors[:, j], "right")
    return out


def _packed(codes: np.ndarray, bits: int) -> list[bytes]:
    cells = np.unpackbits(codes.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - bits:]
    return [row.tobytes() for row in np.packbits(cells.reshape(len(codes), codes.shape[1] * bits), axis=1)]


def _unpacked(data: list[bytes], dims: int, bits: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(data), np.uint8).reshape(len(data), -1)
    cells = np.unpackbits(raw, axis=1)[:, : dims * bits].reshape(len(data), dims, bits)
    return cells @ (1 << np.arange(bits)[::-1])


def approximate(vectors: DataFrame, borders: np.ndarray, bits: int = BITS) -> DataFrame:
    """(node, dims, data): the file of approximations, ``bits`` bits a component."""

    def code(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            column = batch.column("vec")
            dims = np.diff(column.offsets.to_numpy())
            flat, data = column.flatten().to_numpy(zero_copy_only=False), [b""] * len(dims)
            at = column.offsets.to_numpy() - column.offsets.to_numpy()[0]
            for d in np.unique(dims[dims > 0]):
                own = np.flatnonzero(dims == d)
                for i, packed in zip(own, _packed(encode(flat[at[own][:, None] + np.arange(d)], borders), bits), strict=True):
                    data[i] = packed
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(dims.astype(np.int32)), pa.array(data, pa.binary())], ["node", "dims", "data"])

    return vectors.select("node", "vec").mapInArrow(code, "node bigint, dims int, data binary")


class _Scan:
    """One block of queries of one length against the approximations that stream by."""

    def __init__(self, nodes: list[int], vectors: np.ndarray, borders: np.ndarray, k: int, bits: int):
        self.nodes, self.k, self.borders, self.bits, self.dims = np.array(nodes), k, borders, bits, vectors.shape[1]
        top = float(np.abs(vectors).sum(1).max(initial=0)) * float(np.abs(borders).max(initial=0))
        if top >= 2.0**52:
            raise OverflowError("scores of these vectors don't fit in the exact range of a double")
        kind = np.float32 if top < 2.0**23 else np.float64
        self.above, self.below = np.maximum(vectors, 0).astype(kind), np.minimum(vectors, 0).astype(kind)
        self.sure = np.full((len(nodes), k), -np.inf, kind)  # the k largest lower bounds so far
        self.found: list[tuple] = []

    def add(self, nodes: list[int], data: list[bytes]) -> None:
        codes = _unpacked(data, self.dims, self.bits) if self.dims else np.zeros((len(data), 0), np.int64)
        low, high = (x.astype(self.above.dtype) for x in _bounds(self.borders, codes))
        most, least = self.above @ high.T + self.below @ low.T, self.above @ low.T + self.below @ high.T
        merged = np.concatenate([self.sure, least], 1)
        self.sure = -np.sort(-np.partition(merged, merged.shape[1] - self.k, axis=1)[:, -self.k:], axis=1)
        q, v = np.nonzero(most >= self.sure[:, -1:])
        self.found.append((q, np.array(nodes)[v], most[q, v], least[q, v]))

    def result(self) -> pa.RecordBatch:
        parts = [np.concatenate(x) for x in zip(*self.found, strict=True)] if self.found else [np.empty(0, np.int64)] * 4
        kept = parts[2] >= self.sure[parts[0], -1] if len(parts[0]) else np.empty(0, bool)
        q, v, most, least = (x[kept] for x in parts)
        columns = [self.nodes[q].astype(np.int64) if len(q) else q.astype(np.int64), v.astype(np.int64), most.astype(np.int64), least.astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query", "node", "most", "least"])


def _scanned(borders: np.ndarray, k: int, bits: int):
    """Scan a partition sorted by (block, part, dims, kind): in each cell the queries (kind 0) come before the approximations."""

    def scan(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, queries, rows, running = None, [], [], None

        def start() -> _Scan | None:
            if not queries:
                return None
            dims = cell[2]
            flat = np.array([q[1] for q in queries], np.int64).reshape(len(queries), dims)
            return _Scan([q[0] for q in queries], flat, borders, k, bits)

        def flush() -> None:
            nonlocal rows, running
            if rows and (running := running or start()):
                running.add([r[0] for r in rows], [r[1] for r in rows])
            rows = []

        for batch in batch_iter:
            for block, part, dims, kind, node, data, vec in zip(*[batch.column(c).to_pylist() for c in ("block", "part", "dims", "kind", "node", "data", "vec")], strict=True):
                if cell != (block, part, dims):
                    flush()
                    if running:
                        yield running.result()
                    cell, queries, rows, running = (block, part, dims), [], [], None
                if kind == 0:
                    queries.append((node, vec))
                elif queries:
                    rows.append((node, data))
                    if len(rows) == CHUNK:
                        flush()
        flush()
        if running:
            yield running.result()

    return scan


def _least_ids(rows: DataFrame, k: int) -> DataFrame:
    """(vec, ids): each different vector with its k least ids, null last. No more can be among the k best of any query, and
    no more than k rows a vector leave a task, so that a vector of a third of all rows is no hot key."""
    order = Window.partitionBy("vec").orderBy(F.asc_nulls_last("vec_id"))
    least = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    packed = F.struct(F.col("vec_id").isNull().alias("none"), "vec_id")
    return least.groupBy("vec").agg(F.array_sort(F.collect_list(packed)).alias("ids"))


def candidates(vectors: DataFrame, queries: DataFrame, k: int, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(query, node, most, least): for every query all vectors whose upper bound reaches the k-th largest lower bound, from
    (node, vec) of all vectors and of the queries.

    Queries are dealt into blocks of about ``block``; each block meets the file of approximations part by part. A cell of block and
    part streams the part past the queries and holds the k largest lower bounds of each. Parts are as many as give every
    task four cells, so blocks that are many enough meet the file whole; each part costs k rows a query.
    """
    borders = fit_cells(vectors, bits)
    n, all_vectors, width = queries.count(), vectors.count(), shuffle_width(vectors.sparkSession)
    blocks = max(1, -(-n // block))
    parts = max(1, min(-(-all_vectors // PART), -(-4 * width // blocks)))
    deal = lambda count: F.pmod(F.xxhash64("node"), F.lit(count)).cast("int")
    file = settle(approximate(vectors, borders, bits))
    none = F.lit(None)
    asked = queries.select(
        deal(blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.size("vec").alias("dims"), F.lit(0).alias("kind"), "node",
        none.cast("binary").alias("data"), "vec",
    )
    offered = file.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), deal(parts).alias("part"), "dims", F.lit(1).alias("kind"), "node", "data", none.cast("array<int>").alias("vec"),
    )
    cell = ["block", "part"]
    dealt = asked.unionByName(offered).repartition(*cell).sortWithinPartitions(*cell, "dims", "kind")
    found = settle(dealt.mapInArrow(_scanned(borders, k, bits), "query bigint, node bigint, most bigint, least bigint"))
    # A vector far from the query in one part may be out of the question by what other parts hold.
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("least"), "node"))).where(F.col("place") == k)
    return found.join(best.select("query", F.col("least").alias("bar")), "query", "left").where(F.col("bar").isNull() | (F.col("most") >= F.col("bar"))).drop("bar")


def read_exact(found: DataFrame, vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` with the exact score and the ids of each candidate."""
    product = F.aggregate(F.zip_with("asked", "vec", lambda x, y: x.cast("bigint") * y), F.lit(0).cast("bigint"), lambda a, x: a + x)
    full = found.join(vectors, "node").join(queries.select(F.col("node").alias("query"), F.col("vec").alias("asked")), "query")
    return full.select("query", "node", "most", product.alias("score"), "ids")


def _kth(scored: DataFrame, k: int) -> DataFrame:
    """(query, bar): the k-th best exact score so far; a vector counts once, whatever its copies."""
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "node"))
    return scored.withColumn("place", place).where(F.col("place") == k).select("query", F.col("score").alias("bar"))


def exact_topk(rows: DataFrame, is_query: Column | None = None, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64,
               bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Per query row its ``k`` best other rows: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); the score is the integer inner product, ties go to the smaller id, null ids last. A row
    is a query if ``is_query`` holds (default: id divisible by 20; null is no). Vectors that are null or hold null,
    non-finite or (after scaling) 2^27 or larger components take no part. Vectors meet only those of their own length; empty vectors
    score 0. A query's own row is left out, other rows of its id or vector are not. Rows that repeat an id are rows of
    their own, so a repeated query has its result twice. No vectors, or no queries, give no rows.

    1. Equal vectors collapse to one with its k + 1 least ids; equal queries are asked once for k + 1 rows.
    2. The file of approximations is scanned: its cells bound every score from both sides, and only vectors whose upper bound reaches
       the k-th largest lower bound remain.
    3. Exact vectors are read in the order of their bounds: first the 2 (k + 1) of the greatest upper bounds of each query, then only those
       whose upper bound is not below the k-th exact score so far. After that no unread vector can be among the k best.
    """
    asked = F.coalesce(F.col(id_col) % 20 == 0 if is_query is None else is_query, F.lit(False))
    whole = settle(rows.select(F.col(id_col).alias("vec_id"), asked.alias("asked"), whole_vectors(rows, vector_col, scale).alias("vec")).where("vec is not null"))
    more = k + 1
    vectors = settle(_least_ids(whole, more).withColumn("node", F.monotonically_increasing_id()))
    wanted = whole.where("asked").select("vec").distinct()
    queries = settle(vectors.join(wanted, "vec", "left_semi").select("node", "vec"))
    found = candidates(vectors.select("node", "vec"), queries, more, bits, block)
    first = 2 * more
    ordered = settle(found.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("most"), "node"))))
    read = settle(read_exact(ordered.where(F.col("place") <= first), vectors, queries))
    rest = ordered.where(F.col("place") > first).join(_kth(read, more), "query").where(F.col("most") >= F.col("bar"))
    scored = read.unionByName(read_exact(rest, vectors, queries))
    entry = scored.select("query", "score", (F.col("node") == F.col("query")).alias("mine"), F.explode("ids").alias("id")).select("query", "score", "mine", "id.none", "id.vec_id")
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "none", "vec_id", "mine"))
    listed = entry.withColumn("place", best).where(F.col("place") <= more)
    lists = listed.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "mine"))).alias("hits"))
    lists = lists.join(queries.withColumnRenamed("node", "query"), "query").select("vec", "hits")
    answered = whole.where("asked").select(F.col("vec_id").alias("query_id"), "vec").join(lists, "vec")
    own = F.filter("hits", lambda h: h["mine"] & h["vec_id"].eqNullSafe(F.col("query_id")))
    answered = answered.withColumn("own", F.array_min(F.transform(own, lambda h: h["place"])))
    others = F.slice(F.filter("hits", lambda h: F.col("own").isNull() | (h["place"] != F.col("own"))), 1, k)
    return answered.select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
