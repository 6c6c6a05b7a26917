"""N-gram Jaccard self-join: MinHash banding, candidates by shuffle on band hashes, verification on full n-gram sets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, free, row_name, settle
from .components import components
from .textvec import Words, batches, minhash_params, mix, segment_minima, shingles

#: Members of a bucket that are compared in one task; larger buckets are cut into blocks, compared pair by pair of blocks.
BLOCK = 512
#: Shingle columns of one dense product of a block.
COLUMNS = 2048


def bands_for(threshold: float, recall: float = 0.9999, most: int = 20) -> tuple[int, int]:
    """(bands, rows): the most rows a band, thus the fewest false candidates, that reach ``recall`` at the threshold with
    at most ``most`` bands."""
    need = lambda r: math.ceil(math.log(1 - recall) / math.log(1 - threshold**r))
    rows = max((r for r in range(1, 33) if need(r) <= most), default=1)
    return need(rows), rows


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, row, row2, node, bands): row and row2 are hashes of id and text, 128 bits together; node names the text's set of n-grams, so texts with equal sets share it; null for no words."""
    params = minhash_params(bands * rows)

    def sign(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_iter:
            texts = batch.column("text").to_pylist()
            nodes, keys = [], []
            for low, high in batches(texts):
                words = Words(texts[low:high])
                hashes, at = shingles(words.hashes, words.at, n)
                full = np.flatnonzero(np.diff(at))
                mins = segment_minima(hashes, at[full], params) if len(full) else np.empty((bands * rows, 0), np.uint64)
                band = mins.reshape(bands, rows, -1)
                key = band[:, 0]
                for r in range(1, rows):
                    key = mix(key * np.uint64(0x9E3779B97F4A7C15) + band[:, r])
                mine: list = [None] * (high - low)
                names: list = [None] * (high - low)
                for c, d in enumerate(full):
                    names[d] = _node(np.unique(hashes[at[d] : at[d + 1]]))
                    mine[d] = key[:, c].view(np.int64)
                nodes += names
                keys += mine
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "row", "row2")), pa.array(nodes, pa.string()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "row", "row2", "node", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", *_named("doc_id", "text")).mapInArrow(sign, f"doc_id {kind}, row bigint, row2 bigint, node string, bands array<bigint>")


def _named(id_col: str, text_col: str) -> list[Column]:
    return [c.alias(n) for c, n in zip(row_name(id_col, text_col), ("row", "row2"), strict=True)]


def _similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, allowed: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix left x right: Jaccard similarity of the sets reaches the threshold, where allowed."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    out = np.zeros(allowed.shape, bool)
    possible = allowed & (np.minimum(sizes[left][:, None], sizes[right][None]) >= threshold * np.maximum(sizes[left][:, None], sizes[right][None]))
    if len(sets) <= 24 or possible.sum() <= 4 * len(sets):
        for i, j in np.argwhere(possible):
            x, y = sets[left[i]], sets[right[j]]
            place = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int((y[place] == x).sum())
            out[i, j] = both >= threshold * (len(x) + len(y) - both)
        return out
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    column = np.concatenate(([0], np.cumsum(values[1:] != values[:-1])))
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    both = np.zeros(allowed.shape, np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [low, low + COLUMNS])
        grid = np.zeros((len(sets), COLUMNS), np.float32)
        grid[owner[a:b], column[a:b] - low] = 1
        both += grid[left] @ grid[right].T
    union = sizes[left][:, None] + sizes[right][None] - both
    return possible & (both >= threshold * union)


def _node(own: np.ndarray) -> str:
    return hashlib.blake2b(own.tobytes(), digest_size=16).hexdigest()


def _compare(sets: list, bands: np.ndarray, copies: np.ndarray, blocks: np.ndarray, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of the members of one group: per member its linked texts, its linked documents, and a linked member (or itself).

    A pair is taken in the first band that its texts share, so it counts once over all groups. Members of one block are
    compared with each other in the group of that block alone, otherwise with those of the other block.
    """
    if (blocks == blocks[0]).all():
        left = right = np.arange(len(sets))
        allowed = np.triu(np.ones((len(left), len(left)), bool), 1)
    else:
        left, right = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
        allowed = np.ones((len(left), len(right)), bool)
    for j in range(band):
        allowed &= bands[left, j][:, None] != bands[right, j][None]
    linked = _similar(sets, left, right, allowed, threshold)
    texts_n, docs_n, root = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), np.arange(len(sets))
    np.add.at(texts_n, left, linked.sum(1))
    np.add.at(texts_n, right, linked.sum(0))
    np.add.at(docs_n, left, linked @ copies[right])
    np.add.at(docs_n, right, copies[left] @ linked)
    pairs = np.argwhere(linked)
    pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], 1) if len(pairs) else pairs
    while len(pairs):  # roots of the members inside the group
        new = root.copy()
        np.minimum.at(new, pairs[:, 0], root[pairs[:, 1]])
        np.minimum.at(new, pairs[:, 1], root[pairs[:, 0]])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return texts_n, docs_n, root


def _grouped(n: int, threshold: float):
    """Compare the groups of a partition that is sorted by (band, key, p, q); one group at a time is held."""

    def flush(rows: list[tuple]) -> pa.RecordBatch:
        sets, seen = [], {}
        for low, high in batches([r[1] for r in rows]):
            words = Words([r[1] for r in rows[low:high]])
            hashes, at = shingles(words.hashes, words.at, n)
            for d in range(high - low):
                own = np.unique(hashes[at[d] : at[d + 1]])
                if rows[low + d][0] not in seen and _node(own) == rows[low + d][0]:
                    seen[rows[low + d][0]] = low + d
                    sets.append(own)
        names, own = list(seen), [rows[i] for i in seen.values()]
        if len(own) < 2:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.int64(), pa.int64(), pa.string())], ["node", "n_texts", "n_docs", "root"])
        texts, docs, root = _compare(sets, np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.array([r[8] for r in own]), own[0][4], threshold)
        with_links = np.flatnonzero(texts)
        return pa.RecordBatch.from_arrays(
            [pa.array([names[i] for i in with_links], pa.string()), pa.array(texts[with_links]), pa.array(docs[with_links]), pa.array([names[root[i]] for i in with_links], pa.string())],
            ["node", "n_texts", "n_docs", "root"])

    def compare(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batch_iter:
            for row in zip(*[batch.column(c).to_pylist() for c in ("node", "text", "bands", "copies", "band", "key", "p", "q", "block")], strict=True):
                if held and held[0][4:8] != row[4:8]:
                    yield flush(held)
                    held = []
                held.append(row)
        if held:
            yield flush(held)

    return compare


def _linked(source: DataFrame, n: int, threshold: float, recall: float = 0.9999, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The signatures of ``source`` (doc_id, text), and a row per node: node, copies, least (its row of least id, null ids
    last), n_texts, n_docs (null without links) and root, the node that names its class."""
    bands, rows = bands_for(threshold, recall)
    signed = settle(signatures(source, n, bands, rows))
    nodes = settle(signed.where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "row2")).alias("least"), F.first("bands").alias("bands")))

    cells = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # Lists of buckets are written before they are joined, so that both sides of a join are plain exchanges and a large bucket
    # can be split among tasks.
    full = settle(cells.groupBy("band", "key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    cells = settle(cells.join(full, ["band", "key"]))
    same = [F.min(F.col("bands")[j]).eqNullSafe(F.max(F.col("bands")[j])) & (F.lit(j) < F.col("band")) for j in range(bands)]
    met = same[0]
    for s in same[1:]:
        met = met | s
    new = settle(cells.join(nodes.select("node", "bands"), "node").groupBy("band", "key").agg(met.alias("met")).where("not met").select("band", "key"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("node"), blocks.cast("bigint")).cast("int")
    members = (
        cells.join(new, ["band", "key"]).withColumn("block", mine)
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .select("node", F.struct("band", "key", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")).alias("at"))
    )
    sent = members.groupBy("node").agg(F.collect_list("at").alias("ats"))
    # One row of each node brings its text; the row key also tells apart rows that repeat an id.
    wanted = nodes.join(sent, "node").select("least.row", "least.row2", "node", "bands", "copies", "ats")
    carried = source.select("text", *_named("doc_id", "text")).join(wanted, ["row", "row2"]).dropDuplicates(["row", "row2"])
    groups = carried.select("node", "text", "bands", "copies", F.explode("ats").alias("at")).select("node", "text", "bands", "copies", "at.*")
    key = ["band", "key", "p", "q"]
    compared = groups.repartition(*key).sortWithinPartitions(*key).mapInArrow(_grouped(n, threshold), "node string, n_texts bigint, n_docs bigint, root string")
    links = settle(compared)
    roots = components(links.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = links.groupBy("node").agg(F.sum("n_texts").alias("n_texts"), F.sum("n_docs").alias("n_docs"))
    per_node = nodes.select("node", "copies", "least").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    return signed, per_node


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, class_id, n_links (other rows with Jaccard similarity of at least ``threshold`` on
    the sets of n-word shingles), n_text_links (those links that go to another set, each set once).

    class_id is the least doc_id among the rows connected by links. A text of one to n-1 words is one shingle; rows
    without words have no links and their own id as class. Null ids take part; a class of null ids alone has a null class.
    Repeated rows are copies of each other. Case of A-Z is ignored, other columns too. An empty input gives no rows.

    1. Rows with equal shingle sets collapse to one node with a count, so copies cost nothing further.
    2. Nodes are shuffled on band hashes. Buckets of one node, or whose members all met in one earlier band, are dropped.
    3. Members go to the remaining buckets with their text; a bucket over ``block`` members is cut into blocks and each pair of
       blocks is compared on its own. Pairs are never rows: each comparison emits at most one row per member, with
       the count of its links and one edge that keeps the group's links connected.
    4. Components of those edges are the classes.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed, per_node = _linked(source, n, threshold, recall, block)
    per_class = per_node.groupBy("root").agg(F.min("least").alias("first"))
    per_node = per_node.join(per_class, "root").select("node", F.col("first.doc_id").alias("class_id"), (F.coalesce("n_docs", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("n_texts", F.lit(0)).alias("n_text_links"))
    zero = F.lit(0).cast("bigint")
    return signed.join(per_node, "node", "left").select(
        "doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_text_links", zero).alias("n_text_links"),
    )


def one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each class, with its columns: that of the least id (null ids last) and then of the least hash
    of id and text. Of rows that repeat both id and text one stays; rows without words are classes of their own and all stay."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    _, per_node = _linked(source, n, threshold)
    key = free(docs, "_row", "_row2")
    kept = per_node.groupBy("root").agg(F.min("least").alias("first")).select(*[F.col(f"first.{c}").alias(k) for c, k in zip(("row", "row2"), key, strict=True)])
    words = F.coalesce(F.col(text_col).rlike(WORD), F.lit(False))
    # One exchange by the hash serves both the join and the choice among repeated rows.
    full = docs.where(words).withColumns(dict(zip(key, row_name(id_col, text_col), strict=True))).join(kept, key, "left_semi").dropDuplicates(key).drop(*key)
    return full.union(docs.where(~words))
