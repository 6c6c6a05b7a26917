"""Benchmark decontamination: size-partitioned MinHash containment search for test items inside long documents, and exact
lookup of the shortest ones."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import fresh, settle
from .textvec import Words, batches, minhash_params, segment_minima, shingles

#: Shingles of the smallest window block, and of the longest item that is looked up exactly.
UNIT = 16
#: Items and characters of items that share one index, which bounds what is broadcast: about 200 MB in a worker.
ITEMS_A_PASS, CHARACTERS_A_PASS = 50_000, 32_000_000
HIT = "array<struct<item_id:{id},containment:double>>"


def slots_for(threshold: float, recall: float = 0.999) -> int:
    """Sketch slots so that an item of over UNIT shingles is found with probability ``recall`` in a window that contains it.

    An item has over u/2 and at most u shingles, its windows 2u. With a part ``threshold`` of the item inside, the
    Jaccard similarity is least for the smallest item; each slot agrees with that probability.
    """
    least = threshold * 0.5 / (2 + 0.5 - threshold * 0.5)
    return math.ceil(math.log(1 - recall) / math.log(1 - least))


def _matches(values: np.ndarray, owners: np.ndarray, keys: np.ndarray, items: np.ndarray) -> np.ndarray:
    """(owner, item) of every equal pair of a value and a key; keys are in order."""
    low, high = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
    hit = np.flatnonzero(high > low)
    span = (high - low)[hit]
    cells = np.repeat(low[hit], span) + np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span)
    return np.stack([np.repeat(owners[hit], span), items[cells]], 1)


class ContainmentIndex:
    """Items by size class (up to 2 UNIT, 4 UNIT ... shingles), each with one MinHash sketch of single-value slots.

    Items of up to UNIT shingles are less than half of their windows, so a sketch would miss some. They are indexed by so many
    of their shingles, the rarest among items first, that a text without any of these can't contain enough of the others.
    """

    def __init__(self, ids: list, texts: list, threshold: float, n: int = 5):
        self.ids, self.threshold, self.n, self.params = ids, threshold, n, minhash_params(slots_for(threshold))
        words = Words(texts)
        hashes, at = shingles(words.hashes, words.at, n)
        enough = np.diff(words.at) >= n
        self.sets = [np.unique(hashes[at[i] : at[i + 1]]) if enough[i] else hashes[:0] for i in range(len(ids))]
        self._index_short([i for i, s in enumerate(self.sets) if 0 < len(s) <= UNIT])
        self._index_phrases(words)
        levels: dict[int, list[int]] = {}
        for i, s in enumerate(self.sets):
            if len(s) > UNIT:
                levels.setdefault(max(0, (len(s) - 1) // UNIT).bit_length(), []).append(i)
        self.levels = {}
        for level, items in sorted(levels.items()):
            starts = np.concatenate(([0], np.cumsum([len(self.sets[i]) for i in items])[:-1]))
            mins = segment_minima(np.concatenate([self.sets[i] for i in items]), starts, self.params)
            order = np.argsort(mins, axis=1)
            values, seen = np.take_along_axis(mins, order, 1), np.zeros((len(mins), 1 << 16), bool)
            np.put_along_axis(seen, (values & np.uint64(0xFFFF)).astype(np.int64), True, 1)
            self.levels[level] = (values, np.array(items)[order], seen)

    def _index_phrases(self, words: Words) -> None:
        """Items of fewer than n words are phrases: each has one shingle of its own length, and is found as a whole."""
        self.phrases = {}
        counts = np.diff(words.at)
        for size in range(1, self.n):
            items = np.flatnonzero(counts == size)
            if len(items):
                hashes, at = shingles(words.hashes, words.at, size)
                keys = hashes[at[items]]
                order = np.argsort(keys, kind="stable")
                self.phrases[size] = (keys[order], items[order])

    def _phrases_in(self, words: Words) -> np.ndarray:
        """(document, item) pairs of the phrases in the documents, each once."""
        found = [np.empty((0, 2), np.int64)]
        for size, (keys, items) in self.phrases.items():
            hashes, at = shingles(words.hashes, words.at, size)
            found.append(_matches(hashes, np.searchsorted(at, np.arange(len(hashes)), "right") - 1, keys, items))
        return np.unique(np.concatenate(found), axis=0)

    def _index_short(self, items: list[int]) -> None:
        values, place, often = np.unique(np.concatenate([self.sets[i] for i in items] or [np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        keys, owners, at = [], [], 0
        for i in items:
            size = len(self.sets[i])
            need = next(k for k in range(1, size + 1) if k / size >= self.threshold)
            own = place[at : at + size]
            keys.append(values[own[np.argsort(often[own], kind="stable")[: size - need + 1]]])
            owners += [i] * len(keys[-1])
            at += size
        keys, owners = np.concatenate(keys or [np.empty(0, np.uint64)]), np.array(owners, np.int64)
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << 20, bool)
        seen[(keys & np.uint64(0xFFFFF)).astype(np.int64)] = True
        self.short = (keys[order], owners[order], seen)

    def _short_candidates(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        keys, owners, seen = self.short
        maybe = np.flatnonzero(seen[(hashes & np.uint64(0xFFFFF)).astype(np.int64)]) if len(keys) else np.empty(0, np.int64)
        return _matches(hashes[maybe], np.searchsorted(at, maybe, "right") - 1, keys, owners)

    def candidates(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (document, item) pairs that agree in a slot of some window or share an indexed shingle; ``hashes`` are the documents' shingles in order."""
        counts = np.diff(at)
        docs = np.flatnonzero(counts)
        found: list[np.ndarray] = [self._short_candidates(hashes, at)]
        if not len(docs) or not self.levels:
            return np.unique(found[0], axis=0)
        blocks = -(-counts[docs] // UNIT)
        first = np.concatenate(([0], np.cumsum(blocks)))
        inner = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
        mins = segment_minima(hashes, np.repeat(at[docs], blocks) + inner * UNIT, self.params)
        for level in range(max(self.levels) + 1):
            if level:  # blocks of the next size class are pairs of blocks of this one
                half = -(-blocks // 2)
                here = np.concatenate(([0], np.cumsum(half)))
                pairs = np.repeat(first[:-1], half) + 2 * (np.arange(here[-1]) - np.repeat(here[:-1], half))
                mins, blocks, first = np.minimum.reduceat(mins, pairs, axis=1), half, here
            if level not in self.levels:
                continue
            owner = np.repeat(docs, blocks)
            windows = mins.copy()
            same = np.flatnonzero(owner[1:] == owner[:-1])
            windows[:, same] = np.minimum(mins[:, same], mins[:, same + 1])
            values, items, seen = self.levels[level]
            for slot in range(len(values)):
                maybe = np.flatnonzero(seen[slot][(windows[slot] & np.uint64(0xFFFF)).astype(np.int64)])
                found.append(_matches(windows[slot][maybe], owner[maybe], values[slot], items[slot]))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, texts: list) -> list[list[tuple]]:
        """For each text the items contained in it: (item id, contained part), in order of the items."""
        words = Words(texts)
        hashes, at = shingles(words.hashes, words.at, self.n)
        out: list[list[tuple]] = [[] for _ in texts]
        last, own = -1, None
        for d, i in self.candidates(hashes, at):
            if d != last:
                last, own = d, np.sort(hashes[at[d] : at[d + 1]])
            item = self.sets[i]
            place = np.minimum(np.searchsorted(own, item), len(own) - 1)
            part = float((own[place] == item).mean())
            if part >= self.threshold:
                out[d].append((self.ids[i], part))
        for d, i in self._phrases_in(words):
            out[d].append((self.ids[i], 1.0))
        return out


def _searcher(shared):
    def search(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for series in column:
            texts, hits = series.tolist(), []
            for low, high in batches(texts):
                hits += index.search(texts[low:high])
            yield pd.Series([[{"item_id": a, "containment": b} for a, b in x] for x in hits], index=series.index, dtype=object)

    return search


def _passes(benchmark: DataFrame, text_col: str, items: int, characters: int) -> int:
    row = benchmark.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(text_col)).alias("c")).first()
    return max(1, math.ceil(row["n"] / items), math.ceil((row["c"] or 0) / characters))


def with_items(docs: DataFrame, benchmark: DataFrame, name: str, text_col: str = "text", threshold: float = 0.8, id_col: str = "item_id",
               item_text: str = "text", items_a_pass: int = ITEMS_A_PASS, characters_a_pass: int = CHARACTERS_A_PASS) -> DataFrame:
    """Add the column ``name``: the benchmark items contained in the text (array of item_id and containment), those with at
    least ``threshold`` of their distinct five-word shingles in it. Case of A-Z is ignored.

    An item of one to four words is contained where its words stand in a row. Null or empty texts contain nothing, null or
    empty items are in no text; repeated items are reported once; null item ids are reported as null. Documents of any length
    are searched as a whole. An empty table on either side gives no items.

    Items are few and short beside documents. As long as one index holds them, documents don't move: the index is shipped to
    the tasks. More items than that are dealt by hash to passes of one index each; a pass writes only what it found, by two
    64-bit hashes of the text, so one index is alive at a time; each pass reads the texts once more.
    """
    passes = _passes(benchmark, item_text, items_a_pass, characters_a_pass)
    items = benchmark.select(F.col(id_col).alias("id"), F.col(item_text).alias("text"))
    kind = HIT.format(id=items.schema["id"].dataType.simpleString())
    found = None
    for k in range(passes):
        table = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(passes)) == k).toPandas()
        ids = [None if v is None or v != v else v for v in table["id"].tolist()]
        shared = ship(docs.sparkSession).sparkContext.broadcast(ContainmentIndex(ids, table["text"].tolist(), threshold))
        column = F.array_distinct(F.pandas_udf(_searcher(shared), kind)(F.col(text_col)))
        if passes == 1:
            return docs.withColumn(name, column)
        hits = docs.select(*_key(text_col), column.alias("_hits")).where(F.size("_hits") > 0)
        hits = settle(hits.dropDuplicates(["_a", "_b"]))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    found = found.groupBy("_a", "_b").agg(F.array_distinct(F.flatten(F.collect_list("_hits"))).alias(name))
    return docs.select("*", *_key(text_col)).join(found, ["_a", "_b"], "left").drop("_a", "_b").withColumn(name, F.coalesce(name, F.array().cast(kind)))


def _key(text_col: str) -> list[Column]:
    return [F.xxhash64(text_col).alias("_a"), F.xxhash64(F.lit("text"), text_col).alias("_b")]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.8, **passes: int) -> DataFrame:
    """All rows of ``docs`` with a column ``leaks`` (array of item_id and containment); a column of that name is replaced."""
    return with_items(fresh(docs, "leaks"), benchmark, "leaks", text_col, threshold, **passes)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", threshold: float = 0.8, **passes: int) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with their columns."""
    return with_items(docs, benchmark, "_leaks", text_col, threshold, **passes).where(F.size("_leaks") == 0).drop("_leaks")
