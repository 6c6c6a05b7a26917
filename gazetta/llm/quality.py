"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_split, fresh
from .textvec import Words, batches, shingles

#: Labelled rows that the trees are fitted on at most; the rest of the work covers all rows.
SAMPLE = 20_000
BINS, TREES, DEPTH, RATE, RIDGE = 64, 80, 4, 0.15, 1.0

#: Statistics of a document, in order.
STATISTICS = (
    "log_bytes", "log_words", "word_length", "long_words", "short_words", "upper", "digits", "marks", "symbols", "bangs", "bars", "spaces", "newlines",
    "beyond_ascii", "distinct_words", "next_same", "distinct_pairs", "most_common", "distinct_lines", "line_length", "ends_in_symbol", "no_letter", "distinct_bytes",
)

_UPPER, _DIGIT, _MARK, _SYMBOL, _BANG, _BAR, _SPACE, _NEWLINE, _HIGH, _LOWER = range(10)
_KIND = np.full(256, _MARK)
_KIND[ord("A") : ord("Z") + 1], _KIND[ord("a") : ord("z") + 1], _KIND[ord("0") : ord("9") + 1], _KIND[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_KIND[[ord(c) for c in "#$%&*@^~=+<>_\\/"]] = _SYMBOL
_KIND[[ord(c) for c in "!?"]], _KIND[ord("|")], _KIND[[*range(9)]], _KIND[[32, 9, 11, 12, 13]], _KIND[10] = _BANG, _BAR, _SYMBOL, _SPACE, _NEWLINE


def _distinct(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: how many distinct values, and how often the most common one occurs."""
    n = len(at) - 1
    owner = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])))) if len(v) else np.empty(0, np.int64)
    most = np.zeros(n)
    np.maximum.at(most, o[first], np.diff(np.append(first, len(v))))
    return np.bincount(o[first], minlength=n), most


def statistics(texts: list) -> np.ndarray:
    """One row of STATISTICS a text; a null or empty text has zeros but for ratios of nothing, which are zero too."""
    words = Words(texts)
    n, sizes = len(texts), np.diff(words.at)
    owner = np.repeat(np.arange(n), words.sizes + 1)[: len(words.plain)]
    kinds = np.bincount(owner * 10 + _KIND[words.plain], minlength=n * 10).reshape(n, 10).astype(float)
    kinds[: n - 1, _NEWLINE] -= 1  # the newline that joins texts
    own = np.ones(len(words.plain), bool)
    own[words.doc_at[1:-1] - 1] = False  # likewise
    seen = np.zeros((n, 256), bool)
    seen[owner[own], words.plain[own]] = True
    of, length = words.doc_of(), words.ends - words.starts
    last, per_word = _KIND[words.plain[words.ends - 1]], lambda mask: np.bincount(of[mask], minlength=n)
    letters = np.concatenate(([0], np.cumsum(np.isin(_KIND[words.plain], (_UPPER, _LOWER, _HIGH)))))
    same = np.flatnonzero((words.hashes[1:] == words.hashes[:-1]) & (of[1:] == of[:-1])) if len(of) else np.empty(0, np.int64)
    pairs, pair_at = shingles(words.hashes, words.at, 2)
    distinct, most = _distinct(words.hashes, words.at)
    distinct_pairs, _ = _distinct(pairs, pair_at)
    # Lines: a hash of the words between newlines.
    breaks = np.concatenate(([0], np.cumsum(words.plain == 10)))
    line = breaks[words.starts]
    starts = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (of[1:] != of[:-1])))) if len(of) else np.empty(0, np.int64)
    spots = (np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of)))) + 1).astype(np.uint64) if len(of) else np.empty(0, np.uint64)
    line_hash = np.add.reduceat(words.hashes * (spots * np.uint64(2) + np.uint64(1)), starts) if len(starts) else words.hashes[:0]
    lines = np.bincount(of[starts], minlength=n)
    distinct_lines, _ = _distinct(line_hash, np.concatenate(([0], np.cumsum(lines))))
    size, count, n_lines = np.maximum(words.sizes, 1), np.maximum(sizes, 1), np.maximum(lines, 1)
    letter = np.maximum(kinds[:, _UPPER] + kinds[:, _LOWER] + kinds[:, _HIGH] / 2, 1)
    return np.stack([
        np.log1p(words.sizes), np.log1p(sizes), np.bincount(of, length, minlength=n) / count, per_word(length > 12) / count, per_word(length <= 3) / count,
        kinds[:, _UPPER] / letter, kinds[:, _DIGIT] / size, kinds[:, _MARK] / count, kinds[:, _SYMBOL] / count, kinds[:, _BANG] / count, kinds[:, _BAR] / count,
        kinds[:, _SPACE] / size, kinds[:, _NEWLINE] / count, kinds[:, _HIGH] / size, distinct / count, np.bincount(of[same], minlength=n) / count,
        distinct_pairs / np.maximum(np.diff(pair_at), 1), most / count, distinct_lines / n_lines, sizes / n_lines,
        per_word((last == _SYMBOL) | (last == _BANG)) / count, per_word(letters[words.ends] == letters[words.starts]) / count, seen.sum(1),
    ], 1)


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: node k of a tree has children 2k+1 and 2k+2."""

    edges: list[np.ndarray]
    feature: np.ndarray
    split: np.ndarray
    leaf: np.ndarray
    base: float

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        bins, rows = self.binned(x), np.arange(len(x))
        total, depth = np.full(len(x), self.base), self.leaf.shape[1].bit_length() - 1
        for tree in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (bins[rows, self.feature[tree, node]] > self.split[tree, node])
            total += self.leaf[tree, node - (self.leaf.shape[1] - 1)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_trees(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Trees:
    """Boost trees on the logistic loss; splits are sought on histograms of gradients over quantile bins."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    prior = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
    inner, leaves = 2**depth - 1, 2**depth
    model = Trees(edges, np.zeros((trees, inner), np.int64), np.full((trees, inner), 255, np.int64), np.zeros((trees, leaves)), float(np.log(prior / (1 - prior))))
    bins, margin = model.binned(x).astype(np.int64), np.full(len(y), model.base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h, node = y - p, p * (1 - p), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for j in range(x.shape[1]):
                cell = (node - first) * BINS + bins[:, j]
                gs = np.bincount(cell, g, width * BINS).reshape(width, BINS).cumsum(1)
                hs = np.bincount(cell, h, width * BINS).reshape(width, BINS).cumsum(1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + RIDGE) + (gt - gs) ** 2 / (ht - hs + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hs < 2) | (ht - hs < 2)] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = np.flatnonzero(top > best)
                best[better] = top[better]
                model.feature[t, first + better], model.split[t, first + better] = j, at[better]
            node = 2 * node + 1 + (bins[np.arange(len(y)), model.feature[t, node]] > model.split[t, node])
        leaf = node - inner
        model.leaf[t] = rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += model.leaf[t, leaf]
    return model


def _stats_udf(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for series in column:
        texts = series.tolist()
        rows = np.concatenate([statistics(texts[a:b]) for a, b in batches(texts)]) if texts else np.empty((0, len(STATISTICS)))
        yield pd.Series(list(rows), index=series.index, dtype=object)


def _scorer(shared):
    def score(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        for series in column:
            texts = series.tolist()
            yield pd.Series(np.concatenate([model.score(statistics(texts[a:b])) for a, b in batches(texts)]) if texts else np.empty(0), index=series.index, dtype=float)

    return score


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``rows`` labelled documents, those of the least hash; ids and labels that are null are
    left out, an id with several labels counts with the greatest, one with several texts with the least text. Only ids and
    labels are sorted; their list is bounded."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(usable).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))


def train(docs: DataFrame, labels: DataFrame, held: Column, label: str = "quality", rows: int = SAMPLE) -> Trees:
    """Fit on statistics computed where the documents are; at most ``rows`` rows of numbers reach the driver."""
    ship(docs.sparkSession)
    sample = labelled_sample(docs, labels, label, ~held, rows)
    found = sample.select("doc_id", F.pandas_udf(_stats_udf, "array<double>")("text").alias("x"), "y").toPandas().sort_values("doc_id")
    if not len(found):
        return fit_trees(np.zeros((1, len(STATISTICS))), np.ones(1), trees=0)
    return fit_trees(np.stack(found["x"].to_numpy()), found["y"].to_numpy())


def score_quality(docs: DataFrame, model: Trees, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) and ``predicted``; clashing columns are replaced, rows don't move. Null and
    empty texts get the score of an empty document."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(model)
    scored = fresh(docs, "score", "predicted").withColumn("score", F.pandas_udf(_scorer(shared), "double")(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Score all documents with trees fitted on the labelled documents that are not held out."""
    held = crc_split(F.col("doc_id"), modulus, remainder)
    return score_quality(docs, train(docs, labels, held)).withColumn("held_out", held)
