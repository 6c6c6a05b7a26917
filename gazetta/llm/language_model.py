"""Language-model scoring: a log-bilinear model in numpy, trained by noise-contrastive estimation on shards of the corpus.

The outputs are the WORDS most frequent tokens and ENDINGS classes of all others by their last bytes. Words are put into
classes by the company they keep; the model gives the class after the tokens before it, then the word inside the class, each
normalised by matrix products over all classes and over all words of a class. Inside a class of other words a token has its
add-one share of the training tokens, with one more part for words never seen. Token counts are exact, cover the whole
training corpus, and stay distributed; what is shipped to tasks is the table of tokens that make up at least one part in
FREQUENT of the corpus, of which there can't be more than that.

Documents are dealt to shards of about SHARD tokens by a hash of id and text and trained on in the order of that hash, so
results do not depend on how the input is laid out in files and partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_split, settle
from .textvec import Words, batches, mix

#: Words with an output of their own at most and the least count of one, classes of other words, and the size of the shipped table.
WORDS, LEAST, ENDINGS, FREQUENT = 1 << 14, 5, 64, 2_000_000
#: Most frequent words whose places before and after a word say what company it keeps.
COMPANY = 32
#: Vector size, preceding positions with weights of their own, and the length of the averaged context before.
SIZE, POSITIONS, SPAN = 16, 3, 16
#: Training on every position of all training documents: positions of a step, noise classes a step, noise words of a class, step size.
BATCH, CLASS_NOISE, WORD_NOISE, LEARN = 4096, 32, 6, 0.1
#: Tokens of a shard, and the sixteenths of its documents after which the shards' models are averaged.
SHARD, ROUNDS = 4_000_000, (1, 4, 16)
#: Vectors that one task adds at most for each of their parts.
FAN = 64
#: The token that ends each document.
END = np.uint64(0xE0D0_F0D0_C0DE_0001)
_HELD, _PART, _CHUNK = 1_000_000, 1 << 14, 1 << 16


class Sequence:
    """Tokens of a batch of texts, each with its end token: hashes, ending classes, and offsets of the texts."""

    def __init__(self, texts: list):
        words = Words(texts)
        counts = np.diff(words.at)
        self.at = np.concatenate(([0], np.cumsum(counts + 1)))
        spot = np.arange(len(words.hashes)) + np.repeat(np.arange(len(counts)), counts)
        self.tokens = np.full(self.at[-1], END)
        self.tokens[spot] = words.hashes
        code = np.zeros(len(words.hashes), np.uint64)
        for back in (1, 2, 3):
            inside = words.ends - back >= words.starts
            code = code * np.uint64(257) + np.where(inside, words.buf[np.maximum(words.ends - back, 0)], 0).astype(np.uint64)
        self.kinds = np.zeros(self.at[-1], np.int64)
        self.kinds[spot] = (mix(code + np.uint64(1)) % np.uint64(ENDINGS)).astype(np.int64)


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    tokens, first, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    return tokens, np.concatenate([p[1] for p in parts])[first], np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, kind, n) of all texts of ``docs``: counted where the texts are, in tables of bounded size, then summed."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            tokens, kinds, n = _merged(held)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(kinds), pa.array(n)], ["token", "kind", "n"])

        for batch in stream:
            texts = batch.column("text").to_pylist()
            for low, high in batches(texts):
                s = Sequence(texts[low:high])
                held.append(_merged([(s.tokens, s.kinds, np.ones(len(s.tokens)))]))
                if sum(len(h[0]) for h in held) > _HELD:
                    held = [_merged(held)]
                    if len(held[0][0]) > _HELD / 2:
                        yield out()
                        held = []
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "token bigint, kind bigint, n bigint").groupBy("token").agg(F.max("kind").alias("kind"), F.sum("n").alias("n"))


@dataclass
class Corpus:
    """Counts of the training corpus: N tokens, V distinct ones, the frequent ones in order of their hashes, the words that are
    outputs (``unit_of``: number by count of each of ``top``), and totals of the units: words by count, then ending classes."""

    total: int
    distinct: int
    tokens: np.ndarray
    counts: np.ndarray
    top: np.ndarray
    unit_of: np.ndarray
    unit_total: np.ndarray
    unit_distinct: np.ndarray

    @property
    def words(self) -> int:
        return len(self.top)

    def units(self, s: Sequence) -> np.ndarray:
        if not len(self.top):
            return s.kinds.copy()
        place = np.minimum(np.searchsorted(self.top, s.tokens), len(self.top) - 1)
        return np.where(self.top[place] == s.tokens, self.unit_of[place], len(self.top) + s.kinds)


def corpus_of(counts: DataFrame) -> Corpus:
    """Aggregates and the bounded list of frequent tokens reach the driver."""
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("distinct")).first()
    total, distinct = row["total"], row["distinct"]
    often = counts.where(F.col("n") >= max(1.0, total / FREQUENT)).select("token", "kind", "n").toPandas()
    tokens, n, kinds = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64), often["kind"].to_numpy(np.int64)
    order = np.argsort(tokens)
    tokens, n, kinds = tokens[order], n[order], kinds[order]
    ranked = np.lexsort((tokens, -n))[:WORDS]
    ranked = ranked[n[ranked] >= LEAST]
    unit_of = np.argsort(np.argsort(tokens[ranked]))
    unit = np.empty(len(ranked), np.int64)
    unit[unit_of] = np.arange(len(ranked))
    found = counts.groupBy("kind").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toPandas()
    others, kinds_of = np.zeros((2, ENDINGS)), found["kind"].to_numpy(np.int64)
    others[0, kinds_of], others[1, kinds_of] = found["n"], found["v"]
    others[0] -= np.bincount(kinds[ranked], n[ranked], ENDINGS)
    others[1] -= np.bincount(kinds[ranked], minlength=ENDINGS)
    return Corpus(int(total), int(distinct), tokens, n, np.sort(tokens[ranked]), unit, np.concatenate((n[ranked], others[0])), np.concatenate((np.ones(len(ranked)), others[1])))


def encode(docs: DataFrame, corpus: Corpus) -> DataFrame:
    """Tokenise once: instead of text the columns _units (two bytes a token), _n, _known (tokens of the shipped table), _log (log10
    of their counts plus one), _tail (the same over tokens that are no outputs) and _rare (the tokens outside the table)."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(corpus)
    own = [f for f in docs.schema.fields if f.name != "text"]
    made = {"_units": pa.binary(), "_n": pa.int64(), "_known": pa.int64(), "_log": pa.float64(), "_tail": pa.float64(), "_rare": pa.list_(pa.int64())}

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        corpus = shared.value
        logs = np.log10(corpus.counts + 1.0)
        for batch in stream:
            texts, out = batch.column("text").to_pylist(), [[] for _ in made]
            for low, high in batches(texts, 1 << 20):
                s = Sequence(texts[low:high])
                units = corpus.units(s)
                log, known = np.zeros(len(units)), np.zeros(len(units), bool)
                if len(corpus.tokens):
                    place = np.minimum(np.searchsorted(corpus.tokens, s.tokens), len(corpus.tokens) - 1)
                    known = corpus.tokens[place] == s.tokens
                    log[known] = logs[place[known]]
                rare = np.flatnonzero(~known)
                short = units.astype(np.uint16)
                cells = [short[a:b].tobytes() for a, b in zip(s.at[:-1], s.at[1:], strict=True)]
                sums = [np.add.reduceat(x, s.at[:-1]) for x in (known.astype(np.int64), log, np.where(units >= corpus.words, log, 0.0))]
                lists = np.split(s.tokens[rare].view(np.int64), np.searchsorted(rare, s.at)[1:-1])
                for k, values in enumerate((cells, np.diff(s.at), *sums, lists)):
                    out[k].extend(values)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *(pa.array(v, t) for v, t in zip(out, made.values(), strict=True))], [*(f.name for f in own), *made])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "_units binary, _n bigint, _known bigint, _log double, _tail double, _rare array<bigint>"])
    return docs.mapInArrow(run, schema)


def _parts(vector: np.ndarray, owner: int, weight: float) -> pa.RecordBatch:
    """A vector as rows of _PART values, to be summed by ``summed``."""
    cut = [vector[i : i + _PART] for i in range(0, len(vector), _PART)]
    return pa.RecordBatch.from_arrays(
        [pa.array(range(len(cut)), pa.int32()), pa.array([owner] * len(cut), pa.int64()), pa.array([weight] * len(cut), pa.float64()), pa.array([c.tobytes() for c in cut], pa.binary())],
        ["part", "owner", "w", "v"])


_PARTS = "part int, owner bigint, w double, v binary"


def summed(parts: DataFrame, kind: str, owners: int, fan: int = FAN) -> np.ndarray | None:
    """Weighted mean of vectors that came as rows of _PARTS (``kind``: type of a value) from owners 0 to ``owners`` - 1, always in order
    of their owners. None without rows.

    Vectors are added in levels, ``fan`` owners of neighbouring numbers at a time, where the parts of these owners meet; so the rows of a
    key don't grow with the number of owners, and one vector reaches the driver.
    """

    def add(first: bool):
        def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total, sums = None, 0.0, None
            for batch in stream:
                for part, group, w, v in zip(*[batch.column(c).to_pylist() for c in ("part", "group", "w", "v")], strict=True):
                    if now != (part, group):
                        if now:
                            yield _row(*now, total, sums)
                        now, total, sums = (part, group), 0.0, 0.0
                    value = np.frombuffer(v, kind).astype(np.float64) * w if first else np.frombuffer(v)
                    total, sums = total + w, sums + value
            if now:
                yield _row(*now, total, sums)

        return run

    level = 0
    while level == 0 or owners > 1:
        grouped = parts.withColumn("group", F.floor(F.col("owner") / fan).cast("bigint"))
        key = ["part", "group"]
        parts = grouped.repartition(*key).sortWithinPartitions(*key, "owner").mapInArrow(add(level == 0), _PARTS)
        owners, level = -(-owners // fan), level + 1
    rows = parts.toPandas().sort_values("part")
    return np.concatenate([np.frombuffer(v) / w for v, w in zip(rows["v"], rows["w"], strict=True)]) if len(rows) else None


def _row(part: int, owner: int, weight: float, vector: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([owner], pa.int64()), pa.array([weight]), pa.array([vector.tobytes()], pa.binary())], ["part", "owner", "w", "v"])


def company(encoded: DataFrame, words: int) -> np.ndarray:
    """How often each of the first COMPANY words stands right before and right after each word, as a matrix of a row a word;
    all cells divided by one number."""

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(words * 2 * COMPANY, np.int64)
        for batch in stream:
            held = [np.frombuffer(u, np.uint16) for u in batch.column("_units").to_pylist()]
            units = np.concatenate(held).astype(np.int64) if held else np.empty(0, np.int64)
            left, right = units[:-1], units[1:]
            inside = np.ones(max(len(units) - 1, 0), bool)
            inside[np.cumsum([len(h) for h in held])[:-1] - 1] = False
            for word, near, shift in ((left, right, 0), (right, left, COMPANY)):
                fit = inside & (word < words) & (near < COMPANY)
                code, n = np.unique(word[fit] * 2 * COMPANY + shift + near[fit], return_counts=True)
                cells[code] += n
        if cells.any():
            yield _parts(cells.astype(np.int32), TaskContext.get().partitionId(), 1.0)

    told = encoded.select("_units")
    found = summed(told.mapInArrow(count, _PARTS), "i4", told.rdd.getNumPartitions())
    return np.zeros((words, 2 * COMPANY)) if found is None else found.reshape(words, 2 * COMPANY)


def classes_of(features: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, at): words in order of their classes, and where each class begins. About as many classes as words in a class: the
    words are halved again and again across the direction in which their company (square roots of shares) varies most."""
    x = np.sqrt(features / np.maximum(features.sum(1, keepdims=True), 1e-12))
    groups = [np.arange(len(x))] if len(x) else []
    for _ in range(max(0, int(np.log2(max(len(x), 1)) / 2))):
        halves = []
        for g in groups:
            part = x[g] - np.average(x[g], 0, counts[g])
            axis = np.linalg.eigh((part * counts[g][:, None]).T @ part)[1][:, -1]
            ranked = g[np.lexsort((g, np.round(part @ axis, 9)))]
            halves += [np.sort(ranked[: len(g) // 2]), np.sort(ranked[len(g) // 2 :])]
        groups = [g for g in halves if len(g)]
    return np.concatenate(groups) if groups else np.empty(0, np.int64), np.concatenate(([0], np.cumsum([len(g) for g in groups]))).astype(np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _groups(ordered: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(ordered) else np.empty(0, np.int64)


class LogBilinear:
    """score(output | context) = (sum of weighted context vectors) . target vector + bias, for classes, and for words of a class.

    Slots are units in the order of their classes: words first, then the classes of other words, each a slot of its own.
    """

    def __init__(self, unit_total: np.ndarray, order: np.ndarray, at: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (0.1 * rng.standard_normal(shape)).astype(np.float32)
        self.words, others, self.at = len(order), len(unit_total) - len(order), at
        self.slot = np.empty(len(unit_total), np.uint16)
        self.slot[order], self.slot[self.words :] = np.arange(self.words), np.arange(self.words, len(unit_total))
        size = np.diff(at)
        self.kind = np.concatenate((np.repeat(np.arange(len(size)), size), len(size) + np.arange(others)))
        n = np.concatenate((unit_total[order], unit_total[self.words :])) + 0.5
        of_class = np.bincount(self.kind, n)
        self.class_share = of_class / of_class.sum()
        self.word_share = n[: self.words] / of_class[self.kind[: self.words]]
        self.class_edges = np.cumsum(self.class_share)
        inside = np.cumsum(self.word_share)
        self.word_edges = inside - np.repeat(np.concatenate(([0.0], inside))[at[:-1]], size) + self.kind[: self.words]
        self.p = {
            "context": draw(len(unit_total) + 1, SIZE), "weights": np.ones((POSITIONS + 1, SIZE), np.float32),
            "class": draw(len(of_class), SIZE), "class_bias": np.log(self.class_share).astype(np.float32),
            "word": draw(self.words, SIZE), "word_bias": np.log(self.word_share).astype(np.float32),
        }

    def vector(self) -> np.ndarray:
        return np.concatenate([v.ravel() for v in self.p.values()])

    def load(self, vector: np.ndarray) -> LogBilinear:
        at = 0
        for k, v in self.p.items():
            self.p[k] = vector[at : at + v.size].reshape(v.shape).astype(np.float32)
            at += v.size
        return self

    def memory(self) -> dict[str, np.ndarray]:
        return {k: np.full_like(v, 1e-4) for k, v in self.p.items()}

    def hidden(self, slots: np.ndarray, start: np.ndarray, low: int, high: int) -> tuple[np.ndarray, dict]:
        """Context vectors of the positions low to high; ``start`` is where each position's document begins. Also what the
        gradient needs."""
        c, w = self.p["context"], self.p["weights"]
        a = max(int(start[low]), low - SPAN)
        ids = slots[a:high]
        e = np.concatenate((c[ids], c[-1:]))
        pos, first = np.arange(low - a, high - a), np.maximum(start[low:high] - a, 0)
        far_from = np.maximum(first, pos - SPAN)
        sums = np.zeros((len(e), SIZE))
        np.cumsum(e[:-1], axis=0, out=sums[1:])
        length = np.maximum(pos - far_from, 1).astype(np.float32)[:, None]
        far = (sums[pos] - sums[far_from]).astype(np.float32) / length
        h = far * w[POSITIONS]
        near = []
        for k in range(POSITIONS):
            ok = pos - k - 1 >= first
            near.append((e[np.where(ok, pos - k - 1, len(ids))], ok))
            h += near[-1][0] * w[k]
        return h, {"ids": ids, "pos": pos, "far": far, "far_from": far_from, "length": length, "near": near}

    def log_probabilities(self, slots: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log of the probability of each slot after those before it: of its class, and for words of the word inside it."""
        start = np.repeat(at[:-1], np.diff(at))
        out = np.empty(len(slots), np.float64)
        for low in range(0, len(slots), 1 << 15):
            high = min(low + (1 << 15), len(slots))
            h, _ = self.hidden(slots, start, low, high)
            order = np.argsort(slots[low:high], kind="stable")
            own, h = slots[low:high][order].astype(np.int64), h[order]
            value = np.empty(len(own), np.float32)
            kind = self.kind[own]
            for a in range(0, len(own), 4096):
                part = slice(a, a + 4096)
                logits = h[part] @ self.p["class"].T
                logits += self.p["class_bias"]
                mine = logits[np.arange(len(logits)), kind[part]].copy()
                value[part] = mine - _log_total(logits)
            words = int(np.searchsorted(own, self.words))
            cuts = np.append(_groups(kind[:words]), words)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                x, y = self.at[kind[a]], self.at[kind[a] + 1]
                logits = h[a:b] @ self.p["word"][x:y].T
                logits += self.p["word_bias"][x:y]
                mine = logits[np.arange(b - a), own[a:b] - x].copy()
                value[a:b] += mine - _log_total(logits)
            out[low + order] = value
        return out

    def _step(self, name: str, memory: dict, rows: np.ndarray, gradient: np.ndarray) -> None:
        """Adagrad on distinct rows."""
        m = memory[name][rows] + gradient * gradient
        memory[name][rows] = m
        self.p[name][rows] -= LEARN * gradient / np.sqrt(m)

    def train(self, slots: np.ndarray, at: np.ndarray, rng: np.random.Generator, memory: dict[str, np.ndarray]) -> int:
        """Noise-contrastive steps over every position, BATCH at a time in order; noise is shared by a step."""
        start = np.repeat(at[:-1], np.diff(at))
        p, classes = self.p, len(self.at) - 1
        log_class, log_word = np.log(CLASS_NOISE * self.class_share).astype(np.float32), np.log(WORD_NOISE * self.word_share).astype(np.float32)
        for low in range(0, len(slots), BATCH):
            high = min(low + BATCH, len(slots))
            h0, c = self.hidden(slots, start, low, high)
            order = np.argsort(slots[low:high], kind="stable")
            own, h = slots[low:high][order].astype(np.int64), h0[order]
            kind = self.kind[own]
            # Classes: the own one against shared noise.
            noise = np.minimum(np.searchsorted(self.class_edges, rng.random(CLASS_NOISE)), len(self.class_share) - 1)
            q, qn = p["class"][kind], p["class"][noise]
            gd = _sigmoid(np.einsum("bd,bd->b", h, q) + p["class_bias"][kind] - log_class[kind]) - 1
            gf = _sigmoid(h @ qn.T + (p["class_bias"][noise] - log_class[noise]))
            dh = gd[:, None] * q + gf @ qn
            cut = _groups(kind)
            rows = np.concatenate((kind[cut], noise))
            g = np.concatenate((np.add.reduceat(gd[:, None] * h, cut), gf.T @ h))
            gb = np.concatenate((np.add.reduceat(gd, cut), gf.sum(0)))
            # Words inside their classes: the own one against noise words shared by the positions of the class.
            words = int(np.searchsorted(own, self.words))
            if words:
                hw, kw, ow = h[:words], kind[:words], own[:words]
                noisy = np.minimum(np.searchsorted(self.word_edges, np.arange(classes)[:, None] + rng.random((classes, WORD_NOISE))), self.at[1:, None] - 1)
                qw, qk = p["word"][ow], p["word"][noisy][kw]
                wd = _sigmoid(np.einsum("bd,bd->b", hw, qw) + p["word_bias"][ow] - log_word[ow]) - 1
                wf = _sigmoid(np.einsum("bd,bkd->bk", hw, qk) + (p["word_bias"][noisy] - log_word[noisy])[kw])
                dh[:words] += wd[:, None] * qw + np.einsum("bk,bkd->bd", wf, qk)
                cut, cut_class = _groups(ow), _groups(kw)
                of_noise = np.add.reduceat((wf[:, :, None] * hw[:, None, :]).reshape(words, -1), cut_class).reshape(-1, SIZE)
                word_rows = np.concatenate((ow[cut], noisy[kw[cut_class]].ravel()))
                self._add("word", "word_bias", memory, word_rows, np.concatenate((np.add.reduceat(wd[:, None] * hw, cut), of_noise)),
                          np.concatenate((np.add.reduceat(wd, cut), np.add.reduceat(wf, cut_class).ravel())))
            self._add("class", "class_bias", memory, rows, g, gb)
            back = np.empty_like(dh)
            back[order] = dh
            self._step_contexts(c, back, memory)
        return len(slots)

    def _add(self, name: str, bias: str, memory: dict, rows: np.ndarray, g: np.ndarray, gb: np.ndarray) -> None:
        order = np.argsort(rows, kind="stable")
        cut = _groups(rows[order])
        distinct = rows[order][cut]
        self._step(name, memory, distinct, np.add.reduceat(g[order], cut))
        self._step(bias, memory, distinct, np.add.reduceat(gb[order], cut))

    def _step_contexts(self, c: dict, dh: np.ndarray, memory: dict) -> None:
        """Gradients of the context vectors: what stands at each position is summed first, then by slot."""
        w, pos, m = self.p["weights"], c["pos"], len(c["ids"])
        g, gw = np.zeros((m + 1, SIZE), np.float32), np.zeros((POSITIONS + 1, SIZE), np.float32)
        gw[POSITIONS] = np.einsum("bd,bd->d", dh, c["far"])
        share = dh * w[POSITIONS] / c["length"]
        share[c["far_from"] == pos] = 0
        cut = _groups(c["far_from"])
        g[c["far_from"][cut]] += np.add.reduceat(share, cut)
        g[pos] -= share
        g = np.cumsum(g, axis=0)
        g[m] = 0
        for k, (vector, ok) in enumerate(c["near"]):
            d = dh * w[k]
            gw[k] = np.einsum("bd,bd->d", dh, vector)
            g[m] += d[~ok].sum(0)
            if ok.all():  # distinct positions side by side
                g[pos[0] - k - 1 : pos[-1] - k] += d
            else:
                g[pos[ok] - k - 1] += d[ok]
        ids = np.append(c["ids"], len(self.p["context"]) - 1).astype(np.uint16 if len(self.p["context"]) < 1 << 16 else np.int64)
        order = np.argsort(ids, kind="stable")
        cut = _groups(ids[order])
        self._step("context", memory, ids[order][cut].astype(np.int64), np.add.reduceat(g[order], cut))
        self._step("weights", memory, np.arange(POSITIONS + 1), gw)


def _log_total(logits: np.ndarray) -> np.ndarray:
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    return np.log(logits.sum(1))


def _by_shard(model_of: Callable[[], LogBilinear], seed: int):
    """Train on a partition that is sorted by (shard, key): one model a shard, from the same start, emitted with its positions."""

    def fit(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, model, rng, memory, held, size, seen = None, None, None, None, [], 0, 0

        def flush() -> int:
            units = model.slot[np.concatenate(held)]
            return model.train(units, np.concatenate(([0], np.cumsum([len(h) for h in held]))), rng, memory)

        for batch in stream:
            for shard, units in zip(batch.column("shard").to_pylist(), batch.column("_units").to_pylist(), strict=True):
                if shard != now:
                    if held:
                        seen += flush()
                    if seen:
                        yield _parts(model.vector(), now, float(seen))
                    now, model, rng, held, size, seen = shard, model_of(), np.random.default_rng((seed, shard)), [], 0, 0
                    memory = model.memory()
                held.append(np.frombuffer(units, np.uint16))
                size += len(held[-1])
                if size >= _CHUNK:
                    seen += flush()
                    held, size = [], 0
        if held:
            seen += flush()
        if seen:
            yield _parts(model.vector(), now, float(seen))

    return fit


def train(encoded: DataFrame, key: Column, corpus: Corpus, shard: int = SHARD, fan: int = FAN) -> LogBilinear:
    """Rounds over the encoded training documents: every shard of about ``shard`` tokens trains on its next part from the mean of all
    shards' models, which is weighted by positions. Every document is in one round."""
    spark = ship(encoded.sparkSession)
    order, at = classes_of(company(encoded, corpus.words), corpus.unit_total[: corpus.words])
    model = LogBilinear(corpus.unit_total, order, at)
    shards = max(1, -(-corpus.total // shard))
    rows = encoded.select(F.xxhash64(key, "_units").alias("key"), "_units")
    rows = rows.select(F.pmod("key", F.lit(shards)).alias("shard"), F.pmod(F.shiftright("key", 40), F.lit(ROUNDS[-1])).alias("turn"), "key", "_units")
    for number, (low, high) in enumerate(zip((0, *ROUNDS[:-1]), ROUNDS, strict=True)):
        shared = spark.sparkContext.broadcast(model)
        mine = rows.where((F.col("turn") >= low) & (F.col("turn") < high)).repartition("shard").sortWithinPartitions("shard", "key")
        found = summed(mine.select("shard", "_units").mapInArrow(_by_shard(_copier(shared), number), _PARTS), "f4", shards, fan)
        if found is not None:
            model = model.load(found)
    return model


def _copier(shared) -> Callable[[], LogBilinear]:
    def make() -> LogBilinear:
        start = shared.value
        model = LogBilinear.__new__(LogBilinear)
        model.__dict__.update(start.__dict__)
        model.p = {k: v.copy() for k, v in start.p.items()}
        return model

    return make


def score_texts(encoded: DataFrame, counts: DataFrame, corpus: Corpus, model: LogBilinear) -> DataFrame:
    """Columns of ``encoded`` without its own, with n_tokens, n_known, train_tokens, base_score and score.

    Tokens outside the shipped table are looked up in the distributed counts; none of them is a hot key.
    """
    shared = ship(encoded.sparkSession).sparkContext.broadcast((np.log10(corpus.unit_total + corpus.unit_distinct + 1), model))
    own = [f.name for f in encoded.schema.fields if not f.name.startswith("_")]

    def score(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, model = shared.value
        inside = np.where(np.arange(len(inside)) < model.words, 0, inside)
        for batch in stream:
            texts, tail = [np.frombuffer(u, np.uint16) for u in batch.column("_units").to_pylist()], batch.column("_tail").to_numpy(zero_copy_only=False)
            sizes, values = np.array([len(t) for t in texts], np.int64), np.empty(len(texts))
            low = 0
            while low < len(texts):
                high = low + max(1, int(np.searchsorted(np.cumsum(sizes[low:]), 1 << 19, "right")))
                units, at = np.concatenate(texts[low:high]), np.concatenate(([0], np.cumsum(sizes[low:high])))
                each = model.log_probabilities(model.slot[units], at) / np.log(10) - inside[units]
                values[low:high] = np.add.reduceat(each, at[:-1])
                low = high
            kept = [batch.column(c) for c in (*own, "_n", "_known", "_log", "_rare")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(values + tail)], [*own, "_n", "_known", "_log", "_rare", "_value"])

    kinds = [f for f in encoded.schema.fields if f.name not in ("_units", "_tail")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kinds] + ["_value double"])
    scored = settle(encoded.select(*[f"`{c}`" for c in own], "_n", "_known", "_log", "_rare", "_units", "_tail").mapInArrow(score, schema)).withColumn("_row", F.monotonically_increasing_id())
    looked = (
        scored.select("_row", F.explode("_rare").alias("token")).join(counts.select("token", "n"), "token")
        .groupBy("_row").agg(F.count(F.lit(1)).alias("_more"), F.sum(F.log10(F.col("n") + 1.0)).alias("_sum"))
    )
    joined = scored.drop("_rare").join(looked, "_row", "left")
    log_sum, more = F.coalesce("_sum", F.lit(0.0)), F.coalesce("_more", F.lit(0)).cast("bigint")
    each = float(np.log10(corpus.total + corpus.distinct + 1.0))
    return joined.select(
        *[f"`{c}`" for c in own], F.col("_n").alias("n_tokens"), (F.col("_known") + more).alias("n_known"), F.lit(corpus.total).cast("bigint").alias("train_tokens"),
        (F.col("_log") + log_sum - F.col("_n") * F.lit(each)).alias("base_score"), (F.col("_value") + log_sum).alias("score"),
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", modulus: int = 7, remainder: int = 2, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row, learned from the rows not held out.

    Null texts count as empty and have one token, the end. Repeated rows count as often as they occur. Scores are log10 of
    the probability of the whole text; base_score is the add-one unigram model. An empty input gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), crc_split(F.col(id_col), modulus, remainder).alias("held_out"), F.col(text_col).alias("text"))
    ship(docs.sparkSession)
    counts = settle(count_tokens(rows.where(~F.col("held_out"))))
    corpus = corpus_of(counts)
    encoded = settle(encode(rows, corpus))
    model = train(encoded.where(~F.col("held_out")), F.col("doc_id"), corpus, shard, fan)
    return score_texts(encoded, counts, corpus, model)
