"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .common import crc_split, fresh, settle
from .quality import labelled_sample
from .textvec import Words, batches, minhash_params, mix, range_hashes, runs, segment_minima, shingles

#: Labelled documents that the network is fitted on at most, and characters that they have together at most: a document is in
#: the sample whole or not at all, and scoring covers every window of every document.
SAMPLE, SAMPLE_CHARS = 4_000, 32_000_000
#: Words of a window and the step between windows; windows overlap by a quarter.
WINDOW, STEP = 32, 24
HIDDEN, WORD_SIZE, CHAR_SIZE = 8, 6, 10
WORD_ROWS, CHAR_ROWS, EVIDENCE_ROWS = 1 << 13, 1 << 12, 1 << 18
#: Lengths of the word beginnings and of the runs inside words that are character inputs, in bytes.
PREFIXES, GRAM = (4, 5, 6, 7, 8), 4
EPOCHS, BATCH, LEARN, TABLE_LEARN = 8, 128, 0.02, 0.002

_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = _LETTER[128:] = True
#: Digits and signs that stand for letters (fixed values).
_LOOKALIKE = np.arange(256, dtype=np.uint8)
_LOOKALIKE[[ord(c) for c in "013457@$"]] = [ord(c) for c in "oieastas"]


class Tokens:
    """Distinct words of a batch of texts (runs of letters, case of A-Z and look-alike digits folded), their character
    inputs, and the sequence of words of each text."""

    def __init__(self, texts: list):
        raw = [b"" if t is None else t.lower().encode("utf-8", "replace") for t in texts]
        buf = np.frombuffer(b"\n".join(raw), np.uint8)
        folded = _LOOKALIKE[buf]
        letter = _LETTER[folded]
        starts, ends = runs(letter)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.at = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes + 1))))
        hashes = range_hashes(folded, starts, ends)
        self.hashes, first, self.index = np.unique(hashes, return_index=True, return_inverse=True)
        s, length = starts[first], (ends - starts)[first]
        self.word = (self.hashes % np.uint64(EVIDENCE_ROWS)).astype(np.int64)
        # Character inputs of distinct words: beginnings of several lengths, then every run of GRAM bytes.
        padded = np.concatenate((folded, np.zeros(8, np.uint8)))
        cells, owners = [], []
        for k in PREFIXES:
            long = np.flatnonzero(length >= k)
            code = np.full(len(long), k, np.uint64)
            for i in range(k):
                code = code * np.uint64(0x100000001B3) + padded[s[long] + i].astype(np.uint64)
            cells.append(mix(code)), owners.append(long)
        grams = np.maximum(length - GRAM + 1, 0)
        owner = np.repeat(np.arange(len(s)), grams)
        spot = s[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams)
        code = np.full(len(spot), 99, np.uint64)
        for i in range(GRAM):
            code = code * np.uint64(0x100000001B3) + padded[spot + i].astype(np.uint64)
        cells.append(mix(code)), owners.append(owner)
        cells, owners = np.concatenate(cells), np.concatenate(owners)
        order = np.argsort(owners, kind="stable")
        self.cells = (cells[order] % np.uint64(EVIDENCE_ROWS)).astype(np.int64)
        self.cell_at = np.concatenate(([0], np.cumsum(np.bincount(owners, minlength=len(s)))))

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows x WINDOW distinct-word numbers, -1 for padding; text of each window). Every text has one window at least."""
        counts = np.diff(self.at)
        per = 1 + np.maximum(0, -(-(counts - WINDOW) // STEP))
        owner = np.repeat(np.arange(len(counts)), per)
        begin = STEP * (np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per))
        cells = begin[:, None] + np.arange(WINDOW)
        grid = np.where(cells < counts[owner][:, None], self.at[:-1][owner][:, None] + cells, -1)
        return np.where(grid >= 0, np.append(self.index, -1)[grid], -1), owner


def _sum_rows(table: np.ndarray, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean of the table's rows over each segment of cells; zeros for empty segments."""
    out = np.zeros((len(at) - 1, table.shape[1]), np.float32)
    for low in range(0, len(out), 20_000):
        part = at[low : low + 20_001]
        full = np.flatnonzero(np.diff(part))
        if len(full):
            out[low + full] = np.add.reduceat(table[cells[part[0] : part[-1]]], part[full] - part[0], axis=0) / np.diff(part)[full][:, None]
    return out


def _peaks(table: np.ndarray, cells: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Greatest value of the table over each segment of cells; zero for empty segments."""
    out = np.zeros(len(at) - 1, np.float32)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.maximum.reduceat(table[cells], at[full])
    return out


_sigmoid = lambda x: 1 / (1 + np.exp(-x))


class Network:
    """Word input: a trained row a word bucket and the word's weight of evidence. Character input: the mean of trained rows
    of its character cells and the greatest evidence among them. Evidence is counted on the training documents."""

    INPUT = WORD_SIZE + CHAR_SIZE + 2

    def __init__(self, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.evidence = {"word": np.zeros(EVIDENCE_ROWS, np.float32), "char": np.zeros(EVIDENCE_ROWS, np.float32)}
        self.p = {"word": 0.05 * draw(WORD_ROWS, WORD_SIZE) * np.sqrt(WORD_ROWS).astype(np.float32), "char": 0.05 * draw(CHAR_ROWS, CHAR_SIZE) * np.sqrt(CHAR_ROWS).astype(np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": draw(self.INPUT, 3 * HIDDEN), f"h{side}": draw(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"a": draw(2 * HIDDEN), "out": draw(2 * HIDDEN), "bias": np.full(1, -1.0, np.float32)}

    def inputs(self, t: Tokens) -> np.ndarray:
        """Input vectors of the distinct words, and a last row of zeros for padding."""
        x = np.concatenate((
            self.p["word"][t.word % WORD_ROWS], self.evidence["word"][t.word][:, None],
            _sum_rows(self.p["char"], t.cells % CHAR_ROWS, t.cell_at), _peaks(self.evidence["char"], t.cells, t.cell_at)[:, None],
        ), 1)
        return np.concatenate((x, np.zeros((1, x.shape[1]), np.float32)))

    def _run(self, gates: np.ndarray, grid: np.ndarray, side: str, keep: bool) -> tuple[np.ndarray, list]:
        order = range(grid.shape[1]) if side == "f" else range(grid.shape[1] - 1, -1, -1)
        h, states, cache = np.zeros((len(grid), HIDDEN), np.float32), np.empty((grid.shape[1], len(grid), HIDDEN), np.float32), []
        w = self.p[f"h{side}"]
        for k in order:
            i = gates[grid[:, k]]
            r = h @ w
            zr = _sigmoid(i[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
            z, s = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(i[:, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
            live = (grid[:, k] >= 0)[:, None]
            new = np.where(live, n + z * (h - n), h)
            if keep:
                cache.append((k, h, z, s, n, r[:, 2 * HIDDEN :], live))
            h = states[k] = new
        return states, cache

    def forward(self, x: np.ndarray, grid: np.ndarray, keep: bool = False):
        """Logit of each window: both directions, then attention over the words."""
        both, caches = [], []
        for side in "fb":
            states, cache = self._run(x @ self.p[f"x{side}"] + self.p[f"c{side}"], grid, side, keep)
            both.append(states), caches.append(cache)
        states = np.concatenate(both, 2)
        energy = np.where((grid >= 0).T, states @ self.p["a"], -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logit = pooled @ self.p["out"] + self.p["bias"][0]
        return (logit, states, weight, pooled, caches) if keep else logit

    def logits(self, x: np.ndarray, grid: np.ndarray) -> np.ndarray:
        """As ``forward``, for many windows: a thousand at a time."""
        gates = {side: x @ self.p[f"x{side}"] + self.p[f"c{side}"] for side in "fb"}
        out = np.empty(len(grid), np.float32)
        for low in range(0, len(grid), 1024):
            part = grid[low : low + 1024]
            states = np.concatenate([self._run(gates[side], part, side, False)[0] for side in "fb"], 2)
            energy = np.where((part >= 0).T, states @ self.p["a"], -1e9)
            weight = np.exp(energy - energy.max(0))
            weight /= weight.sum(0)
            out[low : low + 1024] = np.einsum("tn,tnh->nh", weight, states) @ self.p["out"] + self.p["bias"][0]
        return out

    def score(self, texts: list) -> np.ndarray:
        """Greatest probability among all windows of each text."""
        t = Tokens(texts)
        grid, owner = t.windows()
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, owner, self.logits(self.inputs(t), grid))
        return _sigmoid(np.clip(best, -30, 30))

    def gradients(self, t: Tokens, x: np.ndarray, grid: np.ndarray, y: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
        logit, states, weight, pooled, caches = self.forward(x, grid, keep=True)
        g = {k: np.zeros_like(v) for k, v in self.p.items() if k not in ("word", "char")}
        d = ((_sigmoid(logit) - y) * weights / len(y)).astype(np.float32)
        g["out"], g["bias"] = pooled.T @ d, np.array([d.sum()], np.float32)
        dpool = d[:, None] * self.p["out"]
        dstates = weight[:, :, None] * dpool
        dw = np.einsum("nh,tnh->tn", dpool, states)
        de = weight * (dw - (weight * dw).sum(0))
        g["a"] = np.einsum("tn,tnh->h", de, states)
        dstates += de[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for side, cache, part in zip("fb", caches, (dstates[:, :, :HIDDEN], dstates[:, :, HIDDEN:]), strict=True):
            w, dh = self.p[f"h{side}"], np.zeros((len(grid), HIDDEN), np.float32)
            dgates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            for k, h, z, s, n, rn, live in reversed(cache):
                dh = dh + part[k]
                dnew = np.where(live, dh, 0)
                dz = dnew * (h - n) * z * (1 - z)
                dn = dnew * (1 - z) * (1 - n * n)
                ds = dn * rn * s * (1 - s)
                dr = np.concatenate((dz, ds, dn * s), 1)
                g[f"h{side}"] += h.T @ dr
                np.add.at(dgates, grid[:, k], np.concatenate((dz, ds, dn), 1))
                dh = np.where(live, 0, dh) + dnew * z + dr @ w.T
            dgates[-1] = 0
            g[f"x{side}"] = x.T @ dgates
            g[f"c{side}"] = dgates.sum(0)
            dx += dgates @ self.p[f"x{side}"].T
        used = np.unique(grid[grid >= 0])
        g["word"] = (t.word[used] % WORD_ROWS, dx[used, :WORD_SIZE])
        per = np.diff(t.cell_at)[used]
        cells = np.repeat(t.cell_at[used], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        share = dx[used, WORD_SIZE + 1 : WORD_SIZE + 1 + CHAR_SIZE] / np.maximum(per, 1)[:, None]
        g["char"] = (t.cells[cells] % CHAR_ROWS, np.repeat(share, per, axis=0))
        return g


def _evidence(texts: list, y: np.ndarray) -> dict[str, np.ndarray]:
    """Smoothed log ratio of the shares of toxic and clean texts that have a word bucket or a character cell."""
    seen = {name: np.zeros((2, EVIDENCE_ROWS)) for name in ("word", "char")}
    for low, high in batches(texts, 1 << 19):
        t, toxic = Tokens(texts[low:high]), y[low:high] > 0
        text = np.repeat(np.arange(high - low), np.diff(t.at))
        text, distinct = np.divmod(np.unique(text * len(t.hashes) + t.index), max(1, len(t.hashes)))
        per = np.diff(t.cell_at)[distinct]
        cells = np.repeat(t.cell_at[distinct], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        for name, code, owner in (("word", t.word[distinct], text), ("char", t.cells[cells], np.repeat(text, per))):
            owner, code = np.divmod(np.unique(owner * EVIDENCE_ROWS + code), EVIDENCE_ROWS)
            for k in (0, 1):
                seen[name][k] += np.bincount(code[toxic[owner] == bool(k)], minlength=EVIDENCE_ROWS)
    out = {}
    for name, (clean, bad) in seen.items():
        ratio = np.log((bad + 0.5) / ((y > 0).sum() + 1)) - np.log((clean + 0.5) / ((y <= 0).sum() + 1))
        out[name] = np.clip(ratio * np.minimum(1, (bad + clean) / 8), -1, 4).astype(np.float32) / 2
    return out


def _unlike(texts: list, y: np.ndarray, threshold: float = 0.8) -> np.ndarray:
    """Numbers of the texts that are no near copies (five-word shingles, Jaccard similarity of ``threshold``) of an earlier one of
    their class; copies would make every word of their text look like evidence. Four MinHash values find the earlier texts
    to compare with."""
    words = Words(texts)
    hashes, at = shingles(words.hashes, words.at)
    full = np.flatnonzero(np.diff(at))
    mins = segment_minima(hashes, at[full], minhash_params(4)) if len(full) else np.empty((4, 0), np.uint64)
    seen: dict[tuple, list[int]] = {}
    sets: dict[int, np.ndarray] = {}
    for c, d in enumerate(full):
        own, keys = np.unique(hashes[at[d] : at[d + 1]]), [(bool(y[d] > 0), k, int(v)) for k, v in enumerate(mins[:, c])]
        for e in {e for key in keys for e in seen.get(key, ())}:
            both = len(np.intersect1d(own, sets[e], assume_unique=True))
            if both >= threshold * (len(own) + len(sets[e]) - both):
                break
        else:
            sets[int(d)] = own
            for key in keys:
                seen.setdefault(key, []).append(int(d))
    return np.array(list(sets), np.int64)


def fit(texts: list, y: np.ndarray, seed: int = 3) -> Network:
    """Train on windows: of a toxic document the window that looks worst at the time, of a clean one its worst and others."""
    net, rng = Network(seed), np.random.default_rng(seed)
    if len(texts):
        kept = _unlike(texts, y)
        texts, y = [texts[i] for i in kept], y[kept]
    if not len(texts) or not (y > 0).any():
        net.p["out"][:], net.p["bias"][:] = 0, -4
        return net
    t = Tokens(texts)
    grid, owner = t.windows()
    # Evidence of a document is counted without its own half, so that training sees it as a new document would.
    half = rng.integers(0, 2, len(y))
    halves = [_evidence([texts[i] for i in np.flatnonzero(half != k)], y[half != k]) for k in (0, 1)]
    full = _evidence(texts, y)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, toxic = 0, np.flatnonzero(y > 0)
    weight_of = np.where(y > 0, len(y) / (2 * len(toxic)), len(y) / (2 * max(1, len(y) - len(toxic)))).astype(np.float32)
    at = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(y)))))
    for epoch in range(EPOCHS):
        worst, rate = np.empty(len(grid), np.float32), LEARN * (1 - 0.9 * epoch / EPOCHS)
        for k in (0, 1):
            net.evidence = halves[k]
            x, mine = net.inputs(t), np.flatnonzero(half[owner] == k)
            if epoch:
                worst[mine] = net.logits(x, grid[mine])
            else:  # before anything is trained: the strongest evidence in the window
                strongest = np.append(np.maximum(x[:-1, WORD_SIZE], x[:-1, -1]), np.float32(-9))
                worst[mine] = strongest[grid[mine]].max(1)
        top = np.array([at[d] + worst[at[d] : at[d + 1]].argmax() for d in range(len(y))])
        other = at[:-1] + (rng.random(len(y)) * np.diff(at)).astype(np.int64)
        rows = np.concatenate((top, other[y <= 0]))
        for k in (0, 1):
            net.evidence = halves[k]
            mine = rng.permutation(rows[half[owner[rows]] == k])
            for low in range(0, len(mine), BATCH):
                part = mine[low : low + BATCH]
                sub, small = np.unique(grid[part], return_inverse=True)
                view = _Subset(t, sub[sub >= 0])
                cells = small.reshape(len(part), -1) - int(sub[0] < 0)
                g = net.gradients(view, net.inputs(view), cells, (y[owner[part]] > 0).astype(np.float32), weight_of[owner[part]])
                step += 1
                fix = np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
                for name, value in g.items():
                    m, v = moments[name]
                    if isinstance(value, tuple):
                        at_rows, inverse = np.unique(value[0], return_inverse=True)
                        total = np.zeros((len(at_rows), value[1].shape[1]), np.float32)
                        np.add.at(total, inverse, value[1])
                        m[at_rows] = 0.9 * m[at_rows] + 0.1 * total
                        v[at_rows] = 0.99 * v[at_rows] + 0.01 * total**2
                        net.p[name][at_rows] -= rate / LEARN * TABLE_LEARN * fix * m[at_rows] / (np.sqrt(v[at_rows]) + 1e-7)
                    else:
                        m[...] = 0.9 * m + 0.1 * value
                        v[...] = 0.99 * v + 0.01 * value**2
                        net.p[name] -= rate * fix * m / (np.sqrt(v) + 1e-7)
    net.evidence = full
    return net


class _Subset:
    """The distinct words of a training batch, with their character cells."""

    def __init__(self, t: Tokens, keep: np.ndarray):
        per = np.diff(t.cell_at)[keep]
        cells = np.repeat(t.cell_at[keep], per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        self.word, self.cells, self.cell_at = t.word[keep], t.cells[cells], np.concatenate(([0], np.cumsum(per)))


def train(docs: DataFrame, labels: DataFrame, held: Column, label: str = "toxic", rows: int = SAMPLE, chars: int = SAMPLE_CHARS) -> Network:
    """Fit on at most ``rows`` labelled documents, half of them toxic if there are so many. Those come to the driver as whole texts,
    in order of a hash of their ids as long as ``chars`` lasts; so the sample is bounded, and no text is cut. An id labelled both
    ways counts as toxic and as clean."""
    parts = [labelled_sample(docs, labels.where(F.col(label) == k), label, ~held, rows // 2) for k in (1, 0)]
    sample = settle(parts[0].unionByName(parts[1]))
    drawn = Window.orderBy(F.xxhash64("doc_id"), "doc_id", "y").rowsBetween(Window.unboundedPreceding, 0)
    within = sample.select("doc_id", "y", F.sum(F.coalesce(F.length("text"), F.lit(0))).over(drawn).alias("used")).where(F.col("used") <= chars)  # of at most ``rows`` rows
    found = sample.join(F.broadcast(within.select("doc_id", "y")), ["doc_id", "y"]).toPandas().sort_values(["doc_id", "y"])
    return fit(found["text"].tolist(), found["y"].to_numpy())


def _scorer(shared):
    def score(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = shared.value
        for series in column:
            texts = series.tolist()
            yield pd.Series(np.concatenate([net.score(texts[a:b]) for a, b in batches(texts, 1 << 20)]) if texts else np.empty(0), index=series.index, dtype=float)

    return score


def score_toxicity(docs: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Add ``score`` (greatest probability among the overlapping windows of the whole text) and ``predicted``; clashing
    columns are replaced, rows don't move. Null and empty texts get the score of a window without words."""
    shared = ship(docs.sparkSession).sparkContext.broadcast(net)
    scored = fresh(docs, "score", "predicted").withColumn("score", F.pandas_udf(_scorer(shared), "double")(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """Score all documents with a network fitted on the labelled documents that are not held out."""
    held = crc_split(F.col("doc_id"), modulus, remainder)
    return score_toxicity(docs, train(docs, labels, held)).withColumn("held_out", held)
