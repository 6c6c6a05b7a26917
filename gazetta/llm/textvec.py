"""Vectorised text primitives over batches of documents: words, word hashes and shingles as numpy arrays.

Texts are handled as UTF-8 bytes with A-Z folded, so that a batch of documents costs a few numpy passes and no loop over
words. Memory follows PIECE and BATCH_BYTES, not the length of a document or the number of rows in an Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BATCH_BYTES, PIECE = 4 << 20, 1 << 20
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def batches(texts: list, limit: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Cut a list of texts into runs of about ``limit`` characters; one long text makes a run of its own."""
    low = held = 0
    for i, text in enumerate(texts):
        size = len(text) if text is not None else 0
        if held and held + size > limit:
            yield low, i
            low, held = i, 0
        held += size
    if low < len(texts):
        yield low, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(int(_BASE), -1, 1 << 64)
    one = np.ones(n, _U)
    up, down = one.copy(), one.copy()
    up[1:], down[1:] = _BASE, _U(inverse)
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def range_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; ranges are in order and do not overlap. Works through the buffer in pieces."""
    out, i = np.empty(len(starts), _U), 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + PIECE)))
        s, e = int(starts[i]), int(ends[j - 1])
        up, down = _powers(1 << max(20, (e - s).bit_length()))
        sums = np.zeros(e - s + 1, _U)
        np.cumsum((buf[s:e].astype(_U) + _U(1)) * up[: e - s], out=sums[1:])
        a, b = starts[i:j] - s, ends[i:j] - s
        out[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(_U))
        i = j
    return out


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true cells."""
    step = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


class Words:
    """The words of a batch of texts. ``at[d]:at[d+1]`` are the words of text d; null counts as empty."""

    def __init__(self, texts: list):
        raw = [b"" if t is None else t.encode("utf-8", "replace") for t in texts]
        self.plain = np.frombuffer(b"\n".join(raw), np.uint8)
        self.buf = np.frombuffer(self.plain.tobytes().lower(), np.uint8)
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.sizes, self.doc_at = sizes, np.concatenate(([0], np.cumsum(sizes + 1)))
        self.starts, self.ends = runs(~_SPACE[self.buf])
        self.at = np.searchsorted(self.starts, self.doc_at)
        self.hashes = range_hashes(self.buf, self.starts, self.ends)

    def doc_of(self, at: np.ndarray | None = None) -> np.ndarray:
        at = self.at if at is None else at
        return np.repeat(np.arange(len(at) - 1), np.diff(at))


_STEPS = tuple(_U(x | 1) for x in (0xD1B54A32D192ED03, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D))


def shingles(hashes: np.ndarray, at: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of ``n`` words and their offsets. A text of 1 to n-1 words has one shingle, all its words."""
    counts = np.diff(at)
    made = np.where(counts >= n, counts - n + 1, (counts > 0).astype(counts.dtype))
    out_at = np.concatenate(([0], np.cumsum(made)))
    out = np.empty(out_at[-1], _U)
    if len(hashes) >= n:
        whole = np.zeros(len(hashes) - n + 1, _U)
        for k in range(n):
            whole += hashes[k : len(hashes) - n + 1 + k] * _STEPS[k]
        long = np.flatnonzero(counts >= n)
        index = np.repeat(at[long] - out_at[long], made[long])
        cells = np.flatnonzero(np.repeat(counts >= n, made))
        out[cells] = mix(whole[index + cells])
    for d in np.flatnonzero((counts > 0) & (counts < n)):
        part = hashes[at[d] : at[d + 1]]
        out[out_at[d]] = mix(np.array([sum(int(h) * int(s) for h, s in zip(part, _STEPS, strict=False)) + len(part) & (2**64 - 1)], _U))[0]
    return out, out_at


def minhash_params(count: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    draw = rng.integers(0, 2**63, (2, count), dtype=np.int64).astype(_U)
    return draw[0], draw[1] * _U(2) + _U(1)


def segment_minima(values: np.ndarray, starts: np.ndarray, params: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """One row a permutation: the least permuted value of each segment; ``starts`` are strictly increasing."""
    out = np.empty((len(params[0]), len(starts)), _U)
    for j, (flip, factor) in enumerate(zip(*params, strict=True)):
        x = (values ^ flip) * factor
        x ^= x >> _U(32)
        np.minimum.reduceat(x, starts, out=out[j])
    return out
