"""Spelling variants: words one edit apart by bands of letter parities, and the frequent form that each rare variant leads to."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

#: Letters of a word: A-Z, a-z and the code points from U+00C0 to U+00FF, one byte each in Latin-1.
LETTERS = r"A-Za-zÀ-ÿ"
#: Bands of a mask, bits of a band. One edit flips at most two bits, so one of three bands stays.
BANDS, BAND_BITS = 3, 21
#: Members of a bucket that are compared at once; larger buckets are cut into blocks. Words of a batch; pairs looked at together.
BLOCK, BATCH, PAIRS = 512, 1 << 16, 1 << 18
#: Words up to so many letters are compared as rows of one matrix, longer ones one pair at a time.
WIDE = 64
_U = np.uint64

_BIT = np.zeros(256, _U)
for _c in range(ord("a"), ord("z") + 1):
    _BIT[_c] = _U(1 << (_c % BANDS * BAND_BITS + (_c - ord("a")) // BANDS))
for _c in range(0xC0, 0x100):
    _BIT[_c] = _U(1 << (_c % BANDS * BAND_BITS + 9 + _c // BANDS % 12))


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, damage: int = 31) -> DataFrame:
    """(word): every run of letters with at least ``least`` of them, A-Z lower-cased, in texts whose writing is disturbed by rule: where
    ``damage`` divides h, the crc32 of ``<id>:<run>``, the run loses its code point h % length; 0 disturbs nothing."""
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))
    lower = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = runs.select("id", F.when(F.octet_length("run") == F.length("run"), F.lower("run")).otherwise(lower).alias("run"))
    if not damage:
        return runs.select(F.col("run").alias("word"))
    runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return runs.select(F.when(F.col("h") % damage == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least)


def masks(words: list[bytes]) -> np.ndarray:
    """Parity of the number of each letter, three bands of 21 bits; some rare letters share a bit, which only makes masks more alike."""
    flat = np.frombuffer(b"".join(words), np.uint8)
    starts = np.concatenate(([0], np.cumsum([len(w) for w in words])[:-1])).astype(np.int64)
    return np.bitwise_xor.reduceat(_BIT[flat], starts)


def _band(mask: np.ndarray, band: int) -> np.ndarray:
    return (mask >> _U(BAND_BITS * band)) & _U((1 << BAND_BITS) - 1)


def halves(word: bytes, short: int) -> tuple[bytes, bytes]:
    """Beginning and end of a word that is compared with words of ``short`` letters or one more: one edit leaves one of both whole."""
    return word[: short // 2], word[len(word) - (short - short // 2):]


def _keyed(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Twelve rows a word: each band, with the word as the shorter or the longer one, under its beginning or its end."""
    for batch in batch_iter:
        words = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
        if not words:
            continue
        mask, index, short, slot, side = masks(words), [], [], [], []
        for i, w in enumerate(words):
            for length in (len(w), len(w) - 1):
                for which, half in enumerate(halves(w, length)):
                    index.append(i)
                    short.append(length)
                    slot.append(which)
                    side.append(half)
        index, which = np.array(index), np.array(slot, np.int8)
        for band in range(BANDS):
            yield pa.RecordBatch.from_arrays(
                [batch.column("word").take(pa.array(index)), batch.column("n").take(pa.array(index)), pa.array(np.full(len(index), band, np.int8)), pa.array(which),
                 pa.array(np.array(short, np.int32)), pa.array(_band(mask, band)[index].astype(np.int32)), pa.array(side, pa.binary())],
                ["word", "n", "band", "side", "short", "value", "half"])


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[same + 1:] == b[same + 1:] if len(a) == len(b) else len(b) == len(a) + 1 and a[same:] == b[same + 1:])


def _edits(letters: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``one_edit`` of rows i and j of a matrix of letters, padded by zeros."""
    swap = sizes[i] > sizes[j]
    i, j = np.where(swap, j, i), np.where(swap, i, j)
    differ = letters[i] != letters[j]
    at = differ.argmax(1)
    equal = sizes[i] == sizes[j]
    moved = (letters[i][:, :-1] != letters[j][:, 1:]) & (np.arange(letters.shape[1] - 1)[None] >= at[:, None])
    return np.where(equal, differ.sum(1) == 1, ~moved.any(1))


class _Buckets:
    """Members of some whole buckets, sorted by bucket; pairs are compared in one sweep per distance between members."""

    def __init__(self, rows: list[tuple]):
        self.words = [r[0] for r in rows]
        self.n = np.array([r[1] for r in rows], np.int64)
        keys = [r[2:9] for r in rows]
        first = np.array([True, *(a != b for a, b in zip(keys, keys[1:], strict=False))])
        self.ends = np.append(np.flatnonzero(first), len(rows))[np.cumsum(first)]
        self.band, self.side, self.short = (np.array([r[c] for r in rows], np.int64) for c in (2, 3, 4))
        # In the bucket of two blocks, only pairs across them are compared.
        self.block, self.across = np.array([r[9] for r in rows], np.int64), np.array([r[7] != r[8] for r in rows])
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(rows))
        self.mask = masks(self.words)
        width = int(min(WIDE, self.sizes.max())) + 1
        self.letters = np.frombuffer(b"".join(w[: width - 1].ljust(width, b"\0") for w in self.words), np.uint8).reshape(-1, width)

    def _near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of members one edit apart that no earlier bucket of both has; i and j are in one bucket."""
        flips = self.mask[i] ^ self.mask[j]
        ok = (np.bitwise_count(flips) <= 2) & (np.minimum(self.sizes[i], self.sizes[j]) == self.short[i]) & (~self.across[i] | (self.block[i] != self.block[j]))
        for band in range(BANDS - 1):
            ok &= (self.band[i] <= band) | (_band(flips, band) != 0)
        i, j = i[ok], j[ok]
        wide = (self.sizes[i] > WIDE) | (self.sizes[j] > WIDE)
        good = np.empty(len(i), bool)
        good[~wide] = _edits(self.letters, self.sizes, i[~wide], j[~wide])
        good[wide] = [one_edit(self.words[a], self.words[b]) for a, b in zip(i[wide], j[wide], strict=True)]
        i, j = i[good], j[good]
        kept = (self.side[i] == 0) | ~self._begin_alike(i, j)  # under their ends only if the beginnings differ
        return i[kept], j[kept]

    def _begin_alike(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the beginnings by which the pairs' words could be in one bucket are equal."""
        half = self.short[i] // 2
        out = ~((self.letters[i] != self.letters[j]) & (np.arange(self.letters.shape[1])[None] < half[:, None])).any(1)
        for p in np.flatnonzero(half >= self.letters.shape[1]):
            out[p] = self.words[i[p]][: half[p]] == self.words[j[p]][: half[p]]
        return out

    def result(self) -> pa.RecordBatch:
        """A row for each member with near words: the word, how many, and the best of them."""
        pairs, at, held, step = [], np.arange(len(self.words)), [], 1
        while len(at := at[at + step < self.ends[at]]):
            held.append((at, at + step))
            if sum(len(x[0]) for x in held) >= PAIRS:
                pairs.append(self._near(*map(np.concatenate, zip(*held, strict=True))))
                held = []
            step += 1
        if held:
            pairs.append(self._near(*map(np.concatenate, zip(*held, strict=True))))
        i, j = (np.concatenate([p[c] for p in pairs] + [p[1 - c] for p in pairs]) if pairs else np.empty(0, np.int64) for c in (0, 1))
        rank = np.empty(len(self.words), np.int64)
        rank[sorted(range(len(self.words)), key=self.words.__getitem__)] = np.arange(len(self.words))
        order = np.lexsort((rank[j], -self.n[j], i))
        rows, first, counts = np.unique(i[order], return_index=True, return_counts=True)
        best = j[order[first]]
        word = lambda at: pa.array([self.words[r].decode("latin-1") for r in at], pa.string())
        return pa.RecordBatch.from_arrays([word(rows), pa.array(counts.astype(np.int64)), pa.array(self.n[best]), word(best)], ["word", "n_near", "best_n", "best"])


def _compared(batch_iter: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare the buckets of a partition that is sorted by them; whole buckets are gathered into batches."""
    held: list[tuple] = []
    for batch in batch_iter:
        for word, *rest in zip(*[batch.column(c).to_pylist() for c in ("word", "n", "band", "side", "short", "value", "half", "p", "q", "block")], strict=True):
            row = (word.encode("latin-1"), *rest)
            if len(held) >= BATCH and held[-1][2:9] != row[2:9]:
                yield _Buckets(held).result()
                held = []
            held.append(row)
    if held:
        yield _Buckets(held).result()


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best_n, best) for every word of (word, n) that has others one edit apart; best has the largest n, then
    comes first in code-point order.

    A word goes to the buckets of its three bands. A bucket also fixes the length of the shorter word and either its beginning or
    its end, since an edit leaves one of both whole; this splits the buckets of common parities. Buckets of one word are dropped,
    those over ``block`` words are cut into blocks that meet two at a time. Pairs never are rows: a bucket
    emits one row a word, and a pair counts in the first of the buckets that both words share.
    """
    keyed = settle(words.select("word", "n").mapInArrow(_keyed, "word string, n bigint, band tinyint, side tinyint, short int, value int, half binary"))
    key = ["band", "side", "short", "value", "half"]
    full = settle(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    blocks = F.ceil(F.col("members") / block).cast("int")
    dealt = keyed.join(full, key).withColumn("block", F.pmod(F.xxhash64("word"), blocks.cast("bigint")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other"))
    at = [*key, "p", "q"]
    found = dealt.select("word", "n", *at, "block").repartition(*at).sortWithinPartitions(*at).mapInArrow(_compared, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("first")).select("word", "n_near", (-F.col("first.less")).alias("best_n"), "first.best")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form): where the chain of forms ends. Each round doubles the steps taken; a form has
    ten times the occurrences of its word, so chains are short."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = settle(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 7, at_least: int = 2, damage: int = 31, ratio: int = 10, block: int = BLOCK) -> DataFrame:
    """One row a word: word, form, root, n, n_near, form_n.

    Words are the results of ``occurrences`` with at least ``at_least`` of them (n). n_near counts the words one edit away. The
    form is the near word of largest n (ties: first in code-point order) if that is at least ``ratio`` times the word's own, else
    null, as is form_n; the root follows forms to the last, and is the word itself without any. Null texts hold no words, a null
    id reads as no text in the rule of disturbance, repeated rows count again, other columns are ignored. No words give no rows.
    """
    ship(docs.sparkSession)
    words = settle(occurrences(docs, id_col, text_col, least, damage).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least))
    near = near_words(words, block)
    joined = settle(words.join(near, "word", "left"))
    far = F.col("best_n") >= F.col("n") * ratio
    formed = joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(far, F.col("best")).alias("form"), F.when(far, F.col("best_n")).alias("form_n"))
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

