"""Spelling variants, the filter audit and exact top-k search against plain loops on small and odd tables."""

import collections
import itertools
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from gazetta.llm import filter_audit, spelling, vector_search

DOCS = "doc_id bigint, text string, lang string, N int, word string, mask string"


def edits(a, b):
    """Levenshtein distance, by the usual table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def variants(rows, least=7, damage=31):
    """The contract of op11 in plain loops over all pairs."""
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % damage == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least and c >= 2}
    near = {w: [v for v in n if abs(len(v) - len(w)) <= 1 and v != w and edits(v, w) == 1] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def test_spelling_against_brute_force(spark):
    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcdeéàÿ×"), rng.integers(7, 11))) for _ in range(60)] + ["q" * 70, "ab" * 600]
    pool = []
    for k, w in enumerate(base):
        at = int(rng.integers(0, len(w)))
        others = [w[:at] + w[at + 1 :], w[:at] + "e" + w[at:], w[:at] + "b" + w[at + 1 :], w[:at] + "bc" + w[at + 1 :]]
        pool += [w] * (400 if k % 3 == 0 else 30) + others * 3 + others[:1] * 30 + [w[:-1] + "x"] * 2
    pool = [w.capitalize() if k % 5 == 0 else w for k, w in enumerate(rng.permutation(np.array(pool, object)).tolist())]
    rows = [(i, " ".join(pool[k : k + 40]), "en", 1, "mine", None) for i, k in enumerate(range(0, len(pool), 40))]
    rows += [(None, "Somewords somewords, SOMEWORDS ÀÉÎÕÜàé1ÀÉÎÕÜàé", None, None, None, None), rows[0], rows[0], (9, None, "", 0, None, ""), (9, "", None, None, None, None), (777, "short ones 123", "en", None, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    expected = variants([r[:2] for r in rows])
    assert sum(v[0] is not None for v in expected.values()) > 20 and any(v[0] != v[1] and v[0] for v in expected.values()) and max(map(len, expected)) > 1000
    for block in (512, 3):
        got = spelling.spelling_variants(docs, block=block).collect()
        assert len(got) == len(expected) and {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == expected
    assert spelling.spelling_variants(docs.where("false")).count() == 0 and spelling.spelling_variants(docs.where("doc_id = 777")).count() == 0


def test_one_edit_and_masks_agree_with_the_distance():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcé"), rng.integers(5, 9))) for _ in range(250)]
    raw = [w.encode("latin-1") for w in words]
    mask = spelling.masks(raw)
    near = 0
    for (i, a), (j, b) in itertools.combinations(enumerate(words), 2):
        one = edits(a, b) == 1
        assert spelling.one_edit(raw[i], raw[j]) == one
        near += one
        flips = mask[i] ^ mask[j]
        short = min(len(a), len(b))
        halves = zip(spelling.halves(raw[i], short), spelling.halves(raw[j], short), strict=True)
        assert not one or (np.bitwise_count(flips) <= 2 and any(spelling._band(flips, k) == 0 for k in range(3)) and any(x == y for x, y in halves))
    assert near > 50


def test_a_crowded_bucket_is_compared_in_blocks(spark):
    # All words share their beginning, and many their parities: one bucket holds most of them.
    words = [f"commonbeginning{a}{b}{c}{d}" for a, b, c, d in itertools.product("aceg", repeat=4)]
    frame = spark.createDataFrame([(w, k + 1) for k, w in enumerate(words)], "word string, n bigint")
    for block in (16, 512):
        got = {r.word: (r.n_near, r.best) for r in spelling.near_words(frame, block).collect()}
        assert len(got) == 256 and {v[0] for v in got.values()} == {12}
        assert got["commonbeginningaaaa"][1] == "commonbeginninggaaa"


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)]
    assert {(r.word, r.root) for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()} == {(w, "w37") for w, _ in chain}
    assert spelling.roots(spark.createDataFrame([], "word string, form string")).count() == 0


def audit(rows, labels, fails):
    """Every order of filters applied one after the other to lists of rows."""
    out, letters = {}, "ABCDE"
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(least.get(r[1] or "", r[0]), r[0])
    sets = []
    for r in rows:
        own = {k for k in "ABCD" if fails[k](r[1] or "")}
        sets.append((r[2] or "", own | ({"E"} if r[0] is not None and r[0] > least[r[1] or ""] else set()), [any(r[0] is not None and i == r[0] and x == 1 for i, *x2 in labels for x in [x2[c]]) for c in (0, 1)]))
    for part in {s[0] for s in sets}:
        mine, total = [s for s in sets if s[0] == part], collections.Counter()
        for order in itertools.permutations(letters):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [s for s in left if f in s[1]]
                total[f] += len(gone)
                before = set(order[: step - 1])
                out[part, "".join(order), step] = [
                    len(left) - len(gone), len(gone), sum(f in s[1] and bool(before & s[1]) for s in mine), sum(s[1] == {f} for s in mine), sum(s[2][0] for s in gone), sum(s[2][1] for s in gone)]
                left = [s for s in left if f not in s[1]]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_filter_audit_against_all_orders(spark):
    rng, space = np.random.default_rng(3), " \t\n\x0b\r"
    rows = []
    for i in range(150):
        words = ["".join(rng.choice(list("abAB#é" if i % 3 else "abé"), 3)) for _ in range(int(rng.integers(0, 220)))]
        rows.append((i // 2, space[i % 5].join(words), [None, "en", "fr"][i % 3], 1, None, "mine"))
    rows += [(200 + i, "Same Text #", "en", None, None, None) for i in range(60)] + [(200, "Same Text #", "de", 1, "", "")] * 2
    rows += [(None, "Same Text #", "en", 1, "", ""), (None, None, None, None, None, None), (300, None, None, None, None, None), (301, "", "", None, None, None), (302, "x" * 200_000 + " Y Z", "en", 1, "", "")]
    labels = [(int(i), int(q), int(t)) for i, q, t in zip(rng.integers(0, 310, 200), rng.integers(0, 2, 200), rng.integers(0, 2, 200), strict=True)] + [(None, 1, 1), (5, None, 1), (200, 1, None), (200, 0, 1)]
    split = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t)
    fails = {"A": lambda t: len(split(t)) < 100, "B": lambda t: 100 * len(set(split(t))) < 80 * len(split(t)), "C": lambda t: 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": lambda t: bool(re.search("[#$%&*|]", t))}
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("mine"))
    expected = audit(rows, labels, fails)
    got = filter_audit.filter_audit(docs, marks).collect()
    assert len(got) == len(expected) == 600 * 4
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in got} == expected
    assert filter_audit.filter_audit(docs.where("false"), marks).count() == 0 and filter_audit.filter_audit(docs, marks.where("false")).agg(F.sum("good_lost")).first()[0] == 0


def test_transform_of_masks_is_inverted_exactly(spark):
    rng = np.random.default_rng(0)
    masks = rng.integers(0, 8, 5000)
    frame = spark.createDataFrame([("p", int(m)) for m in masks], "part string, mask int")
    row = filter_audit.signed_sums(frame, ["part"], 3).select("sums", filter_audit.cells(F.col("sums"), 3).alias("cell")).first()
    assert row.cell == np.bincount(masks, minlength=8).tolist()
    assert row.sums == [sum((-1) ** bin(m & s).count("1") for m in masks.tolist()) for s in range(8)]


def best(rows, k, scale=64):
    fine = [(i, n, [int(np.floor(float(np.float32(x)) * scale)) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, n, v in fine:
        if i is not None and i % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), j is None, j or 0, j) for j, m, w in fine if m != n and len(w) == len(v))
            out += [(i, rank, s[3], -s[0]) for rank, s in enumerate(scored[:k], 1)]
    return sorted(out, key=repr)


def test_exact_topk_against_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(400, 12)) * rng.uniform(0.02, 2, 12)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[7].tolist()) for i in range(120)]  # one vector of many rows, queries among them
    rows += [(40, vectors[3].tolist()), (40, vectors[3].tolist()), (60, vectors[60].tolist()), (None, vectors[5].tolist()), (None, vectors[5].tolist())]
    rows += [(2000, None), (2020, [1.0, None, 3.0]), (2040, [float("nan")] * 12), (2060, [float("inf")] * 12), (2080, []), (2081, []), (2100, [0.5, -0.25]), (2101, [0.25, 4.0]), (2120, [9.0])]
    frame = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], "vec_id bigint, embedding array<float>, node int, block string, score int").repartition(7)
    expected = best(rows, 20)
    for bits, block in ((5, 1024), (2, 4)):
        got = vector_search.exact_topk(frame, bits=bits, block=block).collect()
        assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in got), key=repr) == expected
    assert sorted(((r.query_id, r["rank"], r.vec_id, r.score) for r in vector_search.exact_topk(frame, k=3, scale=1000).collect()), key=repr) == best(rows, 3, 1000)
    assert vector_search.exact_topk(frame.where("false")).count() == 0 and vector_search.exact_topk(frame.where("vec_id % 20 = 1")).count() == 0


def test_approximations_bound_scores_and_leave_few_candidates(spark):
    rng = np.random.default_rng(5)
    whole = rng.integers(-30, 30, (3000, 16))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(whole)], "node bigint, vec array<int>")
    borders = vector_search.fit_cells(frame, 4)
    low, high = vector_search._bounds(borders, vector_search.encode(whole, borders))
    assert (low <= whole).all() and (whole <= high).all() and borders.shape == (16, 17)
    packed = vector_search._packed(vector_search.encode(whole, borders), 4)
    assert len(packed[0]) == 8 and (vector_search._unpacked(packed, 16, 4) == vector_search.encode(whole, borders)).all()
    found = vector_search.candidates(frame, frame.where("node < 50"), 10, bits=4).collect()
    scores = whole @ whole.T
    kth = -np.sort(-scores[:50], axis=1)[:, 9]
    assert all(r.least <= scores[r["query"], r.node] <= r.most for r in found)
    pairs = {(r["query"], r.node) for r in found}
    assert all((q, v) in pairs for q in range(50) for v in np.flatnonzero(scores[q] >= kth[q])) and len(pairs) < 0.1 * 50 * 3000
