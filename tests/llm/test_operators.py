"""Small cases of every operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazetta.llm import chat, components, decontaminate, exact_dedup, language_model, line_dedup, mixing, ngram_join, quality, sharding, textvec, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j) for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 30, n), strict=True))


BASE = prose(1, 120)
NEAR = BASE.replace(BASE.split()[60], "changed", 1)
ROWS = [
    (1, BASE, "en", "a", 1), (2, BASE, "en", "b", 1), (2, BASE, "en", "b", 1), (3, NEAR, "en", None, 1), (4, None, None, None, None), (5, "", "en", "a", 0), (6, "two words", "en", "a", 9),
    (7, "Two  Words", "en", "c", 9), (8, prose(2, 30_000), "en", "a", 1), (None, prose(3, 40), "en", "c", 1), (None, prose(4, 40), "en", "c", 1), (9, " \n\t ", "en", "a", 4), (10, "é É ÀB", "fr", "d", 6),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingle_set(t):
    w = re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_words_and_shingles_agree_with_a_plain_loop():
    texts = [r[1] for r in ROWS]
    words = textvec.Words(texts)
    plain = [re.findall(rb"[^\x20\x09-\x0d]+", (t or "").encode().lower()) for t in texts]
    assert np.diff(words.at).tolist() == [len(w) for w in plain]
    names = dict(zip(words.hashes.tolist(), [w for ws in plain for w in ws], strict=True))
    assert len(names) == len({w for ws in plain for w in ws})
    hashes, at = textvec.shingles(words.hashes, words.at)
    assert [len(set(hashes[at[i] : at[i + 1]].tolist())) for i in range(len(texts))] == [len(shingle_set(t)) for t in texts]


def test_exact_dedup(docs, empty):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups = collections.defaultdict(list)
    for r in ROWS:
        groups[fold(r[1])].append(r[0])
    for keep, pick in (("largest", max), ("smallest", min)):
        got = exact_dedup.exact_duplicates(docs, keep=keep).collect()
        assert len(got) == len(ROWS)
        for r in got:
            ids = next(v for k, v in groups.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
            assert r.group_size == len(ids) and r.keep_id == pick((i for i in ids if i is not None), default=None)
        assert sum(r.kept for r in got) == len(groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_exact_dedup_of_a_hot_text(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "Same text").otherwise(F.concat(F.lit("t"), F.expr("id div 4").cast("string"))).alias("text"))
    got = exact_dedup.exact_duplicates(rows, keep="largest").where("group_size > 1000").collect()
    assert len(got) == 2000 and {r.keep_id for r in got} == {3998} and {r.group_size for r in got} == {2000} and sum(r.kept for r in got) == 1


def test_exact_dedup_of_hot_beginnings_and_texts(spark):
    # Half of the rows are one text, without ids; a quarter are different texts with one long beginning.
    start = "The same beginning of many documents, longer than what places a row. " * 2
    text = F.when(F.col("id") % 2 == 0, "Same text").when(F.col("id") % 4 == 1, F.concat(F.lit(start), F.expr("id div 8").cast("string"))).otherwise(F.concat(F.lit("t"), F.col("id").cast("string")))
    rows = spark.range(100_000).select(F.when(F.col("id") % 2 == 1, F.col("id")).alias("doc_id"), text.alias("text")).repartition(16)
    got = exact_dedup.exact_duplicates(rows).persist()
    hot = got.where("doc_id is null")
    assert hot.count() == 50_000 and hot.where("group_size = 50000 and keep_id is null").count() == 50_000 and hot.where("kept").count() == 1
    pairs = got.where("doc_id % 4 = 1")
    assert pairs.count() == 25_000 and pairs.where("group_size = 2").count() == 25_000 and pairs.where("kept").count() == 12_500 and pairs.where("keep_id = doc_id - doc_id % 8 + 1").count() == 25_000
    assert got.where("doc_id % 4 = 3 and kept and group_size = 1").count() == 25_000
    got.unpersist()


def test_near_duplicates_against_brute_force(spark, docs, empty):
    got = sorted(((r.doc_id is None, r.doc_id, r.class_id, r.n_links, r.n_text_links) for r in ngram_join.near_duplicates(docs).collect()), key=repr)
    sets = [shingle_set(r[1]) for r in ROWS]
    link = lambda i, j: bool(sets[i]) and bool(sets[j]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    expected = []
    for i, r in enumerate(ROWS):
        group, new = {i}, {i}
        while new:
            new = {j for j in range(len(ROWS)) for k in group if j not in group and link(j, k)}
            group |= new
        partners = [j for j in range(len(ROWS)) if j != i and link(i, j)]
        ids = [ROWS[j][0] for j in group if ROWS[j][0] is not None]
        expected.append((r[0] is None, r[0], min(ids, default=None), len(partners), len({frozenset(sets[j]) for j in partners} - {frozenset(sets[i])})))
    assert got == sorted(expected, key=repr)
    assert ngram_join.near_duplicates(empty).count() == 0
    kept = ngram_join.one_per_class(docs).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 4, 5, 6, 8, 9, 10]


def test_one_row_of_every_class_stays_without_ids_or_with_repeated_ids(spark):
    a, b, c, d = (prose(s, 60) for s in (21, 22, 23, 24))
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (None, b, "en", "s", 1), (5, c, "en", "s", 1), (5, d, "en", "s", 1), (3, c, "en", "s", 1), (7, a, "en", "s", 1)]
    rows += [(None, None, "en", "s", 0), (None, " ", "en", "s", 0), (8, "", "en", "s", 0), (8, "\n", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = ngram_join.one_per_class(docs.withColumn("_ROW", F.lit(1)).withColumn("_row2", F.lit(2)).withColumn("node", F.lit(3)))
    assert kept.columns == [*docs.columns, "_ROW", "_row2", "node"] and kept.where("_row = 1 and _row2 = 2 and node = 3").count() == 8
    kept = ngram_join.one_per_class(docs)
    assert kept.columns == docs.columns
    expected = [(7, a), (None, b), (3, c), (5, d), (None, None), (None, " "), (8, ""), (8, "\n")]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(expected, key=repr)
    found = {(r.doc_id, r.class_id) for r in ngram_join.near_duplicates(docs.where("source = 's' and n_chars = 1")).collect()}
    assert found == {(None, 7), (7, 7), (None, None), (3, 3), (5, 3), (5, 5)}


def test_large_groups_of_near_copies_keep_all_links(spark):
    words = prose(7, 150).split()
    rows = []
    for i in range(420):
        w = list(words)
        w[20 + i % 100] = f"x{i}"
        w[25 + (i * 7) % 100] = f"y{i}"
        rows.append((i, " ".join(w), "en", "a", 1))
    rows += [(1000 + i, prose(100 + i, 60), "en", "b", 1) for i in range(50)]
    sets = [shingle_set(r[1]) for r in rows]
    expected = {rows[i][0]: sum(len(sets[i] & s) >= 0.8 * len(sets[i] | s) for s in sets) - 1 for i in range(len(rows))}
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(expected.values()) > 30_000
    many = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=150).collect()}
    one = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert many == one
    assert all(got[k] <= expected[k] for k in expected) and sum(got.values()) >= 0.999 * sum(expected.values())


def test_band_choice_reaches_the_recall():
    for threshold in (0.5, 0.7, 0.8, 0.9):
        bands, rows = ngram_join.bands_for(threshold, 0.9999, 200)
        assert 1 - (1 - threshold**rows) ** bands >= 0.9999


def test_components(spark):
    edges = [(f"{i:03}", f"{i + 1:03}") for i in range(30)] + [("x1", "x2"), ("x2", "x1"), ("x3", "x3")]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert {got[f"{i:03}"] for i in range(31)} == {"000"} and got["x1"] == got["x2"] == "x1"
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_decontamination_against_brute_force(spark, docs, empty):
    long = ROWS[8][1].split()
    items = [(1, " ".join(BASE.split()[10:40])), (2, " ".join(long[20_000:20_050])), (3, "two words"), (4, None), (5, ""), (6, prose(99, 30)), (6, " ".join(BASE.split()[40:60])), (7, " ".join(long[:15] + ["zz"]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    clash = docs.withColumn("leaks", F.lit("mine")).withColumn("item_id", F.lit(1))
    got = sorted(((r.doc_id, sorted({(x.item_id, round(x.containment, 9)) for x in r.leaks})) for r in decontaminate.find_leaks(clash, bench).collect()), key=repr)
    expected = []
    for r in ROWS:
        own, found = shingle_set(r[1]), set()
        for i, t in items:
            s = shingle_set(t)
            if len((t or "").split()) >= 5 and len(s & own) / len(s) >= 0.8:
                found.add((i, round(len(s & own) / len(s), 9)))
        for i, t in items:
            w, said = (t or "").lower().split(), (r[1] or "").lower().split()
            if 0 < len(w) < 5 and any(said[k : k + len(w)] == w for k in range(len(said))):
                found.add((i, 1.0))
        expected.append((r[0], sorted(found)))
    assert got == sorted(expected, key=repr) and any((3, 1.0) in found for _, found in expected)
    several = decontaminate.find_leaks(clash, bench, items_a_pass=2)
    assert sorted(((r.doc_id, sorted({(x.item_id, round(x.containment, 9)) for x in r.leaks})) for r in several.collect()), key=repr) == got and several.columns[-1] == "leaks"
    assert decontaminate.drop_leaks(docs, bench, items_a_pass=3).count() == sum(not found for _, found in expected)
    assert decontaminate.drop_leaks(docs, bench).columns == docs.columns
    assert decontaminate.find_leaks(empty, bench).count() == 0
    assert decontaminate.find_leaks(docs, bench.where("false")).where(F.size("leaks") > 0).count() == 0


def test_window_search_finds_passages_at_any_offset():
    rng, text = np.random.default_rng(0), prose(5, 3000).split()
    items, spots = [], rng.integers(0, 2900, 200)
    for k, s in enumerate(spots):
        items.append(" ".join(text[s : s + 15 + k % 60]))
    index = decontaminate.ContainmentIndex(list(range(200)), items, 0.8)
    assert len(index.search([" ".join(text)])[0]) >= 199


def test_short_items_are_all_found_at_any_offset():
    rng, text = np.random.default_rng(1), prose(6, 4000).split()
    items = []
    for k, s in enumerate(rng.integers(0, 3900, 600)):
        own = text[s : s + 1 + k % 24]
        items.append(" ".join(own if k % 2 else [*own[:-1], "changed"]))
    index = decontaminate.ContainmentIndex(list(range(600)), items, 0.8)
    whole = shingle_set(" ".join(text))
    expected = {k: len(shingle_set(t) & whole) / len(shingle_set(t)) for k, t in enumerate(items) if len(t.split()) >= 5}
    runs = {n: {tuple(text[i : i + n]) for i in range(len(text) - n + 1)} for n in range(1, 5)}
    expected |= {k: 1.0 for k, t in enumerate(items) if len(t.split()) < 5 and tuple(t.split()) in runs[len(t.split())]}
    expected = {k: v for k, v in expected.items() if v >= 0.8}
    short = lambda found: {k: v for k, v in found.items() if len(items[k].split()) <= 20}
    got = dict(index.search(["", " ".join(text), "two words"])[1])
    assert short(got) == short(expected) and len(short(expected)) > 250 and sum(len(items[k].split()) < 5 for k in expected) >= 50
    assert all(got[k] == expected[k] for k in got)
    beside = index.search([None, "two words", " ".join(text[:4]), items[3]])  # a phrase across two texts of a batch is in neither
    assert beside[:2] == [[], []] and all(len(items[k].split()) < 5 and items[k] in " ".join(text[:4]) for k, _ in beside[2]) and 3 in dict(beside[3])


def test_line_dedup(spark, empty):
    rows = [(i, f"Shared line\nown {i}\n\n  Shared line  \nrare {i % 3}", "en", f"s{i}", 1) for i in range(12)]
    rows += [(20, None, "en", "s1", 0), (21, "", "en", None, 0), (None, "Shared line", "en", None, 1), (0, "own 0\nShared line", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("n_removed", F.lit("mine"))
    got = line_dedup.remove_boilerplate(docs, min_sites=5)
    by = {(r.doc_id, r.n_lines): (r.text, r.n_removed) for r in got.collect()}
    assert got.count() == len(rows) and by[(3, 5)] == ("own 3\n\nrare 0", 2) and by[(20, 0)] == (None, 0) and by[(21, 1)] == ("", 0) and by[(None, 1)] == ("", 1) and by[(0, 2)] == ("own 0", 1)
    assert line_dedup.remove_boilerplate(empty).count() == 0


def test_line_dedup_with_clashing_columns_hot_nulls_and_long_texts(spark):
    # A third of the rows have no id; each keeps a list of its own lines. A line on five sites is at the bound, one on four under it.
    rows = [(None if i % 3 else i, f"at the bound\nevery site\nown {i}\n\nevery site" if i % 12 < 5 else f"every site\nunder it {i % 12 - 5 if i % 12 < 9 else i}", "en", f"s{i % 12}", 1) for i in range(360)]
    rows += [(400, "\n".join(["every site", *[f"line {k}" for k in range(40_000)], "at the bound "]), "en", "s0", 1), (400, "every site", "en", "s0", 1), (400, "every site", "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(c).alias(c) for c in ("id", "a", "b", "_bad", "_one", "_kept", "at")])
    got = line_dedup.remove_boilerplate(docs, min_sites=5)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.where("id = 'id' and _bad = '_bad' and _one = '_one' and at = 'at'").count() == len(rows)
    sites = collections.defaultdict(set)
    for _, text, _, site, _ in rows:
        for line in text.split("\n"):
            sites[line.strip(" ")].add(site)
    bad = {line for line, s in sites.items() if line and len(s) >= 5}
    assert bad == {"at the bound", "every site"}
    expected = []
    for i, text, *_ in rows:
        kept = [x for x in text.split("\n") if x.strip(" ") not in bad]
        expected.append((i, "\n".join(kept), text.count("\n") + 1, text.count("\n") + 1 - len(kept)))
    assert sorted(map(repr, expected)) == sorted(repr((r.doc_id, r.text, r.n_lines, r.n_removed)) for r in got.collect())


def test_sharding(docs, empty):
    table = sharding.fill_table(7, 1009)
    counts = collections.Counter(table)
    assert set(counts) == set(range(7)) and max(counts.values()) - min(counts.values()) <= 1
    more = sharding.fill_table(8, 1009)
    assert sum(a != b for a, b in zip(table, more, strict=True)) < 0.3 * 1009
    got = sharding.assign_shards(docs.withColumn("shard", F.lit("mine")), shards=7, size=1009).collect()
    for r in got:
        slot = int(hashlib.md5(("" if r.doc_id is None else str(r.doc_id)).encode()).hexdigest()[:15], 16) % 1009
        assert (r.slot, r.shard) == (slot, table[slot])
    assert len(got) == len(ROWS) and sharding.assign_shards(empty).count() == 0
    with pytest.raises(ValueError):
        sharding.fill_table(3, 100)


def test_table_is_filled_in_turns():
    shards, size, table = 5, 101, [None] * 101
    orders = []
    for s in range(shards):
        first, step = (int(hashlib.md5(f"{k} {s}".encode()).hexdigest()[:15], 16) for k in ("offset", "step"))
        orders.append([(first + i * (step % (size - 1) + 1)) % size for i in range(size)])
    for turn in range(size):
        s = turn % shards
        slot = next(x for x in orders[s] if table[x] is None)
        table[slot] = s
    assert tuple(table) == sharding.fill_table(shards, size)


def test_mixing(spark, docs, empty):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 200))), "en", s, 1) for i, s in enumerate(rng.choice(["a", "b", "c", "d", None], 3000, p=[0.6, 0.2, 0.1, 0.05, 0.05]))]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(frame).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(r[1].split())
    total, weights, caps = sum(sizes.values()), dict(zip(["a", "b", "c", "d", None], [1, 2, 3, 1, 2], strict=True)), set()
    while True:
        free = [s for s in sizes if s not in caps]
        level = (total - sum(3 * sizes[s] for s in caps)) / sum(weights[s] for s in free)
        over = {s for s in free if level * weights[s] > 3 * sizes[s]}
        if not over:
            break
        caps |= over
    taken = collections.Counter()
    for r in got:
        target = 3 * sizes[r.source] if r.source in caps else level * weights[r.source]
        assert r.source_size == sizes[r.source] and math.isclose(r.target, target) and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - (3 * sizes[s] if s in caps else level * weights[s])) <= 400
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in mixing.mix(frame.repartition(7)).collect())
    assert mixing.mix(docs.withColumn("size", F.lit("mine"))).count() == len(ROWS) and mixing.mix(empty).count() == 0
    assert mixing.repeat_copies(mixing.mix(docs)).columns == docs.columns


TURNS = "conv_id bigint, turn int, role string, text string"


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nx", "<~|a <~~|b <s> [~INST]", "", None, "a\nb\n", "é<|", "<", "~"]
    rows = [(-1, 0, "user", nasty[0]), (-1, 1, "assistant", nasty[0])]
    rows += [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], nasty[i % len(nasty)]) for i in range(40)]
    rows += [(2, i, ("user", "assistant")[i % 2], prose(i, 300)) for i in range(9)] + [(None, 0, None, "x"), (3, 0, "tool|<|im_start|>\nodd", "y"), (3, 0, "assistant", "y"), (3, 0, "assistant", "y")]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS).withColumn("window", F.lit("mine")), budget=200, history=50)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for conv in (-1, 1, 2, None, 3):
        turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    long = windows.where("conv_id = 1").orderBy("window").collect()
    assert len(long) > 1 and all(w.text.startswith("<|im_start|>system\n") and w.n_tokens <= 200 for w in long) and all(w.context_turns >= 1 for w in long[1:])
    assert sum(w.text.count("<|im_end|>\n") for w in long) == 40 + sum(w.context_turns for w in long)
    assert chat.digests(chat.format_windows(spark.createDataFrame([], TURNS))).count() == 0


def greedy(sizes, system, budget, history):
    """Windows of a sequential choice, as lists of own turns."""
    out, used, limit = [[0]], sizes[0], budget
    for i, n in enumerate(sizes[1:], 1):
        if used + n > limit:
            out.append([])
            used, limit = 0, max(1, budget - history - system)
        out[-1].append(i)
        used += n
    return out


def test_chat_windows_hold_the_budget(spark):
    rng, rows, expected = np.random.default_rng(4), [], {}
    for conv in range(60):
        n, system = int(rng.integers(1, 90)), int(rng.choice([0, 0, 3, 40, 100, 150, 210]))
        sizes = [int(x) for x in rng.choice([1, 3, 20, 60, 97, 130, 190, 260], n)]
        turns = ([("system", system)] if system else []) + [(("user", "assistant")[i % 2], s) for i, s in enumerate(sizes)]
        rows += [(conv, i, r, " ".join(f"w{i}x{j}" for j in range(s))) for i, (r, s) in enumerate(turns)]
        sizes = [s + 4 for _, s in turns]
        expected[conv] = (greedy(sizes, system + 4 if system else 0, 200, 50), sizes, system + 4 if system else 0)
    windows = chat.read_turns(chat.format_windows(spark.createDataFrame(rows, TURNS), budget=200, history=50)).collect()
    for conv, (spans, sizes, system) in expected.items():
        mine = sorted((w for w in windows if w.conv_id == conv), key=lambda w: tuple(w.window))
        assert [len(w.turns) for w in mine] == [len(s) for s in spans]
        for w, span in zip(mine, spans, strict=True):
            assert w.n_tokens <= 200 or (len(span) == 1 and sizes[span[0]] + system > 200)
            past = w.n_tokens - sum(sizes[i] for i in span) - (system if span[0] else 0)
            assert 0 <= past <= 50
            room, before = min(50, 200 - system - sum(sizes[i] for i in span)), [sizes[i] for i in range(1 if system else 0, span[0])]
            while before and before[-1] <= room:
                room -= before.pop()
            assert not span[0] or past == sum(sizes[(1 if system else 0) : span[0]]) - sum(before)


def test_a_conversation_of_many_blocks_hands_on_its_system_turn(spark):
    rows = [(1, i, "system" if i == 0 else ("user", "assistant")[i % 2], f"turn {i} " + "w " * (i % 7)) for i in range(1300)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS), budget=200, history=50)
    got = sorted(windows.collect(), key=lambda w: tuple(w.window))
    assert all(w.text.startswith("<|im_start|>system\nturn 0") and w.n_tokens <= 200 for w in got) and all(w.context_turns >= 2 for w in got[1:])
    said = "".join(f"{r}\n{x}\n" for _, _, r, x in rows)
    assert chat.digests(windows).collect()[0].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()


def labelled(spark, n=700):
    rng, rows, marks = np.random.default_rng(3), [], []
    for i in range(n):
        bad, rude = i % 5 == 0, i % 6 == 1
        words = prose(1000 + i, int(rng.integers(20, 200))).split()
        if bad:
            words = [w + "%%%" for w in words]
        if rude:
            words.insert(int(rng.integers(0, len(words))), ("zounds", "gadzooks", "blackguardly", "blackguarded")[i % 4])
        rows.append((i, " ".join(words), "en", "a", 1))
        marks.append((i, int(not bad), int(rude)))
    return spark.createDataFrame(rows + [(9001, None, None, None, None), (9002, "", "en", "a", 0), (None, "x y", "en", "a", 1)], SCHEMA), spark.createDataFrame(marks + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int"), marks


def test_quality_on_held_out_rows(spark, empty):
    docs, labels, marks = labelled(spark)
    got = {r.doc_id: r for r in quality.quality(docs.withColumn("score", F.lit("mine")), labels).collect()}
    assert len(got) == 703 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    held = [(got[i].predicted, q) for i, q, _ in marks if got[i].held_out]
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    assert quality.quality(empty, labels).count() == 0 and quality.quality(docs, labels.where("false")).count() == 703


def test_tree_traversal_equals_recursion():
    rng = np.random.default_rng(0)
    x, y = rng.random((500, 4)), (rng.random(500) > 0.5).astype(float)
    model = quality.fit_trees(x, y, trees=5, depth=3)

    def walk(bins, tree, node=0):
        if node >= 7:
            return model.leaf[tree, node - 7]
        return walk(bins, tree, 2 * node + 1 + int(bins[model.feature[tree, node]] > model.split[tree, node]))

    bins = model.binned(x)
    assert np.allclose(model.margin(x), [model.base + sum(walk(b, t) for t in range(5)) for b in bins])


def test_toxicity_on_held_out_rows(spark, empty):
    docs, labels, marks = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs.withColumn("score", F.lit("mine")), labels).collect()}
    assert len(got) == 703 and all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values())
    held = [(got[i].predicted, t) for i, _, t in marks if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)
    assert toxicity.toxicity(empty, labels).count() == 0 and toxicity.toxicity(docs, labels.where("false")).where("predicted = 1").count() == 0


def test_long_labelled_documents_are_fitted_on_whole(spark):
    docs, labels, marks = labelled(spark)
    long = docs.withColumn("text", F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit(prose(60, 5000) + " "), "text", F.lit(" " + prose(61, 5000)))).otherwise(F.col("text")))
    got = {r.doc_id: r for r in toxicity.toxicity(long, labels).collect()}
    held = [(got[i].predicted, t) for i, _, t in marks if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.9 * len(held)


def test_the_sample_of_labelled_texts_has_no_part_of_a_text(spark, monkeypatch):
    rows = [(i, "x" * (100 + i)) for i in range(50)] + [(7, "x" * 107)] * 2 + [(50, "y" * 10_000), (51, None), (None, "z")]
    docs, seen = spark.createDataFrame(rows, "doc_id bigint, text string"), []
    labels = spark.createDataFrame([(i, i % 2) for i in range(52)] + [(3, 0), (None, 1)], "doc_id bigint, toxic int")
    monkeypatch.setattr(toxicity, "fit", lambda texts, y: seen.append((texts, y.tolist())))
    for chars in (3_000, 10**6):
        toxicity.train(docs, labels, F.lit(False), chars=chars)
    few, every = seen
    assert sum(len(t or "") for t in few[0]) <= 3_000 and 10 < len(few[0]) < 30 and set(few[0]) <= {t for _, t in rows}
    assert sorted(t or "" for t in every[0]) == sorted([t or "" for i, t in {r[0]: r for r in rows}.values() if i is not None] + ["x" * 103]) and sum(every[1]) == 26


def test_only_near_copies_are_left_out_of_the_fit():
    base = prose(70, 200).split()
    half = base[:100] + prose(71, 100).split()  # similar at about a third
    near = list(base)
    near[50] = "changed"
    texts = [" ".join(base), " ".join(half), " ".join(near), " ".join(base), "", None, " ".join(base[150:] + prose(72, 150).split())]
    assert toxicity._unlike(texts, np.zeros(7)).tolist() == [0, 1, 6]
    assert toxicity._unlike(texts[:4], np.array([0, 0, 1, 1])).tolist() == [0, 1, 2]


def test_network_forward_against_a_plain_recurrence():
    net, texts = toxicity.Network(2), ["one two three zounds", "four"]
    rng = np.random.default_rng(0)
    for v in net.p.values():
        v += 0.2 * rng.standard_normal(v.shape).astype(np.float32)
    t = toxicity.Tokens(texts)
    grid, _ = t.windows()
    x, sigmoid, H = net.inputs(t).astype(float), lambda z: 1 / (1 + np.exp(-z)), toxicity.HIDDEN
    expected = []
    for row in grid:
        cells, sides = [c for c in row if c >= 0], []
        for side in "fb":
            h, states = np.zeros(H), {}
            for k in range(len(cells)) if side == "f" else reversed(range(len(cells))):
                i, r = x[cells[k]] @ net.p[f"x{side}"] + net.p[f"c{side}"], h @ net.p[f"h{side}"]
                z, s = sigmoid(i[:H] + r[:H]), sigmoid(i[H : 2 * H] + r[H : 2 * H])
                h = states[k] = (1 - z) * np.tanh(i[2 * H :] + s * r[2 * H :]) + z * h
            sides.append(states)
        both = [np.concatenate((sides[0][k], sides[1][k])) for k in range(len(cells))]
        energy = np.exp([b @ net.p["a"] for b in both])
        expected.append(sum(e * b for e, b in zip(energy / energy.sum(), both, strict=True)) @ net.p["out"] + net.p["bias"][0])
    assert np.allclose(net.forward(net.inputs(t), grid), expected, atol=1e-4) and np.allclose(net.logits(net.inputs(t), grid), expected, atol=1e-4)


def test_network_gradients():
    net, texts = toxicity.Network(1), ["one two three zounds", "four five six"]
    t = toxicity.Tokens(texts)
    grid, y = t.windows()[0], np.array([1, 0], np.float32)
    loss = lambda: float(np.mean([np.log1p(np.exp(-z)) if k else np.log1p(np.exp(z)) for z, k in zip(net.forward(net.inputs(t), grid).astype(float), y, strict=True)]))
    g = net.gradients(t, net.inputs(t), grid, y, np.ones(2, np.float32))
    for name, at in (("hf", (2, 3)), ("xb", (5, 7)), ("a", (4,)), ("out", (3,)), ("cb", (20,))):
        old, e = net.p[name][at], 1e-2
        net.p[name][at] = old + e
        up = loss()
        net.p[name][at] = old - e
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3 + 0.02 * abs(g[name][at])


def test_every_window_is_scored():
    t = toxicity.Tokens([prose(1, 200), "", None, "one"])
    grid, owner = t.windows()
    assert set(owner) == {0, 1, 2, 3} and all(len(set(grid[owner == d].ravel()) - {-1}) == len(set(t.index[t.at[d] : t.at[d + 1]])) for d in range(4))


def test_language_model_against_counts(spark, docs, empty):
    got = language_model.score_documents(docs.withColumn("score", F.lit("mine"))).collect()
    tokens = [re.findall(rb"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "").encode()) + [None] for r in ROWS]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in ROWS]
    counts = collections.Counter(t for ts, h in zip(tokens, held, strict=True) if not h for t in ts)
    n, v = sum(counts.values()), len(counts)
    expected = sorted(((r[0], h, len(ts), sum(t in counts for t in ts), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in ts), 6)) for r, ts, h in zip(ROWS, tokens, held, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=repr) == expected
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language_model.score_documents(empty).count() == 0


def small_model(words=30, others=7):
    rng = np.random.default_rng(0)
    order, at = language_model.classes_of(rng.random((words, 6)), rng.integers(1, 50, words).astype(float))
    return language_model.LogBilinear(rng.integers(0, 50, words + others), order, at)


def test_probabilities_are_normalised_over_classes_and_words():
    model = small_model()
    assert len(model.at) - 1 == 4 and sorted(model.slot[:30].tolist()) == list(range(30)) and max(np.diff(model.at)) - min(np.diff(model.at)) <= 1
    context = np.array([3, 9, 36, 1], np.uint16)
    total = sum(np.exp(model.log_probabilities(np.append(context, np.uint16(u)), np.array([0, 5])))[-1] for u in range(37))
    assert abs(total - 1) < 1e-5


def test_log_probabilities_against_a_plain_loop():
    model = small_model()
    rng = np.random.default_rng(1)
    for v in model.p.values():
        v += 0.3 * rng.standard_normal(v.shape).astype(np.float32)
    slots, at = rng.integers(0, 37, 60).astype(np.uint16), np.array([0, 1, 41, 60])
    p = {k: v.astype(float) for k, v in model.p.items()}
    expected = []
    for low, high in zip(at[:-1], at[1:], strict=True):
        for i in range(low, high):
            before = [int(s) for s in slots[low:i]]
            far = before[-language_model.SPAN :]
            h = p["weights"][-1] * (sum(p["context"][s] for s in far) / len(far) if far else 0)
            for k in range(language_model.POSITIONS):
                h = h + p["weights"][k] * (p["context"][before[-1 - k]] if k < len(before) else p["context"][-1])
            soft = lambda z, own: z[own] - math.log(sum(math.exp(x) for x in z))
            kind = int(model.kind[slots[i]])
            value = soft(p["class"] @ h + p["class_bias"], kind)
            if slots[i] < 30:
                x, y = model.at[kind], model.at[kind + 1]
                value += soft(p["word"][x:y] @ h + p["word_bias"][x:y], int(slots[i]) - x)
            expected.append(value)
    assert np.allclose(model.log_probabilities(slots, at), expected, atol=1e-4)


def test_language_model_gradients_of_contexts():
    model = small_model()
    rng = np.random.default_rng(2)
    slots, at = rng.integers(0, 37, 50).astype(np.uint16), np.array([0, 20, 22, 50])
    start = np.repeat(at[:-1], np.diff(at))
    target = rng.standard_normal((50, language_model.SIZE)).astype(np.float32)
    _, c = model.hidden(slots, start, 0, 50)
    before = {k: v.copy() for k, v in model.p.items()}
    memory = {k: np.zeros_like(v) for k, v in model.p.items()}
    model._step_contexts(c, target, memory)
    found = {k: np.sign(before[k] - model.p[k]) * np.sqrt(memory[k]) for k in ("context", "weights")}
    model.p = {k: v.astype(np.float64) for k, v in before.items()}
    for name, cell in (("context", (int(slots[3]), 2)), ("context", (int(slots[21]), 5)), ("context", (-1, 0)), ("weights", (1, 4)), ("weights", (3, 7))):
        values = []
        for e in (1e-3, -2e-3):
            model.p[name][cell] += e
            values.append(float((model.hidden(slots, start, 0, 50)[0] * target).sum()))
        model.p[name][cell] += 1e-3
        assert abs((values[0] - values[1]) / 2e-3 - found[name][cell]) < 0.02 * abs(found[name][cell]) + 0.02


def test_language_model_trains_on_every_position():
    rng = np.random.default_rng(3)
    model = small_model()
    slots, at = rng.integers(0, 37, 1400).astype(np.uint16), np.arange(0, 1401, 7)
    assert model.train(slots, at, rng, model.memory()) == 1400
    # A word that occurs once learns, wherever it stands.
    for spot in range(4):
        slots = np.full(280, 1, np.uint16)
        slots[spot] = 5
        model = small_model()
        before = model.p["word"][5].copy()
        model.train(slots, np.array([0, 280]), np.random.default_rng(spot), model.memory())
        assert (model.p["word"][5] != before).any()


def test_language_model_beats_its_base_whatever_the_layout(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one, many = ({r.doc_id: r for r in language_model.score_documents(docs.repartition(n)).collect()} for n in (1, 8))
    assert all(abs(one[i].score - many[i].score) <= 1e-6 * abs(one[i].score) and one[i].base_score == pytest.approx(many[i].base_score, rel=1e-12) for i in one)
    held = [r for r in one.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 100


def test_models_of_many_shards_are_added_in_levels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    total = language_model.score_documents(docs).first().train_tokens
    shard = -(-total // 8)  # eight shards
    some = [{r.doc_id: r for r in language_model.score_documents(docs.repartition(n), shard=shard, fan=fan).collect()} for n, fan in ((1, 64), (6, 2), (3, 3))]
    for other in some[1:]:
        assert all(abs(some[0][i].score - r.score) < 1e-6 * abs(r.score) and some[0][i].base_score == pytest.approx(r.base_score) for i, r in other.items())
    held = [r for r in some[0].values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


@pytest.mark.parametrize("fan", (2, 5, 64))
def test_sums_of_vectors_in_levels(spark, fan):
    rng = np.random.default_rng(fan)
    vectors, weights = rng.standard_normal((37, 20_000)).astype(np.float32), rng.random(37)
    rows = [(p, o, float(weights[o]), v[i : i + language_model._PART].tobytes()) for o, v in enumerate(vectors) for p, i in enumerate(range(0, 20_000, language_model._PART))]
    table = spark.createDataFrame(rows, language_model._PARTS).repartition(5)
    assert np.allclose(language_model.summed(table, "f4", 37, fan), np.average(vectors.astype(float), 0, weights), atol=1e-12)
    assert language_model.summed(table.where("false"), "f4", 37, fan) is None


def test_a_conversation_without_turn_numbers_is_many_rows(spark):
    rows = [(None, None, ("user", "assistant")[i % 2], f"said {i} " + "w " * (i % 5)) for i in range(20_000)] + [(7, 5, "user", f"same number {i}") for i in range(3000)] + [(8, i, "user", "short") for i in range(3)]
    windows = chat.format_windows(spark.createDataFrame(rows, TURNS).repartition(6), budget=200, history=50)
    got = {r.conv_id: r for r in chat.digests(windows).collect()}
    for conv in (None, 7, 8):
        turns = sorted((r, x) for c, _, r, x in rows if c == conv)
        assert got[conv].n_turns == len(turns) and got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
    assert chat._divided(spark.createDataFrame([(False, "a", (0, 0), None, "", f"{i}", 4) for i in range(4000)], "kn boolean, k string, block struct<at:bigint,part:bigint>, turn bigint, role string, body string, tokens bigint")).groupBy("block").count().agg(F.max("count")).first()[0] <= chat.BLOCK
    assert windows.where("n_tokens > 200").count() == 0


def plain_statistics(text):
    """The statistics of one text, counted one after the other."""
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0d]+", raw)
    low = [w.lower() for w in words]
    n, size, count = len(words), max(len(raw), 1), max(len(words), 1)
    kinds = collections.Counter(int(quality._KIND[b]) for b in raw)
    letters = lambda w: sum(int(quality._KIND[b]) in (quality._UPPER, quality._LOWER, quality._HIGH) for b in w)
    pairs = list(zip(low, low[1:]))
    lines = [tuple(x) for x in (re.findall(rb"[^\x20\x09-\x0d]+", line.lower()) for line in raw.split(b"\n")) if x]
    letter = max(kinds[quality._UPPER] + kinds[quality._LOWER] + kinds[quality._HIGH] / 2, 1)
    share = lambda k, of: kinds[k] / of
    return {
        "log_bytes": math.log1p(len(raw)), "log_words": math.log1p(n), "word_length": sum(map(len, words)) / count, "long_words": sum(len(w) > 12 for w in words) / count,
        "short_words": sum(len(w) <= 3 for w in words) / count, "upper": kinds[quality._UPPER] / letter, "digits": share(quality._DIGIT, size), "marks": share(quality._MARK, count),
        "symbols": share(quality._SYMBOL, count), "bangs": share(quality._BANG, count), "bars": share(quality._BAR, count), "spaces": share(quality._SPACE, size), "newlines": share(quality._NEWLINE, count),
        "beyond_ascii": share(quality._HIGH, size), "distinct_words": len(set(low)) / count, "next_same": sum(a == b for a, b in pairs) / count,
        "distinct_pairs": len(set(pairs)) / max(len(pairs), 1) if n != 1 else 1.0, "most_common": max(collections.Counter(low).values(), default=0) / count, "distinct_lines": len(set(lines)) / max(len(lines), 1),
        "line_length": n / max(len(lines), 1), "ends_in_symbol": sum(int(quality._KIND[w[-1]]) in (quality._SYMBOL, quality._BANG) for w in words) / count,
        "no_letter": sum(not letters(w) for w in words) / count, "distinct_bytes": len(set(raw)),
    }


def test_statistics_against_a_plain_loop():
    texts = ["", None, "One", "One one ONE two!", "a b\na b\n\nc d?\n", "É à 12,5 % | #x $ !!", prose(80, 400) + "\n" + prose(80, 400), "x" * 50_000 + " y", "\t\n  ", "w " * 3000, "ab\n" * 40, "!? ## 12 ..."]
    got = quality.statistics(texts)
    assert got.shape == (len(texts), len(quality.STATISTICS))
    for text, row in zip(texts, got, strict=True):
        expected = plain_statistics(text)
        assert {k: pytest.approx(expected[k], abs=1e-9) for k in quality.STATISTICS} == dict(zip(quality.STATISTICS, row, strict=True)), (text or "")[:40]


def test_quality_of_repeated_rows_and_very_long_texts(spark):
    docs, labels, _ = labelled(spark)
    extra = spark.createDataFrame([(5000, prose(90, 200_000)), (5001, "same text here"), (5001, "same text here"), (5001, "same text here")], "doc_id bigint, text string")
    more = docs.select("doc_id", "text").unionByName(extra)
    both = [{(r.doc_id, r.score) for r in quality.quality(more.repartition(n), labels.unionByName(labels)).collect()} for n in (1, 5)]
    assert len([x for x in both[0] if x[0] == 5001]) == 1 and both[0] == both[1] and all(0 <= s <= 1 for _, s in both[0])
