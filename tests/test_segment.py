"""Cuts of CJK text against all possible cuts, learned words, synonyms in order."""

import itertools
import math
import random

from gazetta.functions import segment


def all_cuts(run):
    for marks in itertools.product((0, 1), repeat=len(run) - 1):
        at = [0, *[i + 1 for i, m in enumerate(marks) if m], len(run)]
        yield [run[a:b] for a, b in itertools.pairwise(at)]


def test_best_path_against_all_cuts():
    rng = random.Random(3)
    letters = "甲乙丙丁"
    words = ["".join(p) for n in (1, 2, 3, 4) for p in itertools.product(letters, repeat=n)]
    for _ in range(40):
        counts = {w: rng.randint(1, 500) for w in rng.sample(words, 60)}
        trie, total = segment.Trie(counts), sum(counts.values())
        for _ in range(5):
            run = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
            price = lambda cut: sum(math.log(total) - math.log(counts[w]) if w in counts else math.log(total) for w in cut)  # noqa: B023, E731
            allowed = [c for c in all_cuts(run) if all(w in counts or len(w) == 1 for w in c)]
            got = trie.cut(run)
            assert "".join(got) == run and got in allowed and abs(price(got) - min(map(price, allowed))) < 1e-6
    assert segment.Trie({}).cut("甲乙") == ["甲", "乙"] and segment.Trie({"甲乙": 1}).cut("") == []
    assert segment.Trie({"甲": 2}).cut("甲" * 5000) == ["甲"] * 5000


def test_words_of_texts(spark):
    dictionary = spark.createDataFrame([("道路", 90), ("路改", 1), ("改造", 80), ("工程", 70), ("造工", 2), ("智慧", 50), ("城市", 50), ("没有", 9), (None, 3), ("", 1)], "word string, n int")
    texts = ["道路改造工程ABC-12（一期）", "智慧城市,没有x", None, "", "  ", "LED é_l'eau", "城市城市" * 2000]
    rows = spark.createDataFrame([(i, t, "mine") for i, t in enumerate(texts)], "i int, t string, words string")
    got = {r.i: r.words for r in segment.with_words(rows, "t", dictionary).collect()}
    assert got[0] == ["道路", "改造", "工程", "ABC", "12"] and got[1] == ["智慧", "城市"] and got[2] == got[3] == got[4] == [] and got[5] == ["LED", "eau"] and got[6] == ["城市"] * 4000
    plain = {r.i: r.words for r in rows.select("i", segment.plain_words(rows.t).alias("words")).collect()}
    assert plain[0] == ["ABC", "12"] and plain[5] == ["LED", "eau"] and plain[2] == []
    assert segment.with_words(rows.where("false"), "t", dictionary).count() == 0


def test_synonyms_are_spelled_out_in_order(spark):
    def plain(text):
        for word, synonyms in segment.SYNONYMS.items():
            for synonym in synonyms:
                text = text.replace(synonym, f"{word} {synonym}")
        return text

    texts = ["智慧平台", "视频监测系统采购项目", "led显示屏升级", "无"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.x for r in rows.select(segment.spelled_out(rows.t).alias("x")).collect()] == [plain(t) for t in texts]


def test_words_are_learned_from_their_company(spark):
    rng = random.Random(1)
    known = ["道路", "改造工程", "设备", "采购", "城市"]
    filler = [chr(0x5000 + i) for i in range(40)]
    texts = ["".join(rng.choice(known) if rng.random() < 0.5 else rng.choice(filler) for _ in range(12)) for _ in range(600)] + [None, "", "abc"]
    found = {r.word: r.n for r in segment.learned_words(spark.createDataFrame([(t,) for t in texts], "t string"), "t", least=20, cohesion=8.0).collect()}
    long = {w for w in found if len(w) > 1}
    assert set(known) <= long and not any(w[0] in filler or w[-1] in filler for w in long if len(w) == 2)
    assert found["道路"] == sum((t or "").count("道路") for t in texts)
    assert segment.Trie(found).cut("城市道路" + filler[0] + "改造工程") == ["城市", "道路", filler[0], "改造工程"]
