"""Words of notices: synonyms spelled out, CJK text cut into words of a dictionary, stop words left out."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .vectors import grams

#: Words and their synonyms, in the order in which they are spelled out (fixed values).
SYNONYMS = {
    "智慧": ("智能", "数字化", "信息化"),
    "智能": ("智慧", "数字化", "自动化"),
    "数字化": ("智慧", "智能", "信息化", "数智化"),
    "信息化": ("数字化", "智慧", "智能化"),
    "系统": ("平台", "软件", "应用"),
    "平台": ("系统", "软件", "应用"),
    "软件": ("系统", "平台", "应用"),
    "数据": ("信息", "资料", "数字"),
    "网络": ("互联网", "通信", "宽带"),
    "建设": ("构建", "搭建", "开发"),
    "改造": ("升级", "改建", "扩建"),
    "服务": ("服务", "运维", "运营"),
    "园区": ("工业园", "产业园", "开发区"),
    "监控": ("监测", "监视", "监管"),
    "视频": ("图像", "影像", "摄像"),
    "安全": ("安防", "保卫", "防护"),
    " LED ": ("发光二极管", "led显示屏"),
    "采购": ("购买", "购置", "招标"),
    "招标": ("采购", "投标", "竞标"),
    "工程": ("项目", "建设工程", "基建"),
}
#: Words that say nothing about a notice (fixed values).
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这",
    "那", "中", "大", "为", "与", "等", "其", "对", "或", "可", "更", "被", "但", "并", "从", "以", "及", "之", "而", "于",
)
#: Runs that are cut into words, and runs that are words.
CJK, PLAIN = "[一-鿕]+", "[A-Za-z0-9]+"
#: Words of a dictionary that are sent to every task at most.
DICTIONARY = 2_000_000


def spelled_out(text: Column) -> Column:
    """The text with the word before each of its synonyms, one synonym after the other; later ones see what earlier ones wrote."""
    for word, synonyms in SYNONYMS.items():
        for synonym in synonyms:
            text = F.replace(text, F.lit(synonym), F.lit(f"{word} {synonym}"))
    return text


class Trie:
    """Words with their costs: the negative logarithm of a word's share of all counts."""

    def __init__(self, counts: Mapping[str, int]):
        self.total = max(sum(counts.values()), 1)
        self.root: dict = {}
        for word, n in counts.items():
            node = self.root
            for letter in word:
                node = node.setdefault(letter, {})
            node[""] = math.log(self.total) - math.log(max(n, 1))

    def cut(self, run: str) -> list[str]:
        """The cut of least cost into words of the dictionary and single characters, which cost as much as a word that was counted once.
        Of equal costs the longer word comes first."""
        size, alone = len(run), math.log(self.total)
        cost, step = [0.0] * (size + 1), [1] * size
        for i in range(size - 1, -1, -1):
            best, node = (alone + cost[i + 1], -1), self.root
            for j in range(i, size):
                node = node.get(run[j])
                if node is None:
                    break
                if "" in node:
                    best = min(best, (round(node[""] + cost[j + 1], 9), i - j - 1))
            cost[i], step[i] = best[0], -best[1]
        out, i = [], 0
        while i < size:
            out.append(run[i : i + step[i]])
            i += step[i]
        return out


def _cleaned(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)[^\\w\\s一-鿿]", " ")


def telling(words: Column) -> Column:
    """Words of two characters and more that are no stop words."""
    return F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))


def plain_words(text: Column) -> Column:
    """Words of a text in Latin letters and digits; other runs are left out. No dictionary, no Python."""
    return telling(F.regexp_extract_all(_cleaned(spelled_out(text)), F.lit(PLAIN), 0))


def with_words(rows: DataFrame, text_col: str, dictionary: DataFrame, name: str = "words") -> DataFrame:
    """``rows`` with the telling words of a text in order: synonyms spelled out, CJK runs cut by the dictionary (word, n), other runs of
    letters and digits whole. A null text has none. The dictionary goes to every task and may hold DICTIONARY words."""
    counted = dictionary.groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in counted.limit(DICTIONARY + 1).collect() if r["word"]}
    if len(found) > DICTIONARY:
        raise ValueError(f"a dictionary holds at most {DICTIONARY} words")
    shared, runs = ship(rows.sparkSession).sparkContext.broadcast(found), re.compile(f"{CJK}|{PLAIN}")

    def cut(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        trie = Trie(shared.value)
        for texts in columns:
            yield texts.map(lambda t: [w for run in runs.findall(t) for w in (trie.cut(run) if run[0] > "z" else [run])])

    words = F.pandas_udf(cut, "array<string>")(_cleaned(spelled_out(F.col(text_col))))
    return rows.withColumn(name, telling(words))


def learned_words(docs: DataFrame, text_col: str, longest: int = 4, least: int = 5, cohesion: float = 20.0) -> DataFrame:
    """(word, n): a dictionary out of the texts themselves. Runs of two to ``longest`` CJK characters are words if they occur at least ``least``
    times and ``cohesion`` times as often as the parts of any cut would meet by chance; single characters stand beside them.

    Runs are counted where the texts are; of rare ones only the counts are shuffled.
    """
    run = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(CJK), 0)).alias("run"))
    counts = run.select(F.explode(grams(F.col("run"), 1, longest)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    kept = counts.where((F.col("n") >= least) | (F.length("word") == 1))
    total = counts.where(F.length("word") == 1).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = kept.where(F.length("word") > 1).withColumn("at", F.explode(F.sequence(F.lit(1), F.length("word") - 1)))
    parts = parts.select("word", "n", F.substring("word", F.lit(1), F.col("at")).alias("left"), F.substring("word", F.col("at") + 1, F.length("word")).alias("right"))
    side = lambda name: kept.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"))
    chance = F.col("n").cast("double") * total / (F.col("left_n").cast("double") * F.col("right_n"))
    held = parts.join(side("left"), "left").join(side("right"), "right").groupBy("word", "n").agg(F.min(chance).alias("held")).where(F.col("held") >= cohesion)
    return held.select("word", "n").unionByName(kept.where(F.length("word") == 1))
