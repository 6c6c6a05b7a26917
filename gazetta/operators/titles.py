"""Groups of notices with similar titles: an exact similarity join of blocks of titles, then groups around first titles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle
from .relevance import terms, weights

#: Most titles, and terms of titles, in a part on average; sums that a step of a comparison holds, and products that it adds up.
HELD, HELD_TERMS, CELLS, PRODUCTS = 16_384, 1_000_000, 1 << 20, 1 << 21


def _plain(title: str) -> F.Column:
    return F.lower(F.trim(F.col(title)))


def distinct_titles(rows: DataFrame, id_col: str, title_col: str) -> DataFrame:
    """(id, title): titles without case and outer blanks, each once with its least id; blank and null titles are left out."""
    return rows.select(F.col(id_col).alias("id"), _plain(title_col).alias("title")).where("title <> ''").groupBy("title").agg(F.min("id").alias("id")).select("id", "title")


def similar_titles(titles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity), a < b: pairs of rows (id, title) whose smoothed TF-IDF cosine reaches the threshold, exactly.

    Parts of the titles meet each other, each two parts once; a meeting is a product of sparse vectors in numpy, so that only pairs that reach
    the threshold become rows. A title is sent once a part, and parts grow in number with the titles, not in size.
    """
    kind = titles.schema["id"].dataType.simpleString()
    w = weights(settle(terms(titles, "id", "title")), titles.count(), smooth=True).where("id IS NOT NULL")
    vectors = settle(w.groupBy("id").agg(F.collect_list(F.struct("term", "w")).alias("v")))
    n, held = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    parts = max(1, -(-n // HELD), -(-held // HELD_TERMS))
    part, other = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    sent = vectors.withColumn("part", part).withColumn("other", other).select("id", "v", "part", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"))
    met = sent.repartition(parts * (parts + 1) // 2, "low", "high").groupBy("low", "high")
    return met.applyInArrow(_near(threshold), f"a {kind}, b {kind}, similarity double")


def _near(threshold: float):
    """The pairs of one meeting: of the rows of both parts, or of all rows if a part meets itself."""

    def near(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        order, part = pc.rank(rows["id"], tiebreaker="dense").to_numpy(), rows["part"].to_numpy()
        sizes, said = pc.list_value_length(rows["v"]).to_numpy().astype(np.int64), pc.list_flatten(rows["v"]).combine_chunks()
        term = said.field("term").dictionary_encode().indices.to_numpy().astype(np.int64)
        owner, w = np.repeat(np.arange(len(sizes)), sizes), said.field("w").to_numpy()
        w = w / np.sqrt(np.bincount(owner, w * w, len(sizes)))[owner]
        low, high = key[0].as_py(), key[1].as_py()
        left, right = np.flatnonzero(part == low), np.flatnonzero(part == high)
        place = np.zeros(len(sizes), np.int64)
        place[right] = np.arange(len(right))
        inside = np.flatnonzero(part[owner] == high)
        inside = inside[np.argsort(term[inside], kind="stable")]
        there, weight = place[owner[inside]], w[inside]
        begins = np.searchsorted(term[inside], np.arange(term.max(initial=-1) + 2))
        first, n = np.cumsum(sizes) - sizes, (begins[1:] - begins[:-1])[term]
        products = np.bincount(owner, n, len(sizes))[left].cumsum()
        found, at = [], 0
        while at < len(left):
            done = products[at - 1] if at else 0
            to = max(at + 1, min(at + max(1, CELLS // max(1, len(right))), int(np.searchsorted(products, done + PRODUCTS, "right"))))
            asked = left[at:to]
            mine = np.repeat(first[asked] - (np.cumsum(sizes[asked]) - sizes[asked]), sizes[asked]) + np.arange(sizes[asked].sum())
            row, many = np.repeat(np.arange(len(asked)), sizes[asked]), n[mine]
            hits = np.repeat(begins[term[mine]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            sums = np.bincount(np.repeat(row * len(right), many) + there[hits], np.repeat(w[mine], many) * weight[hits], len(asked) * len(right))
            reached = np.flatnonzero(sums >= threshold - 1e-9)
            a, b = asked[reached // len(right)], right[reached % len(right)]
            kept = order[a] < order[b] if low == high else order[a] != order[b]
            ahead = order[a] < order[b]
            found.append((np.where(ahead, a, b)[kept], np.where(ahead, b, a)[kept], sums[reached][kept]))
            at = to
        a, b, x = (np.concatenate([f[k] for f in found]) if found else np.empty(0) for k in range(3))
        return pa.table({"a": rows["id"].take(pa.array(a.astype(np.int64))), "b": rows["id"].take(pa.array(b.astype(np.int64))), "similarity": pa.array(x, pa.float64())})

    return near


def around_first(links: DataFrame) -> DataFrame:
    """(id, head) of every node that a first node takes, from links (a, b), a < b: nodes go by id; one that no earlier head
    takes is a head and takes its later neighbours that are still free.

    All nodes without an earlier open neighbour become heads at once; rounds end when no link joins two open nodes.
    """
    links, taken = settle(links.select("a", "b")), None
    left = links
    while not left.isEmpty():
        heads = left.select("a").distinct().join(left.select(F.col("b").alias("a")).distinct(), "a", "left_anti")
        found = settle(left.join(heads, "a", "left_semi").select("b").distinct())
        taken = found if taken is None else settle(taken.unionByName(found))
        gone = settle(heads.unionByName(found.select(F.col("b").alias("a"))))
        left = settle(left.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti"))
    if taken is None:
        return links.select(F.col("b").alias("id"), F.col("a").alias("head"))
    free = links.join(taken.select(F.col("b").alias("a")), "a", "left_anti").join(taken, "b", "left_semi")
    return free.groupBy(F.col("b").alias("id")).agg(F.min("a").alias("head"))


def title_groups(rows: DataFrame, id_col: str, title_col: str, threshold: float = 0.8) -> DataFrame:
    """(id, group_id, group_size) of the rows in groups of two and more; group_id is the least id of the group's first title.

    Titles are compared once each, and rows with equal titles share a group. In order of their least ids, a title that is in
    no group yet starts one and takes the later free titles similar to it. Rows without a title and unlike any other are left out.
    """
    titles = settle(distinct_titles(rows, id_col, title_col))
    heads = around_first(similar_titles(titles, threshold))
    named = titles.join(heads, "id", "left").select("title", F.coalesce("head", "id").alias("group_id"))
    grouped = rows.select(F.col(id_col).alias("id"), _plain(title_col).alias("title")).join(named, "title")
    sizes = grouped.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return grouped.join(sizes, "group_id").select("id", "group_id", "group_size")
