"""Audit of how filters interact: Walsh-Hadamard sums of failure masks, inverted to counts of masks, and what every order removes."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, settle

#: Texts under WORDS_AT_LEAST words fail A; under DISTINCT percent distinct words B; over UPPER percent of A-Z among code points C.
WORDS_AT_LEAST, DISTINCT, UPPER = 100, 80, 10
#: A text that holds one of these fails D. Fixed values.
BANNED = "[#$%&*|]"


def text_failures(text: Column) -> dict[str, Column]:
    """Conditions A to D on a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    # The words are a list once, seen by two conditions.
    counts = F.transform(F.array(words), lambda w: F.struct(F.size(w).cast("bigint").alias("n"), F.size(F.array_distinct(w)).cast("bigint").alias("distinct")))[0]
    return {
        "A": counts["n"] < WORDS_AT_LEAST,
        "B": counts["distinct"] * 100 < counts["n"] * DISTINCT,
        "C": F.length(F.regexp_replace(text, "[^A-Z]+", "")) * 100 > F.length(text) * UPPER,
        "D": text.rlike(BANNED),
    }


def repeats(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id not null, name of the text) with ``again``: some row of a smaller doc_id has the same text.

    The least id of a text is pre-aggregated where the rows are; then rows look for themselves among those least ids, by id and
    text together, so that a text of a third of all rows isn't a key of any join.
    """
    first = rows.groupBy("text_name").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return rows.join(first, ["doc_id", "text_name"], "left").withColumn("again", F.col("first").isNull()).drop("first")


def parity(mask: Column, subset: Column) -> Column:
    """1 if an even number of the bits of ``subset`` are set in the mask, else -1."""
    return F.lit(1) - F.bit_count(mask.bitwiseAND(subset)) % 2 * 2


def signed_sums(masks: DataFrame, keys: list[str], n: int) -> DataFrame:
    """(keys, sums): per key the 2^n sums of signs of the column ``mask``, one a subset of bits. They add up where the rows are, so
    a key of a third of all rows costs one row a task."""
    sums = [F.sum(parity(F.col("mask"), F.lit(s))).alias(f"s{s}") for s in range(1 << n)]
    return masks.groupBy(*keys).agg(*sums).select(*keys, F.array(*[F.col(f"s{s}") for s in range(1 << n)]).alias("sums"))


def cells(sums: Column, n: int) -> Column:
    """Count of rows of each mask from the signed sums: the transform is its own inverse but for the factor 2^n."""
    every = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    return F.transform(every, lambda m: F.shiftright(F.aggregate(every, F.lit(0).cast("bigint"), lambda a, s: a + parity(m, s) * F.element_at(sums, s + 1)), n))


def _over(cell: Column, n: int, take) -> Column:
    """Sum over masks m of cell[m] * take(m), a number or a condition."""
    def term(m: Column) -> Column:
        return F.element_at(cell, m + 1) * take(m).cast("bigint")

    return F.aggregate(F.sequence(F.lit(0), F.lit((1 << n) - 1)), F.lit(0).cast("bigint"), lambda a, m: a + term(m))


def audit_masks(masks: DataFrame, letters: str) -> DataFrame:
    """Rows of every part, order of filters and step, from (part, mask, good, toxic): bit k of the mask is set if filter
    letters[k] fails; good and toxic are booleans, null for unlabelled rows.

    Nothing but 2^n sums per part and label class is shuffled or kept; orders are evaluated from the counts of masks alone. The sum
    over all n! orders of what a filter removes gives each row n! / (failures of the row) for each filter that it fails.
    """
    n = len(letters)
    flags = {name: F.coalesce(F.col(name), F.lit(False)) for name in ("good", "toxic")}
    sums = signed_sums(masks.select("part", "mask", *[c.alias(k) for k, c in flags.items()]), ["part", "good", "toxic"], n)
    classes = sums.withColumn("cell", cells(F.col("sums"), n))
    added = {"every": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    size = 1 << n
    parts = classes.groupBy("part").agg(*[F.sum(F.when(c, F.col("cell")[m]).otherwise(0)).alias(f"{k}{m}") for k, c in added.items() for m in range(size)])
    parts = parts.select("part", *[F.array(*[F.col(f"{k}{m}") for m in range(size)]).alias(k) for k in added])
    orders = F.split(F.lit(",".join("".join(p) for p in permutations(letters))), ",")
    rows = parts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.expr(f"instr('{letters}', substring(filter_order, step, 1))").cast("int")
    rows = rows.withColumn("bit", F.element_at(F.array(*[F.lit(1 << k) for k in range(n)]), place))
    before = [F.when(F.expr(f"instr(substring(filter_order, 1, step - 1), '{x}') > 0"), 1 << k).otherwise(0) for k, x in enumerate(letters)]
    rows = rows.withColumn("before", sum(before[1:], before[0]))
    bit, gone = F.col("bit"), F.col("before")
    fails = lambda m: m.bitwiseAND(bit) != 0
    here = lambda m: fails(m) & (m.bitwiseAND(gone) == 0)
    share = F.array(*[F.lit(0 if k == 0 else factorial(n) // k) for k in range(n + 1)])
    every = F.col("every")
    return rows.select(
        "part", "filter_order", "step",
        _over(every, n, lambda m: m.bitwiseAND(bit.bitwiseOR(gone)) == 0).alias("kept"),
        _over(every, n, here).alias("removed"),
        _over(every, n, lambda m: fails(m) & (m.bitwiseAND(gone) != 0)).alias("redundant"),
        F.element_at(every, bit + 1).alias("unique_fails"),
        _over(F.col("good"), n, here).alias("good_lost"),
        _over(F.col("toxic"), n, here).alias("toxic_lost"),
        _over(every, n, lambda m: F.when(fails(m), F.element_at(share, F.bit_count(m) + 1)).otherwise(0)).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang",
                 failures: Mapping[str, Column] | None = None) -> DataFrame:
    """What five filters remove in each of their 120 orders, per part: part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley.

    ``failures`` maps letters to conditions on the columns of ``docs`` (default: A to D on the text); the filter E, a text that
    some smaller id has anywhere in the table, is added to them. A null condition is not a failure. Null text is empty, a null part the
    empty string. Rows that repeat an id and text don't fail E for each other; a null id neither fails E nor makes others
    fail. A row is good (toxic) if a row of ``labels`` with its id says 1; null and repeated label rows do no harm. No documents give no rows. Other columns
    of either table are ignored.

    Texts are read once, in tasks of their own; from then on a document is an id, a 256-bit name of its text and a mask.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    failures = dict(failures or text_failures(F.col(text_col)))
    letters = "".join(failures) + "E"
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(failures.values())]
    slim = settle(docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("text_name"),
        sum(bits[1:], bits[0]).alias("mask"),
    ))
    marks = labels.select(F.col("doc_id").alias("doc_id"), "quality", "toxic").where("doc_id is not null and (quality = 1 or toxic = 1)")
    marks = marks.groupBy("doc_id").agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    known = repeats(slim.where("doc_id is not null")).join(marks, "doc_id", "left")
    known = known.select("part", (F.col("mask") + F.when(F.col("again"), 1 << (len(letters) - 1)).otherwise(0)).alias("mask"), "good", "toxic")
    unknown = slim.where("doc_id is null").select("part", "mask", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return audit_masks(known.unionByName(unknown), letters)
