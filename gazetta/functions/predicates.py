"""Filters over notices as Column expressions, and the keyword language of the search box."""

from __future__ import annotations

import re
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_keywords(raw: str | None) -> tuple[list[str], list[str]]:
    """Words wanted and words unwanted of a search string: blanks and commas separate, a leading dash negates (blanks after it
    don't count), case is folded, repeats and bare dashes are dropped."""
    wanted, unwanted = [], []
    for word in re.split(r"[\s,，]+", re.sub(r"-\s+", "-", (raw or "").strip().lower())):
        side, word = (unwanted, word[1:]) if word.startswith("-") else (wanted, word)
        if word and word not in side:
            side.append(word)
    return wanted, unwanted


def any_of(parts: list[Column]) -> Column:
    return reduce(or_, parts) if parts else F.lit(False)


def all_of(parts: list[Column]) -> Column:
    return reduce(and_, parts) if parts else F.lit(True)


def matches(text: Column, raw: str | None) -> Column:
    """Some wanted word occurs and no unwanted one does; an empty side doesn't restrict. Null text counts as empty."""
    wanted, unwanted = parse_keywords(raw)
    text = F.lower(F.coalesce(text, F.lit("")))
    found = any_of([F.contains(text, F.lit(w)) for w in wanted]) if wanted else F.lit(True)
    return found & ~any_of([F.contains(text, F.lit(w)) for w in unwanted])


def conjunction(equal: dict[str, object] | None = None, between: dict[str, tuple] | None = None, keyword: tuple[str, list[str]] | None = None) -> Column:
    """All given restrictions; those that are None are left out."""
    parts = [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    for c, (low, high) in (between or {}).items():
        parts += [F.col(c) >= low] * (low is not None) + [F.col(c) <= high] * (high is not None)
    if keyword and keyword[0]:
        parts.append(any_of([F.contains(F.lower(c), F.lit(keyword[0].lower())) for c in keyword[1]]))
    return all_of(parts)


def filled(column: Column, *others: Column) -> Column:
    """The first that is neither null nor the empty string; blanks are not trimmed."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (column, *others)])


def listable(title: Column, code: Column, blocked: tuple[str, ...], groups: tuple[str, ...], barred: tuple[str, ...] = ()) -> Column:
    """Whether a record of a list is collected: a title of five characters or more without blocked words, and a code of an
    allowed group (its first nine characters) that isn't barred. Nulls aren't listable."""
    name = F.trim(F.coalesce(title, F.lit("")))
    code = F.coalesce(code, F.lit(""))
    return (F.length(name) >= 5) & ~any_of([F.contains(name, F.lit(w)) for w in blocked]) & ~code.isin(*barred, "") & F.left(code, F.lit(9)).isin(*groups)


def worth_notice(title: Column, budget_yuan: Column, words: tuple[str, ...], least_yuan: float | None) -> Column:
    """Whether a notice is announced: some word occurs whatever the case (no words: any title), and the budget reaches the least
    one; an unknown budget doesn't stop it."""
    said = any_of([F.contains(F.lower(F.coalesce(title, F.lit(""))), F.lit(w.lower())) for w in words]) if words else F.lit(True)
    return said & F.coalesce(budget_yuan >= least_yuan, F.lit(True)) if least_yuan else said


def period(kind: str, year: int | None = None, quarter: int | None = None, start: date | None = None, end: date | None = None) -> tuple[date, date, str]:
    """Closed range of dates and its label for a quarter, a year or a range of one's own."""
    if kind == "quarter":
        if year is None or quarter not in (1, 2, 3, 4):
            raise ValueError("a quarter needs a year and a number from 1 to 4")
        last = date(year + (quarter == 4), quarter * 3 % 12 + 1, 1).toordinal() - 1
        return date(year, 3 * quarter - 2, 1), date.fromordinal(last), f"{year}Q{quarter}"
    if kind == "year":
        if year is None:
            raise ValueError("a year is missing")
        return date(year, 1, 1), date(year, 12, 31), str(year)
    if kind == "custom":
        if not start or not end or start > end:
            raise ValueError("a range needs a start and an end in order")
        return start, end, f"{start}..{end}"
    raise ValueError(f"unknown period {kind}")
