"""Pages of HTML as trees: elements in order of their beginnings, with classes, targets and the stretch of text that they hold.

A task reads a page once with a stack of open tags; what is looked for in it (lists, links, bodies) are Column expressions.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that never hold others (fixed values), and those whose content is no text of the page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(script|style)\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>.*?(?:</\1\s*>|\Z)|<(/?)([a-z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>",
    re.IGNORECASE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"([a-z][\w:-]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
TREE = "text string, nodes array<struct<tag:string,classes:array<string>,href:string,depth:int,last:int,low:int,high:int>>"


def read_tree(page: str | None) -> tuple[str, list[tuple]]:
    """(text, nodes) of a page. The text joins what stands between tags, each piece without outer white space and with its entities
    decoded. A node is (tag, classes, href, depth, last, low, high): it holds the nodes up to number ``last`` and the text from ``low`` to
    ``high``. A closing tag closes the innermost open element of its name and all inside that; without one it means nothing."""
    page = page or ""
    pieces, nodes, stack, size, at = [], [], [], 0, 0

    def say(raw: str) -> None:
        nonlocal size
        if told := html.unescape(raw).strip():
            pieces.append(told)
            size += len(told)

    def close(number: int) -> None:
        nodes[number][4], nodes[number][6] = len(nodes) - 1, size

    for token in _TOKEN.finditer(page):
        say(page[at : token.start()])
        at = token.end()
        raw, raw_said, ending, name, said = token.groups()
        tag = (raw or name or "").lower()
        if not tag:
            continue
        if ending:
            place = next((i for i in range(len(stack) - 1, -1, -1) if nodes[stack[i]][0] == tag), None)
            if place is not None:
                for number in stack[place:]:
                    close(number)
                del stack[place:]
            continue
        attributes = {}
        for k, a, b, c in _ATTRIBUTE.findall(raw_said or said or ""):
            attributes.setdefault(k.lower(), html.unescape(a or b or c))
        nodes.append([tag, attributes.get("class", "").split(), attributes.get("href"), len(stack), 0, size, size])
        nodes[-1][4] = len(nodes) - 1
        if not raw and tag not in VOID and not said.rstrip().endswith("/"):
            stack.append(len(nodes) - 1)
    say(page[at:])
    for number in stack:
        close(number)
    return "".join(pieces), [tuple(n) for n in nodes]


#: Characters of pages whose trees a task holds at once, but for a single longer page.
HELD = 1 << 19


def _pieces(pages: Iterator[pd.Series]) -> Iterator[list[str | None]]:
    """The pages in order, some HELD characters at a time."""
    for series in pages:
        piece, size = [], 0
        for page in series:
            if piece and size + len(page or "") > HELD:
                yield piece
                piece, size = [], 0
            piece.append(page)
            size += len(page or "")
        if piece:
            yield piece


def _trees(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    fields = ("tag", "classes", "href", "depth", "last", "low", "high")
    for piece in _pieces(pages):
        read = [read_tree(p) for p in piece]
        yield pd.DataFrame({"text": [t for t, _ in read], "nodes": [[dict(zip(fields, n, strict=True)) for n in nodes] for _, nodes in read]})


def tree(page: Column | str) -> Column:
    """Struct of text and nodes of each page; a null page has no nodes."""
    return F.pandas_udf(_trees, TREE)(page)


def said(page: Column, node: Column) -> Column:
    """The text of an element."""
    return F.substring(page["text"], node["low"] + 1, node["high"] - node["low"])


def _numbered(page: Column) -> Column:
    return F.transform(page["nodes"], lambda n, i: F.struct(i.alias("at"), n["tag"].alias("tag"), n["classes"].alias("classes"), n["href"].alias("href"), n["depth"].alias("depth"), n["last"].alias("last"), n["low"].alias("low"), n["high"].alias("high")))


def select(page: Column, tag: str, name: str | None = None) -> Column:
    """Elements of a tag, and of a class if one is given, in order: array of nodes with their number ``at``."""
    return F.filter(_numbered(page), lambda n: (n["tag"] == tag) & (F.array_contains(n["classes"], name) if name else F.lit(True)))


def inside(nodes: Column, parent: Column, children: bool = False) -> Column:
    """Those of the (numbered) nodes that a node holds; only its ``children`` if so asked."""
    return F.filter(nodes, lambda n: (n["at"] > parent["at"]) & (n["at"] <= parent["last"]) & ((n["depth"] == parent["depth"] + 1) if children else F.lit(True)))


def list_rows(page: Column, list_class: str, skipped: str = "line", dated: str = "date") -> Column:
    """Rows of a list page: array of (title, href, day) of the entries of the first ul of the class that hold a link with a target and are
    not of the class ``skipped``. The day is that of the span of the class ``dated``, else the one in the target (/a/yyyyMMdd/), else null."""
    bound = F.array(F.struct(F.get(select(page, "ul", list_class), F.lit(0)).alias("list"), select(page, "li").alias("entries"), select(page, "a").alias("links"), select(page, "span", dated).alias("dates")))

    def rows(found: Column) -> Column:
        entries = F.filter(inside(found["entries"], found["list"], children=True), lambda n: ~F.array_contains(n["classes"], skipped))

        def row(entry: Column) -> Column:
            link = F.get(inside(found["links"], entry), F.lit(0))
            shown = F.get(inside(found["dates"], entry), F.lit(0))
            told = F.try_to_date(F.when(said(page, shown).rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), said(page, shown)), "yyyy-M-d")
            day = F.coalesce(told, F.try_to_date(F.nullif(F.regexp_extract(link["href"], r"/a/(\d{8})/", 1), F.lit("")), "yyyyMMdd"))
            return F.struct(said(page, link).alias("title"), link["href"].alias("href"), day.alias("day"))

        return F.filter(F.transform(entries, row), lambda r: F.coalesce(r["href"], F.lit("")) != "")

    return F.coalesce(F.transform(bound, rows)[0], F.array().cast("array<struct<title:string,href:string,day:date>>"))


def paragraphs(page: Column, least: int = 5) -> Column:
    """Body of a detail page: the texts of its paragraphs of more than ``least`` characters, one a line."""
    return F.array_join(F.filter(F.transform(select(page, "p"), lambda n: said(page, n)), lambda t: F.length(t) > least), "\n")


def joined_url(base: Column, href: Column) -> Column:
    """A target as seen from the page at ``base``: whole urls stay, others get the scheme, the host or the folder of the base."""
    origin, folder = F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*)", 1), F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.rlike(r"^[a-zA-Z][\w+.-]*:"), href).when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^([a-zA-Z][\w+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(origin, href)).when(href == "", base).otherwise(F.concat(folder, href))
    )


def keyword_links(page: Column, base: Column, title_words: tuple[str, ...], url_words: tuple[str, ...], excluded: tuple[str, ...], least: int = 5, most: int = 200) -> Column:
    """Links worth following: array of (title, url), each target once in order. A link counts if its title (of more than ``least``
    characters) holds one of the words or its target one of the others, and the target none of those ``excluded``."""
    def any_of(text: Column, words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(text, F.lit(w))
        return out

    links = F.transform(F.filter(select(page, "a"), lambda n: F.coalesce(n["href"], F.lit("")) != ""), lambda n: F.struct(n["href"].alias("href"), n["at"].alias("at"), said(page, n).alias("title")))
    good = F.filter(links, lambda x: (F.length(x["title"]) > least) & (any_of(x["title"], title_words) | any_of(F.lower(x["href"]), url_words)) & ~any_of(F.lower(x["href"]), excluded))
    # Sorted by target, the first link of each stands behind another target; then they go back to the page's order.
    first = F.transform(F.array(F.array_sort(good)), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, F.greatest(i - 1, F.lit(0)))["href"] != x["href"])))[0]
    back = F.array_sort(F.transform(first, lambda x: F.struct(x["at"].alias("at"), x["title"].alias("title"), x["href"].alias("href"))))
    return F.transform(back, lambda x: F.struct(F.left(x["title"], F.lit(most)).alias("title"), joined_url(base, x["href"]).alias("url")))
