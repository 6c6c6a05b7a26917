"""Trees of pages against the parser of the standard library, broken nesting included."""

import datetime
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F

from gazetta.sources import html_pages


class Plain(HTMLParser):
    """Nested lists [tag, classes, href, children]; strings are children, too."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = ["", [], None, []]
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        seen = {}
        for k, v in attrs:
            seen.setdefault(k, v or "")
        node = [tag, seen.get("class", "").split(), seen.get("href"), []]
        self.open[-1][3].append(node)
        if tag not in html_pages.VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open[-1][0] == tag and tag not in html_pages.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        at = max((i for i, n in enumerate(self.open) if n[0] == tag and i), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data):
        if self.open[-1][0] not in html_pages.RAW:
            self.open[-1][3].append(data)

    def rows(self):
        out = []

        def text(node):
            return "".join(c.strip() if isinstance(c, str) else text(c) for c in node[3])

        def walk(node, depth):
            for c in node[3]:
                if not isinstance(c, str):
                    out.append((c[0], c[1], c[2], depth, text(c)))
                    walk(c, depth + 1)

        walk(self.top, 0)
        return out


def flat(page):
    text, nodes = html_pages.read_tree(page)
    assert all(n[4] >= i and n[5] <= n[6] for i, n in enumerate(nodes))
    return [(tag, classes, href, depth, text[low:high]) for tag, classes, href, depth, _, low, high in nodes]


def plain(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    return parser.rows()


BROKEN = [
    '<ul class="a b"><li><a href="/x?a=1&amp;b=2">T&amp;1 </a><li class=line>two</ul></div><p>after <b>bold<p>open', "<p>a<br>b<br/>c</p></p><img src='x>y'><DIV CLASS='Q'>d</DIV>",
    "<div><span>x</div>y</span>z", "<style>p{}</style><script>var t='</p><p>';</script><p> s </p><!-- <p>no</p> --><td>1<td>2", "no tags &lt;b&gt; at all", "", "<p>&nbsp;</p><p>\n x \n</p>", "<a href=''>e</a><a>n</a><a href>v</a>",
]


def test_trees_agree_with_the_standard_parser(spark):
    for page in BROKEN:
        assert flat(page) == plain(page), page
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    assert len(pages) > 100 and all(flat(p) == plain(p) for p in pages if p)
    assert html_pages.read_tree(None) == ("", []) and len(html_pages.read_tree("<div>" * 20_000 + "x")[1]) == 20_000


def test_lists_links_and_bodies(spark):
    list_page = """<ul class="ul-news wide"><li><a href="/a/20260706/x.html"> First <b>one</b></a><span class="date">2026-07-05</span></li><li class="line"><a href="/n">no</a></li>
        <li><ul><li><a href="/deep">deep</a></li></ul></li><li><a>no target</a></li><li><a href="/a/20260101/y.html">By target</a><span class="date">soon</span></li><li><a href="/z">None</a></li></ul><ul class="ul-news"><li><a href="/2">2</a></li></ul>"""
    body = "<p>Short</p><p>Long enough</p><div><p>Another <i>paragraph</i></p></div>"
    links = '<a href="/t/1">招标公告第一号</a><a href="/T/2">Something else</a><a href="/t/1">招标公告重复了</a><a href="/login/t">招标公告登录页</a><a href="http://h/q">招标公告别处的</a><a href="r">招标公告相对的</a><a href="//o/p">招标公告</a>'
    rows = spark.createDataFrame([(1, list_page), (2, body), (3, links), (4, None), (5, "<ul><li><a href='/x'>x</a></li></ul>")], "i int, html string").select("i", html_pages.tree("html").alias("t"))
    page = F.col("t")
    base = F.lit("https://site.example/list/page.html?x=1")
    got = {r.i: r for r in rows.select("i", html_pages.list_rows(page, "ul-news").alias("rows"), html_pages.paragraphs(page).alias("body"), html_pages.keyword_links(page, base, ("招标",), ("/t/",), ("login",)).alias("links")).collect()}
    day = datetime.date
    assert [tuple(x) for x in got[1]["rows"]] == [("Firstone", "/a/20260706/x.html", day(2026, 7, 5)), ("deep", "/deep", None), ("By target", "/a/20260101/y.html", day(2026, 1, 1)), ("None", "/z", None)]
    assert got[2].body == "Long enough\nAnotherparagraph" and got[4]["rows"] == got[5]["rows"] == got[4].links == [] and got[4].body == ""
    assert [tuple(x) for x in got[3].links] == [("招标公告第一号", "https://site.example/t/1"), ("Something else", "https://site.example/T/2"), ("招标公告别处的", "http://h/q"), ("招标公告相对的", "https://site.example/list/r")]


def test_trees_leave_in_pieces(spark):
    pages = ["<p>a</p>" * 20_000, None, "", *["<b>c</b>" * 2_000] * 200]
    sizes = [len(frame) for frame in html_pages._trees(iter([pd.Series(pages), pd.Series([], dtype=object)]))]
    assert sum(sizes) == len(pages) and max(sizes) <= html_pages.HELD // 16_000 + 3
    frame = spark.createDataFrame([(k, p) for k, p in enumerate(pages)], "k int, p string").repartition(1)
    got = frame.select("k", F.size(html_pages.tree("p")["nodes"]).alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [20_000, 0, 0, *[2_000] * 200]
