"""Node tables and selectors against a small walk over a tree; patterns by hand; betweenness in blocks."""

import random

import pytest
from pyspark.sql import functions as F

from docmill import plans
from docmill.operators import dom
from docmill.operators import graph as G
from docmill.plans.patterns import SELECTORS
from tests.conftest import SMALL


class Node:
    def __init__(self, tag, attrs=(), kids=()):
        self.tag, self.attrs, self.kids, self.parent, self.at = tag, dict(attrs), list(kids), None, None
        for k in self.kids:
            k.parent = self

    def html(self):
        own = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{own}>" + "".join(k.html() for k in self.kids) + f"</{self.tag}>"

    def walk(self):
        yield self
        for k in self.kids:
            yield from k.walk()


def grown(rng, depth=0):
    attrs = {k: v for k, v in (("id", rng.choice("xyz")), ("class", rng.choice(["a", "b", "a b"]))) if rng.random() < 0.6}
    kids = [grown(rng, depth + 1) for _ in range(rng.randint(0, 3))] if depth < 4 else []
    return Node(rng.choice(["div", "span", "em"]), attrs, kids)


def fits(n, s):
    own = (n.attrs.get("class") or "").split()
    nth = n.parent.kids.index(n) + 1 if n.parent else 1
    return (s.tag in (None, n.tag)) and (s.id in (None, n.attrs.get("id"))) and all(c in own for c in s.classes) and s.nth in (None, nth)


def found(n, todo):
    """Whether the steps lead to n, tried from its own end."""
    *rest, last = todo
    if not fits(n, last):
        return False
    if not rest:
        return not last.child or n.parent is None
    up, n = last.child, n.parent
    while n:
        if found(n, rest):
            return True
        n = None if up else n.parent
    return False


MANY = ["div", "*", "#x", ".a.b", "div span", "div > span", "div > .a em", "span:nth-child(2)", "div:first-child > em#y", "* > * > .b", "//div", "/div/span", "//div//em[@id='y']", "/*//span[contains(@class, 'a')]", "//*[@class='b']"]


def test_selectors_against_a_walk(spark):
    rng = random.Random(1)
    trees = {i: grown(rng) for i in range(25)}
    rows = [(i, t.html()) for i, t in trees.items()] + [(98, None), (99, "")]
    table = dom.nodes(spark.createDataFrame(rows, "k long, html string"), "k", "html").cache()
    for t in trees.values():
        for at, n in enumerate(t.walk()):
            n.at = at
    got = {(r["k"], r["node"]): r for r in table.collect()}
    assert {(i, n.at) for i, t in trees.items() for n in t.walk()} == set(got)
    for i, t in trees.items():
        for n in t.walk():
            r = got[i, n.at]
            assert (r["parent"], r["end"], r["tag"]) == (n.parent.at if n.parent else -1, n.at + sum(1 for _ in n.walk()) - 1, n.tag)
    hits = dom.select_all(table, "k", dict(zip(MANY, MANY, strict=True))).collect()
    assert len(hits) == len(set((r["selector"], r["k"], r["node"]) for r in hits))
    for m in MANY:
        todo = dom.steps(m)
        assert {(r["k"], r["node"]) for r in hits if r["selector"] == m} == {(i, n.at) for i, t in trees.items() for n in t.walk() if found(n, todo)}, m


def test_loose_markup(spark):
    html = "<html><body><ul><li>one<li>two <b>bold</b> more</ul><p>a<p>b<br>c<div>d</p></div><table><tr><td>1<td>2<tr><td>3</table></em><img src=x/>"
    rows = dom.nodes(spark.createDataFrame([(1, html)], "k int, html string"), "k", "html").orderBy("node").collect()
    assert [(r["depth"], r["tag"], r["text"]) for r in rows] == [(0, "html", ""), (1, "body", ""), (2, "ul", ""), (3, "li", "one"), (3, "li", "two more"), (4, "b", "bold"), (2, "p", "a"), (2, "p", "b c"), (3, "br", ""), (2, "div", "d"), (2, "table", ""), (3, "tr", ""), (4, "td", "1"), (4, "td", "2"), (3, "tr", ""), (4, "td", "3"), (2, "img", "")]


@pytest.mark.parametrize(("text", "position"), [("", 0), ("  ", 0), ("div >", 5), ("> a", 0), ("div!b", 3), ("//", 2), ("/a[2]", 2), ("//a b", 3), ("a::before", 1), ("div..a", 3), ("9a", 0), (":nth-child(0)", 0)])
def test_refused(spark, text, position):
    with pytest.raises(dom.SelectorError) as e:
        dom.steps(text)
    assert e.value.position == position
    r = spark.createDataFrame([(text,)], "s string").select(dom.selector_problems(F.col("s")).alias("p")).first()["p"]
    assert not r["ok"] and r["position"] == position and r["message"]


def test_pages(spark):
    """Every page: what the selectors find is what plain text search finds."""
    hits = plans.QUERIES["pt_select"](spark, SMALL).collect()
    pages = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()}
    count = lambda name: {p: sum(1 for r in hits if r["page_id"] == p and r["selector"] == name) for p in pages}
    assert {r["selector"] for r in hits} == set(SELECTORS)
    assert count("ads") == {p: h.count('<div class="ad">') for p, h in pages.items()}
    assert count("titles") == {p: h.count("<title>") for p, h in pages.items()}
    links = count("links")
    for p, h in pages.items():
        nav = h.split("<nav>")[1].split("</nav>")[0] if "<nav>" in h else ""
        assert links[p] == nav.count("<a ")


def test_ranked_patterns(spark):
    contexts = spark.createDataFrame([(1, "https://a.nl/x/12", "a.nl", "Not found", "aaaa"), (2, "https://b.nl/y", "b.nl", None, "abcd"), (3, None, None, None, None)], "id int, url string, domain string, error string, structure string")
    patterns = spark.createDataFrame([("p", "a.nl", r"https://a.nl/x/\d+", "not found", "aaab", 0.9), ("q", "a.nl", "https://a.nl/x/*/z", "Found it", None, 0.5), ("r", "c.nl", None, None, "abcd", 0.4), ("s", "b.nl", "https://b.nl/z", None, None, 0.1)], "pattern string, domain string, url_pattern string, error string, structure string, confidence double")
    got = {(r["id"], r["pattern"]): (r["url_sim"], r["error_sim"], r["structure_sim"], r["rank"]) for r in dom.rank_patterns(contexts, patterns).collect()}
    assert got == {(1, "p"): (1.0, 0.9, 0.75, 1), (1, "q"): (pytest.approx(2 / 3), pytest.approx(1 / 3), 0.0, 2), (2, "r"): (0.0, 0.0, 1.0, 1)}
    table = dom.nodes(spark.createDataFrame([(1, "<div><p>a</p></div>"), (2, "<div class='x'><p>b</p></div>"), (3, "<div></div>")], "k int, h string"), "k", "h")
    s = {r["k"]: r["structure"] for r in dom.structure(table, "k").collect()}
    assert s[1] == s[2] != s[3]


def test_betweenness_in_blocks(spark):
    rng = random.Random(3)
    edges = spark.createDataFrame({tuple(sorted(rng.sample(range(30), 2))) for _ in range(45)} | {(100, 101)}, "src long, dst long")
    one = {r["id"]: round(r["score"], 9) for r in G.betweenness(edges, G.nodes_of(edges)).collect()}
    assert one == {r["id"]: round(r["score"], 9) for r in G.betweenness(edges, G.nodes_of(edges), at_once=7).collect()} and max(one.values()) > 10
    assert G.betweenness(edges, G.nodes_of(edges).limit(0)).collect() == []


def test_descendants_however_deep(spark):
    """A chain of fourteen, with a circle at its end."""
    chain = spark.createDataFrame([(i + 1, i) for i in range(14)] + [(10, 14)], "child long, parent long")
    got = {r["id"]: r["hops"] for r in G.descendants(chain, spark.createDataFrame([(0,)], "id long")).collect()}
    assert got == {i: i for i in range(15)}
