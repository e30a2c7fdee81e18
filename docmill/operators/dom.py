"""Pages as node tables, selectors as interval joins, and learned patterns ranked for the pages they may fit.

A node has its place in document order and the place of its last descendant, so "inside" is a comparison of numbers and "child" adds the
depth. A selector's steps are joins of a page's nodes on that; each step keeps only the nodes of its tag, id and classes before it joins.

Defined cases: a null or empty page has no nodes; tags that are never closed end with their parent, void elements hold nothing, and a closing tag
that closes nothing is left out; text and comments aren't nodes; a page of any length is walked once, in a stack as deep as it is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Fixed values of the language: elements without content, and those that a new one of the list ends.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]
ENDS = {"li": ["li"], "p": ["p"], "td": ["td", "th"], "th": ["td", "th"], "tr": ["tr", "td", "th"], "option": ["option"], "dt": ["dt", "dd"], "dd": ["dt", "dd"]}
#: Elements that end an open paragraph.
BLOCKS = ["address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "pre", "section", "table", "ul"]
#: What open elements a new one doesn't end beyond.
BARRIERS = ["ul", "ol", "table", "select", "dl", "body", "html", "div", "article", "section", "nav", "td", "th"]

NODE = "node int, end int, parent int, depth int, tag string, id string, classes array<string>, nth int, text string"


class _Walk(HTMLParser):
    """Rows of NODE in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.kids: dict[int, int] = {}

    def _close(self, to: int) -> None:
        for i in self.open[to:]:
            self.rows[i][1] = len(self.rows) - 1
        del self.open[to:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        over = ENDS.get(tag) or (["p"] if tag in BLOCKS else [])
        for k in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[k]][4]
            if name in over:
                self._close(k)
                if tag != "tr" or name == "tr":
                    break
            elif name in BARRIERS:
                break
        at, up = len(self.rows), self.open[-1] if self.open else -1
        self.kids[up] = nth = self.kids.get(up, 0) + 1
        own = dict(attrs)
        self.rows.append([at, at, up, len(self.open), tag, own.get("id"), (own.get("class") or "").split(), nth, ""])
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.rows[self.open[k]][4] == tag:
                self._close(k)
                return

    def handle_data(self, data: str) -> None:
        if self.open and (more := " ".join(data.split())):
            row = self.rows[self.open[-1]]
            row[8] = f"{row[8]} {more}" if row[8] else more

    def done(self) -> list[list]:
        self.close()
        self._close(0)
        return self.rows


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, node, end, parent, depth, tag, id, classes, nth, text) of every element: node counts from 0 in document order, end is that of its last
    descendant, parent is -1 at the top, nth counts siblings from 1, text is the element's own."""
    kind = dict(pages.dtypes)[key]
    columns = [part.split()[0] for part in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32()] * 4 + [pa.string(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                walk = _Walk()
                walk.feed(b.column(1)[i].as_py() or "")
                rows = walk.done()
                if rows:
                    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1).take(pa.array([0] * len(rows))), *cols], [key, *columns])

    return pages.select(key, html).mapInArrow(run, f"`{key}` {kind}, {NODE}")


class SelectorError(ValueError):
    """Not a selector that is understood: ``position`` is where reading stopped."""

    def __init__(self, position: int, message: str):
        super().__init__(f"at {position}: {message}")
        self.position, self.message = position, message


@dataclass(frozen=True)
class Step:
    """One step: whether it must be a child of the one before, and what its element must be."""

    child: bool
    tag: str | None = None
    id: str | None = None
    classes: tuple[str, ...] = ()
    nth: int | None = None


_NAME = re.compile(r"[A-Za-z_][\w-]*")
_CSS = re.compile(r"\*|[A-Za-z][\w-]*")
_CSS_PART = re.compile(r"#(?P<id>[A-Za-z_][\w-]*)|\.(?P<cls>-?[A-Za-z_][\w-]*)|:nth-child\((?P<nth>[1-9]\d*)\)|:(?P<first>first-child)")
_XPATH_PART = re.compile(r"\[@id=(?P<q>['\"])(?P<id>[^'\"\]]*)(?P=q)\]|\[contains\(@class,\s*(?P<c>['\"])(?P<cls>[\w-]+)(?P=c)\)\]|\[@class=(?P<e>['\"])(?P<one>[\w-]+)(?P=e)\]")


def _parts(text: str, at: int, pattern: re.Pattern, step: dict) -> int:
    while m := pattern.match(text, at):
        got = m.groupdict()
        if got.get("id") is not None:
            step["id"] = got["id"]
        elif cls := got.get("cls") or got.get("one"):
            step["classes"] = (*step.get("classes", ()), cls)
        else:
            step["nth"] = int(got.get("nth") or 1)
        at = m.end()
    return at


def steps(selector: str) -> list[Step]:
    """The steps of a CSS selector (tag, #id, .class, :nth-child(n), :first-child, descendants and >) or of an XPath (/ and //, a name or *, @id, @class);
    a SelectorError says where and why anything else is refused."""
    text = selector or ""
    if not text.strip():
        raise SelectorError(0, "empty")
    out, at = [], 0
    if text.lstrip().startswith("/"):
        at = len(text) - len(text.lstrip())
        text = text.rstrip()
        while at < len(text):
            if text[at] != "/":
                raise SelectorError(at, "expected / or //")
            child = not text.startswith("//", at)
            at += 1 if child else 2
            m = _NAME.match(text, at) or (re.compile(r"\*").match(text, at))
            if not m:
                raise SelectorError(at, "expected a name or *")
            step: dict = {"child": child, "tag": None if m.group() == "*" else m.group().lower()}
            at = _parts(text, m.end(), _XPATH_PART, step)
            if at < len(text) and text[at] == "[":
                raise SelectorError(at, "this condition isn't known")
            out.append(Step(**step))
        return out
    text, at = text.rstrip(), len(text) - len(text.lstrip())
    child = False
    while True:
        step, begin = {"child": child}, at
        if m := _CSS.match(text, at):
            step["tag"], at = None if m.group() == "*" else m.group().lower(), m.end()
        at = _parts(text, at, _CSS_PART, step)
        if at == begin:
            raise SelectorError(at, "expected a tag, # or .")
        out.append(Step(**step))
        if at == len(text):
            return out
        m = re.compile(r"\s*>\s*|\s+").match(text, at)
        if not m:
            raise SelectorError(at, f"unexpected {text[at]}")
        child, at = ">" in m.group(), m.end()


def _fits(df: DataFrame, s: Step) -> DataFrame:
    for c, v in (("tag", s.tag), ("id", s.id), ("nth", s.nth)):
        if v is not None:
            df = df.where(F.col(c) == v)
    for v in s.classes:
        df = df.where(F.array_contains("classes", v))
    return df


def select(table: DataFrame, key: str, selector: str) -> DataFrame:
    """The rows of a node table that a selector finds, in its columns."""
    todo = steps(selector)
    here = _fits(table, todo[0])
    if todo[0].child:
        here = here.where("depth = 0")
    for s in todo[1:]:
        up = here.select(F.col(key).alias("_k"), F.col("node").alias("_n"), F.col("end").alias("_e"))
        inside = F.col("parent") == F.col("_n") if s.child else (F.col("node") > F.col("_n")) & (F.col("node") <= F.col("_e"))
        here = _fits(table, s).join(up, (F.col(key) == F.col("_k")) & inside, "left_semi")
    return here


def select_all(table: DataFrame, key: str, selectors: dict[str, str]) -> DataFrame:
    """(selector, and the columns of ``table``) for several named selectors."""
    out = None
    for name, text in selectors.items():
        part = select(table, key, text).select(F.lit(name).alias("selector"), *table.columns)
        out = part if out is None else out.unionByName(part)
    return out


def selector_problems(c: Column) -> Column:
    """struct(ok, position, message): whether a text is a selector, and else where reading it stopped and why."""

    def look(texts: pd.Series) -> pd.DataFrame:
        def one(t: str | None) -> tuple[bool, int, str]:
            try:
                steps(t or "")
            except SelectorError as e:
                return False, e.position, e.message
            return True, -1, ""

        return pd.DataFrame([one(t) for t in texts], columns=["ok", "position", "message"])

    look.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(look, "ok boolean, position int, message string")(c)


def structure(table: DataFrame, key: str, depth: int = 4) -> DataFrame:
    """(key, structure): a digest of the tags of a page's elements down to ``depth``, in document order."""
    tags = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "depth", "tag"))), lambda x: F.concat(x["depth"].cast("string"), F.lit(" "), x["tag"])), ",")
    return table.where(F.col("depth") < depth).groupBy(key).agg(F.sha2(tags, 256).alias("structure"))


def url_similarity(url: Column, pattern: Column) -> Column:
    """1 where the pattern, a regular expression, is found in the URL; else, on one domain, the share of path segments that agree, a segment with * or + with
    any; else 0."""
    domain = lambda c: F.regexp_extract(c, r"https?://([^/?]+)", 1)
    path = lambda c: F.filter(F.split(F.regexp_extract(c, r"https?://[^/]+(/[^?#]*)", 1), "/"), lambda s: s != "")
    mine, theirs = path(url), path(pattern)
    both = F.arrays_zip(mine.alias("a"), theirs.alias("b"))
    same = F.size(F.filter(both, lambda x: (x["a"] == x["b"]) | (x["a"].isNotNull() & (F.contains(x["b"], F.lit("*")) | F.contains(x["b"], F.lit("+"))))))
    longer = F.greatest(F.size(mine), F.size(theirs))
    near = F.when(longer == 0, 1.0).otherwise(same / longer)
    return F.when(pattern.isNull() | url.isNull(), 0.0).when(F.rlike(url, pattern), 1.0).when((domain(url) != "") & (domain(url) == domain(pattern)), near).otherwise(0.0)


def error_similarity(a: Column, b: Column) -> Column:
    """1 where equal, 0.9 but for case, else the Jaccard similarity of words; 0 where one is missing."""
    words = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\w\s]", " "), r"\s+"), lambda w: w != "")
    x, y = words(a), words(b)
    common = F.size(F.filter(x, lambda w: F.array_contains(y, w)))
    jac = F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(common / F.size(F.array_union(x, y)))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == ""), 0.0).when(a == b, 1.0).when(F.lower(a) == F.lower(b), 0.9).otherwise(jac)


def hash_similarity(a: Column, b: Column) -> Column:
    """The share of places at which two digests of one length agree."""
    same = F.size(F.filter(F.sequence(F.lit(1), F.length(a)), lambda i: F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))))
    return F.when(a.isNull() | b.isNull() | (a == "") | (b == "") | (F.length(a) != F.length(b)), 0.0).when(a == b, 1.0).otherwise(same / F.length(a))


def rank_patterns(contexts: DataFrame, patterns: DataFrame, least: float = 0.3, most: int | None = None) -> DataFrame:
    """(id, pattern, url_sim, error_sim, structure_sim, score, confidence, rank) of the patterns that score ``least`` for a page.

    ``contexts`` (id, url, domain, error, structure), ``patterns`` (pattern, domain, url_pattern, error, structure, confidence). The score is 0.5 of the URL's, 0.2 of
    the error's and 0.3 of the structure's similarity; ranks go by score, confidence and pattern. A pattern is tried on the pages of its domain and on those
    that have its structure or its error, so no page meets all patterns.
    """
    c, p = contexts.select("id", "domain", "structure", F.lower("error").alias("error")), patterns.select("pattern", "domain", "structure", F.lower("error").alias("error"))
    met = None
    for k in ("domain", "structure", "error"):
        part = c.where(F.col(k) != "").select("id", k).join(p.where(F.col(k) != "").select("pattern", k), k).select("id", "pattern")
        met = part if met is None else met.unionByName(part)
    both = met.distinct().join(contexts.select("id", "url", F.col("error").alias("_e"), F.col("structure").alias("_s")), "id")
    both = both.join(patterns.select("pattern", "url_pattern", "error", "structure", "confidence"), "pattern")
    sims = both.select("id", "pattern", "confidence", url_similarity(F.col("url"), F.col("url_pattern")).alias("url_sim"), error_similarity(F.col("_e"), F.col("error")).alias("error_sim"), hash_similarity(F.col("_s"), F.col("structure")).alias("structure_sim"))
    scored = sims.withColumn("score", F.round(0.5 * F.col("url_sim") + 0.2 * F.col("error_sim") + 0.3 * F.col("structure_sim"), 9)).where(F.col("score") >= least)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("score"), F.desc("confidence"), "pattern")))
    out = ranked if most is None else ranked.where(F.col("rank") <= most)
    return out.select("id", "pattern", "url_sim", "error_sim", "structure_sim", "score", "confidence", "rank")
