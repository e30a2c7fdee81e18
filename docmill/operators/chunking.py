"""Chunking and metadata extraction. Structure-aware chunkers run in Arrow batches; fixed windows stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docmill.functions import text as T

LOW, HIGH, OVERLAP = 1600, 4800, 200
MARKDOWN = r"(?m)^(?P<marks>#{1,6})\s+(?P<title>.+)$"
#: Headings by strategy, as groups of patterns: of the groups the first that finds any counts, with all its patterns. Fixed values.
HEADINGS: dict[str, tuple[tuple[str, ...], ...]] = {
    "default": (
        (MARKDOWN,),
        (r"(?mi)^(?P<word>Hoofdstuk|Artikel|Paragraaf|Afdeling)\s+(?P<number>[0-9]+[a-z]?)[.:]\s*(?P<title>.+)$",),
    ),
    "stop": ((r"(?mi)^(?:Hoofdstuk|Afdeling|Paragraaf|Artikel)\s+(?P<number>[0-9]+(?:\.[0-9]+)*)[.:]?\s*(?P<title>.+)?$",),),
    "legal": (
        (
            r"(?mi)^(?P<title>Overwegingen|Beslissing|Conclusie|Feiten|Recht|Geschiedenis|Procedures|Beoordeling)[.:]?\s*(?:.+)?$",
            r"(?mi)^(?P<word>Artikel|Lid|Onderdeel|Paragraaf)\s+(?P<number>[0-9]+[a-z]?)[.:]?\s*(?P<title>.+)?$",
        ),
    ),
    "policy": (
        (MARKDOWN,),
        (r"(?mi)(?:^|\s)(?P<word>Hoofdstuk|Paragraaf|Artikel|Deel)\s+(?P<number>[0-9]+(?:\.[0-9]+)*)[:\s]+(?P<title>[^\n\r]{0,80}?)(?=\s+(?:Hoofdstuk|Paragraaf|Artikel|Deel)\s+[0-9]|[\n\r]{2,}|$)",),
        (r"(?m)^(?P<number>[0-9]+(?:\.[0-9]+)*)\s+(?P<title>.+)$",),
    ),
}
#: Levels of heading words, 1 for others. Fixed values.
LEVELS = {"hoofdstuk": 1, "deel": 1, "artikel": 1, "afdeling": 1, "lid": 2, "paragraaf": 2, "onderdeel": 3}
TITLE = 50


def _short(title: str) -> str:
    """A title that ran into its text: up to where a sentence starts, or to the last whole word within ``TITLE``."""
    m = re.search(r"(?<=\S)\s+(?=[A-Z][a-z]{2,}\s)", title)
    if m and m.start() < len(title) - 5:
        title = title[: m.start()]
    return title if len(title) <= TITLE else title[: TITLE + 1].rsplit(None, 1)[0][:TITLE]


def headings(text: str, groups: str | tuple[tuple[str, ...], ...]) -> list[tuple[int, int, str]]:
    """(start, level, title) of a text's headings in order. A heading's level is the length of its marks, the depth of its dotted number
    (``1.2.3``: 3), or that of its word; a title is led by its word and number, where the pattern names them."""
    for group in ((groups,),) if isinstance(groups, str) else groups:
        found = []
        for m in (m for p in group for m in re.finditer(p, text)):
            part = {k: v for k, v in m.groupdict().items() if v is not None}
            word, number, title = part.get("word"), part.get("number", ""), part.get("title", "" if part else m[0]).strip()
            if word:
                level = LEVELS.get(word.lower(), 1)
                title = f"{word} {number}" + (f": {_short(title)}" if title else "")
            elif number:
                level, title = number.count(".") + 1, title or number
            else:
                level = len(part.get("marks", "#"))
            found.append((m.start("word") if word else m.start(), level, title))
        if found:
            return sorted(found, key=lambda h: h[0])
    return []


def outline(found: list[tuple[int, int, str]]) -> list[tuple[int, tuple[str, ...]]]:
    """(start, path) of headings: a path holds the titles above a heading, and its own."""
    out, path = [], []
    for start, level, title in found:
        while path and path[-1][0] >= level:
            path.pop()
        path.append((level, title))
        out.append((start, tuple(t for _, t in path)))
    return out


def sections(text: str, groups: str | tuple[tuple[str, ...], ...], low: int = LOW, high: int = HIGH, overlap: int = OVERLAP) -> list[tuple[int, int, str, str]]:
    """(start, end, heading, path) in code points: sections between headings, else paragraphs packed up to ``high``; longer
    pieces are cut; short ones join the next; each is then widened by ``overlap`` on both sides. ``heading`` is the
    line of a piece's first heading and ``path`` the titles down to it, joined by `` > ``; text before the first heading has none."""
    cuts = outline(headings(text, groups))
    spans: list[tuple[int, int, str, str]] = []
    if cuts:
        starts = [0, *(a for a, _ in cuts)]
        for a, b, path in zip(starts, [*starts[1:], len(text)], [(), *(p for _, p in cuts)], strict=True):
            if b > a:
                spans.append((a, b, text[a:b].split("\n", 1)[0][:80] if path else "", " > ".join(path)))
    else:
        at = 0
        for m in re.finditer(r"\n\n+|\Z", text):
            if m.end() > at:
                spans.append((at, m.end(), "", ""))
            at = m.end()
    packed: list[list] = []
    for a, b, *named in spans:
        if packed and packed[-1][1] - packed[-1][0] < low and b - packed[-1][0] <= high:
            packed[-1][1] = b
        else:
            packed.append([a, b, *named])
    out = []
    for a, b, *named in packed:
        for s in range(a, b, high):
            out.append((max(0, s - overlap), min(len(text), min(s + high, b) + overlap), *named))
    return out


def segments(text: str, groups: str | tuple[tuple[str, ...], ...], low: int = LOW, high: int = HIGH, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, heading) of ``sections``."""
    return [s[:3] for s in sections(text, groups, low, high, overlap)]


_strategies: dict[str, str | tuple | Callable] = dict(HEADINGS)


def register(name: str, strategy: str | tuple[tuple[str, ...], ...] | Callable[[str], list[tuple[int, int, str]]]) -> None:
    """Adds a chunker: a heading pattern, groups of them, or a function of a text."""
    _strategies[name] = strategy


def chunk(docs: DataFrame, key: str, text: str, strategy: Column | str = "default", version: str = "v1") -> DataFrame:
    """(key, chunk_index, start, end, heading, path, text, chunk_id, fingerprint); ``strategy`` may differ by row."""
    table = dict(_strategies)

    @F.pandas_udf("array<struct<start:int,end:int,heading:string,path:string>>")
    def split(texts: pd.Series, names: pd.Series) -> pd.Series:
        def one(x, n):
            s = table.get(n, table["default"])
            return [] if not x else [{"start": a, "end": b, "heading": h, "path": h if callable(s) else p[0]} for a, b, h, *p in (s(x) if callable(s) else sections(x, s))]

        return pd.Series([one(x, n) for x, n in zip(texts, names, strict=True)])

    name = F.lit(strategy) if isinstance(strategy, str) else strategy
    c = docs.select(key, text, F.posexplode(split(F.col(text), name)).alias("chunk_index", "_s"))
    c = c.select(key, "chunk_index", F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), F.col("_s.heading").alias("heading"), F.col("_s.path").alias("path"), F.expr(f"substring({text}, _s.start + 1, _s.end - _s.start)").alias("chunk"))
    return c.withColumn("fingerprint", T.fingerprint(F.col("chunk"))).withColumn("chunk_id", F.concat_ws(":", F.col(key).cast("string"), F.lit(version), F.col("chunk_index").cast("string"), F.substring("fingerprint", 1, 16)))


def dispatch(family: Column, kind: Column) -> Column:
    """The strategy's name for a document's family and type."""
    return F.when(family == "Omgevingsinstrument", "stop").when(family == "Juridisch", "legal").when(kind.isin("Nota", "Beleidsregel") | (family == "Beleid"), "policy").otherwise("default")


def windows(docs: DataFrame, key: str, text: str, tokens: int = 500, overlap: int = 50) -> DataFrame:
    """(key, chunk_index, chunk): fixed windows of ``tokens`` estimated tokens (four characters each)."""
    size, step = 4 * tokens, 4 * (tokens - overlap)
    n = F.greatest(F.lit(1), F.ceil((F.length(text) - 4 * overlap) / step)).cast("int")
    c = docs.where(F.length(text) > 0).select(key, text, F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return c.select(key, "chunk_index", F.expr(f"substring({text}, chunk_index * {step} + 1, {size})").alias("chunk"))


#: Kind: pattern. Fixed values.
CITATIONS = {"article": r"(?i)\bartikel(?:en)?\s+\d+[\w:.]*", "act": r"\b[A-Z]\w*(?:wet|besluit|regeling)\b", "ordinance": r"(?i)\bverordening\s+\w+", "id": r"\b(?:ECLI:[A-Z:0-9]+|BWBR\d{7})\b", "url": r"https?://[^\s<>\"')]+"}


def citations(docs: DataFrame, key: str, text: str, patterns: dict[str, str] = CITATIONS) -> DataFrame:
    """(key, kind, citation, n)."""
    found = F.flatten(F.array(*(F.transform(F.regexp_extract_all(text, F.lit(p), 0), lambda x, k=k: F.struct(F.lit(k).alias("kind"), x.alias("citation"))) for k, p in patterns.items())))
    return docs.select(key, F.explode(found).alias("c")).groupBy(key, "c.kind", "c.citation").agg(F.count("*").alias("n"))


def extract(docs: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """(key, found): distinct matches."""
    return docs.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 0))).alias("found"))


def classify(text: Column, keywords: dict[str, list[str]]) -> Column:
    """Labels whose keywords occur, in order."""
    labels = [F.when(F.lower(text).rlike("|".join(rf"\b\Q{w}\E" for w in ws)), F.lit(k)) for k, ws in keywords.items()]
    return F.filter(F.array(*labels), lambda x: x.isNotNull())


def terms(docs: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(term, f, docs, score) of words seen ``least`` times: 0.6 min(1, f / 10) + 0.4 share of documents."""
    n = docs.agg(F.count("*").alias("n"))
    w = docs.select(key, F.explode(F.filter(F.split(F.lower(text), r"\s+"), lambda x: F.length(x) > 3)).alias("term"))
    g = w.groupBy("term", key).agg(F.count("*").alias("c")).groupBy("term").agg(F.sum("c").alias("f"), F.count("*").alias("docs")).where(F.col("f") >= least)
    return g.join(F.broadcast(n), F.lit(True)).select("term", "f", "docs", (0.6 * F.least(F.lit(1.0), F.col("f") / 10) + 0.4 * F.col("docs") / F.col("n")).alias("score"))


def split_compounds(words: Column, known: dict[str, str]) -> Column:
    """Known compounds as their parts."""
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w))
