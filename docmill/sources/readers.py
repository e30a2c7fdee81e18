"""Sources: document scans, web archives' index files, XML and HTML extraction, and adapters by name."""

from __future__ import annotations

from collections.abc import Callable
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from docmill.functions import text as T

TITLED = Ty.StructType([Ty.StructField("title", Ty.StringType()), Ty.StructField("text", Ty.StringType())])
CDX_FIELDS = ("urlkey", "timestamp", "url", "mime", "status", "digest", "length", "offset", "filename")


def find(docs: DataFrame, filters: dict | None = None, order: list | None = None, skip: int = 0, limit: int | None = None) -> DataFrame:
    """A filtered page of documents. A filter is a value, a list (one of), or a pair (least, most) with None for open ends; all reach the scan."""
    for name, want in (filters or {}).items():
        c = F.col(name)
        if isinstance(want, list):
            docs = docs.where(c.isin(want))
        elif isinstance(want, tuple):
            lo, hi = want
            docs = docs.where((c >= lo) if lo is not None else F.lit(True)).where((c <= hi) if hi is not None else F.lit(True))
        else:
            docs = docs.where(c == want)
    if order:
        docs = docs.orderBy(*order)
    docs = docs.offset(skip) if skip else docs
    return docs.limit(limit) if limit is not None else docs


def by_keys(docs: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """Rows any of whose columns holds one of the keys (key)."""
    out = None
    for c in columns:
        part = docs.join(keys.select(F.col("key").alias(c)), c, "left_semi")
        out = part if out is None else out.unionByName(part)
    return out.distinct() if len(columns) > 1 else out


def with_extensions(docs: DataFrame, key: str, extensions: dict[str, DataFrame]) -> DataFrame:
    """Documents with an array of structs for each extension table."""
    for name, ext in extensions.items():
        rest = [c for c in ext.columns if c != key]
        docs = docs.join(ext.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(name)), key, "left")
    return docs


def cdx(spark: SparkSession, path: str) -> DataFrame:
    """Index lines ``urlkey timestamp {json}`` as columns; compressed files are read as they are."""
    lines = spark.read.text(path)
    j = F.from_json(F.regexp_extract("value", r"^\S+ \d+ (\{.*\})\s*$", 1), "url string, mime string, status string, digest string, length string, offset string, filename string")
    return lines.where(F.col("value").rlike(r"^\S+ \d+ \{")).select(F.split("value", " ")[0].alias("urlkey"), F.split("value", " ")[1].alias("timestamp"), j.alias("j")).select("urlkey", "timestamp", "j.*").withColumn("domain", T.domain(F.col("url")))


def date_ranges(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """(range_start, range_end) batches that cover [start, end)."""
    s = F.explode(F.sequence(F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1), F.expr(f"INTERVAL {days} DAYS")))
    return spark.range(1).select(s.alias("range_start")).withColumn("range_end", F.least(F.date_add("range_start", days), F.lit(end).cast("date")))


def append_new(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks, one a key."""
    return new.dropDuplicates([key]).join(old.select(key), key, "left_anti")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden, self.title, self.in_title = [], 0, "", False

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript")
        self.in_title |= tag == "title"
        if tag in ("p", "br", "div", "li", "h1", "h2", "h3", "tr"):
            self.out.append("\n")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript") and self.hidden > 0
        self.in_title &= tag != "title"

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.hidden:
            self.out.append(data)


@F.pandas_udf(TITLED)
def html_text(html: pd.Series) -> pd.DataFrame:
    """Title and visible text by a tolerant parser."""
    rows = []
    for h in html:
        p = _Text()
        p.feed(h or "")
        p.close()
        rows.append((p.title.strip(), "\n".join(x for x in (" ".join(line.split()) for line in "".join(p.out).split("\n")) if x)))
    return pd.DataFrame(rows, columns=["title", "text"])


def xml_fields(xml: Column, paths: dict[str, str]) -> list[Column]:
    """One column a path, the first match's text."""
    return [F.element_at(F.xpath(xml, F.lit(p + "/text()")), 1).alias(n) for n, p in paths.items()]


def xml_format(xml: Column) -> Column:
    """The kind of a policy document by its root element."""
    return F.when(xml.rlike(r"<(?:\w+:)?FeatureCollectionIMRO\b"), "imro").when(xml.rlike(r"<(?:\w+:)?AanleveringBesluit\b|<(?:\w+:)?BesluitVersie\b"), "stop").when(xml.rlike(r"<(?:\w+:)?toestand\b|<wetgeving\b"), "law").when(xml.rlike(r"<(?:\w+:)?open-rechtspraak\b|<uitspraak\b"), "court").otherwise("unknown")


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def adapter(name: str):
    """Registers a projection from raw rows to (source, source_id, url, title, text)."""

    def add(f):
        ADAPTERS[name] = f
        return f

    return add


@adapter("web")
def _(raw: DataFrame) -> DataFrame:
    r = raw.withColumn("_t", html_text("html"))
    return r.select(F.lit("Web").alias("source"), F.col("page_id").cast("string").alias("source_id"), T.norm_url(F.col("url")).alias("url"), F.col("_t.title").alias("title"), F.col("_t.text").alias("text"))


@adapter("documents")
def _(raw: DataFrame) -> DataFrame:
    return raw.select("source", F.col("doc_id").cast("string").alias("source_id"), F.lit(None).cast("string").alias("url"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), "text")


def ingest(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources through their adapters, in one table."""
    out = None
    for name, raw in frames.items():
        part = ADAPTERS[name](raw)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def batches(df: DataFrame, size: int):
    """Lists of at most ``size`` rows, fetched partition by partition."""
    held = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
