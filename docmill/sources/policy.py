"""Adapters of policy sources: laws, rulings, plans and decisions in XML, municipal pages, office files; each to one common form.

An XML document is parsed once a row; which elements a field may come from is a column expression over what was found.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docmill.functions import text as T
from docmill.sources.readers import adapter, html_text

PARSED = "root string, first map<string,string>, text string"

#: The elements that may hold a field, in order of preference, by format.
FIELDS = {
    "law": {
        "title": ("title", "titel", "citeertitel"),
        "authority": ("publisher", "uitgever", "creator"),
        "published": ("publishedat", "publicatiedatum", "issued", "date"),
        "valid_from": ("validfrom", "geldigvanaf", "geldigheidsdatum"),
        "valid_to": ("validto", "geldigtot", "vervaldatum"),
        "source_id": ("bwbr", "identifier", "akn", "ecli", "cvdr"),
    },
    "court": {"title": ("title",), "authority": ("creator",), "published": ("date", "issued"), "source_id": ("ecli",)},
    "stop": {"title": ("titel", "title", "naam", "name"), "authority": ("bestuursorgaan", "publisher", "uitgever"), "kind": ("documenttype", "type", "soort"), "source_id": ("frbrwork", "identificatie")},
    "imro": {
        "title": ("datasettitel", "titel", "title", "naam"),
        "authority": ("naamoverheid", "overheid", "bronbeheerder", "publisher"),
        "published": ("creatiedatum", "createdat"),
        "kind": ("typeplan", "type"),
        "source_id": ("identificatie", "id"),
    },
}
#: Elements whose text is a document's content, by format; all text where a document has none of them.
CONTENT = {"law": ("al", "tekst", "inhoud"), "court": ("para", "p", "bridgehead"), "stop": ("al", "inhoud"), "imro": ("plantekst", "regeltekst", "toelichting", "tekst", "beschrijving")}
#: Names that, with the domain nl, stand for a municipality beyond doubt.
MUNICIPALITIES = ("amsterdam", "rotterdam", "denhaag", "den-haag", "utrecht", "eindhoven", "groningen", "tilburg", "almere", "breda", "nijmegen", "enschede", "haarlem", "arnhem", "zaanstad", "amersfoort", "apeldoorn", "s-hertogenbosch", "hoofddorp")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2].rpartition(":")[2].lower()


def xml_parsed(xml: Column, content: tuple[str, ...]) -> Column:
    """struct(root, first, text): the root's name, the first text of each element name (lower case, no prefix), and the text of
    the ``content`` elements, a line each. What isn't well-formed gives nulls; undeclared prefixes are dropped first."""

    @F.pandas_udf(PARSED)
    def run(docs: pd.Series) -> pd.DataFrame:
        rows = []
        for x in docs:
            try:
                root = ElementTree.fromstring(re.sub(r"(</?)\w+:", r"\1", re.sub(r"\s(?:xmlns(?::\w+)?|\w+:\w+)=(\"[^\"]*\"|'[^']*')", "", x or "")))
            except ElementTree.ParseError:
                rows.append((None, None, None))
                continue
            first, lines = {}, []
            for e in root.iter():
                name, own = _local(e.tag), " ".join((e.text or "").split())
                if own:
                    first.setdefault(name, own)
                if name in content:
                    lines.append(" ".join("".join(e.itertext()).split()))
            lines = [t for t in lines if t] or [" ".join("".join(root.itertext()).split())]
            rows.append((_local(root.tag), first, "\n".join(lines)))
        return pd.DataFrame(rows, columns=["root", "first", "text"])

    return run(xml)


def xml_documents(raw: DataFrame, kind: str) -> DataFrame:
    """(source, source_id, url, title, text, authority, published, valid_from, valid_to, kind) of rows (xml, url) in one format."""
    x = raw.withColumn("_x", xml_parsed(F.col("xml"), CONTENT[kind])).where("_x.root IS NOT NULL")

    def field(name: str) -> Column:
        names = FIELDS[kind].get(name, ())
        return F.coalesce(*(F.col("_x.first")[n] for n in names)) if names else F.lit(None).cast("string")

    # a ruling's kind is the element that holds it
    ruling = F.when(F.map_contains_key("_x.first", "conclusie") | F.col("xml").rlike(r"<(?:\w+:)?conclusie\b"), "conclusie").otherwise("uitspraak")
    return x.select(
        F.lit(kind).alias("source"),
        field("source_id").alias("source_id"),
        F.col("url"),
        field("title").alias("title"),
        F.col("_x.text").alias("text"),
        *(field(n).alias(n) for n in ("authority", "published", "valid_from", "valid_to")),
        (ruling if kind == "court" else field("kind")).alias("kind"),
    )


for _kind in FIELDS:

    @adapter(_kind)
    def _(raw: DataFrame, kind=_kind) -> DataFrame:
        return xml_documents(raw, kind)


def format_of(identifier: Column) -> Column:
    """struct(format, type): the format in which a document of the planning register comes, by its identifier."""
    imro, akn = identifier.startswith("NL.IMRO."), identifier.startswith("/akn/")
    return F.struct(F.when(imro, "TAMIMRO").otherwise("STOPTPOD").alias("format"), F.when(imro, "IMRO").when(akn, "AKN").otherwise("OTHER").alias("type"))


def bundles(files: DataFrame) -> DataFrame:
    """(path, entry, xml) of each XML or GML entry in zip files (path, content); a file that is no zip gives no rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                if content is not None and zipfile.is_zipfile(io.BytesIO(content)):
                    z = zipfile.ZipFile(io.BytesIO(content))
                    names = sorted(n for n in z.namelist() if n.lower().endswith((".xml", ".gml")))
                    yield pd.DataFrame({"path": path, "entry": names, "xml": [z.read(n).decode("utf-8", "replace") for n in names]})

    return files.select("path", "content").mapInPandas(run, "path string, entry string, xml string")


@adapter("register")
def _(raw: DataFrame) -> DataFrame:
    """Bundles of the planning register (path, content): each entry by the format of its root element."""
    entries = bundles(raw).select(F.concat_ws("#", "path", "entry").alias("url"), "xml")
    gml = F.col("xml").rlike("FeatureCollectionIMRO|xmlns:imro|IMRO200[68]")
    return xml_documents(entries.where(gml), "imro").unionByName(xml_documents(entries.where(~gml), "stop"))


def authority_of(url: Column, given: Column) -> Column:
    """struct(authority, confidence, method): the body given beside a page, else inferred from its domain."""
    given = F.btrim(given)
    domain = F.regexp_replace(T.domain(url), r"^www\.", "")
    own, name = F.regexp_extract(domain, r"^gemeente-([^.]+)\.", 1), F.regexp_extract(domain, r"^([^.]+)\.nl$", 1)
    called = lambda c: F.concat(F.lit("Gemeente "), F.initcap(F.replace(c, F.lit("-"), F.lit(" "))))
    made = lambda a, c, m: F.struct(a.alias("authority"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
    unknown = F.lit("Onbekende gemeente")
    return (
        F.when((given != "") & (given != unknown), made(given, "high", "metadata"))
        .when(own != "", made(called(own), "high", "domain"))
        .when(name.isin(*MUNICIPALITIES), made(called(name), "high", "domain"))
        .when(name != "", made(called(name), "medium", "domain"))
        .otherwise(made(unknown, "low", "heuristic"))
    )


@adapter("municipal")
def _(raw: DataFrame) -> DataFrame:
    """Municipal policy pages (url, html): the id is a page's path with its query."""
    r = raw.withColumn("_t", html_text("html")).withColumn("_a", authority_of(F.col("url"), F.lit(None).cast("string")))
    at = F.regexp_replace(F.regexp_replace("url", r"^[a-zA-Z]+://[^/]*", ""), r"#.*$", "")
    return r.select(F.lit("municipal").alias("source"), F.when(at != "", at).otherwise(F.col("url")).alias("source_id"), "url", F.col("_t.title").alias("title"), F.col("_t.text").alias("text"), F.col("_a.authority").alias("authority"))


SCRAPERS: list[tuple[str, Callable[[DataFrame], DataFrame]]] = []


def scraper(pattern: str):
    """Registers a scraper, a function of pages (url, html) to (url, title, text), for URLs that match; the first match scrapes."""

    def add(f):
        SCRAPERS.append((pattern, f))
        return f

    return add


def scrape(urls: DataFrame, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(url, scraper, title, text): ``fetch`` turns (url) into (url, html), and each page goes to the first scraper that takes it."""
    pages, taken, out = fetch(urls.select("url").distinct()), F.lit(False), None
    for pattern, f in SCRAPERS:
        mine = F.col("url").rlike(pattern)
        part = f(pages.where(mine & ~taken)).select("url", F.lit(pattern).alias("scraper"), "title", "text")
        out, taken = part if out is None else out.unionByName(part), taken | mine
    return out


@scraper(".")
def _(pages: DataFrame) -> DataFrame:
    return pages.withColumn("_t", html_text("html")).select("url", F.col("_t.title").alias("title"), F.col("_t.text").alias("text"))


@F.pandas_udf(StringType())
def docx_text(content: pd.Series) -> pd.Series:
    """The paragraphs of a word-processor file (a zip with word/document.xml), a line each; null for other files."""

    def one(raw):
        try:
            root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(raw)).read("word/document.xml"))
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, TypeError):
            return None
        return "\n".join("".join(t.text or "" for t in p.iter() if _local(t.tag) == "t") for p in root.iter() if _local(p.tag) == "p")

    return content.map(one)


_SHOWN = re.compile(rb"\(((?:[^()\\]|\\.)*)\)\s*(?:Tj|')|\[((?:[^\]\\]|\\.)*)\]\s*TJ", re.DOTALL)
_PART = re.compile(rb"\(((?:[^()\\]|\\.)*)\)", re.DOTALL)


@F.pandas_udf(StringType())
def pdf_text(content: pd.Series) -> pd.Series:
    """The strings that a PDF's content streams show, one a line; plain or deflated streams with one-byte fonts, no scans."""

    def plain(s: bytes) -> str:
        s = re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m[1], 8) & 255]), s)
        return re.sub(rb"\\(.)", rb"\1", s, flags=re.DOTALL).decode("cp1252", "replace")

    def one(raw):
        if raw is None or raw[:5] != b"%PDF-":
            return None
        lines = []
        for m in re.finditer(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", raw, re.DOTALL):
            try:
                body = zlib.decompress(m[2]) if b"FlateDecode" in m[1] else m[2]
            except zlib.error:
                continue
            lines += [plain(a) if a or not b else "".join(plain(p) for p in _PART.findall(b)) for a, b in _SHOWN.findall(body)]
        return "\n".join(lines)

    return content.map(one)
