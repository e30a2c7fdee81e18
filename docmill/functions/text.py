"""Scalar column functions over text, URLs, dates and vectors; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dutch stopwords, URL parameters that don't affect content, preferences by document type and source.
STOPWORDS = ["de", "het", "een", "van", "voor", "met", "op", "in", "aan", "bij", "over", "onder", "is", "zijn", "was", "waren", "en", "of", "als"]
TRACKING = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "fbclid", "gclid"]
TYPE_PREFERENCE = {"Omgevingsvisie": 1.0, "Omgevingsplan": 1.0, "Omgevingsprogramma": 0.9, "Verordening": 0.95, "Beleidsregel": 0.9, "Besluit": 0.85, "Nota": 0.8, "Regeling": 0.85, "Circulaire": 0.75, "Richtlijn": 0.8, "Staatsblad": 1.0, "Tractatenblad": 1.0, "Kamerstuk": 0.9, "Hoge Raad": 0.95, "Gerechtshof": 0.85, "Rechtbank": 0.8, "Uitspraak": 0.8, "Handreiking": 0.7, "Leidraad": 0.7}
SOURCE_AUTHORITY = {"DSO": 0.9, "Rechtspraak": 0.9, "Wetgeving": 0.9, "Web": 0.7, "Gemeente": 0.8, "PDOK": 0.8, "IPLO": 0.7}
JURISDICTION_PREFIX = "^(gemeente|provincie|waterschap)\\s+"


def trim(c: Column) -> Column:
    """Trims every white-space character, not blanks alone."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def norm_text(c: Column) -> Column:
    """Text as fingerprints see it: six ordered replacements after trimming."""
    out = trim(c)
    for pattern, to in ((r"\r\n", "\n"), (r"\r", "\n"), (r"[ \t]+", " "), (r"\n\s+", "\n"), (r"\s+\n", "\n"), (r"\n{3,}", "\n\n")):
        out = F.regexp_replace(out, pattern, to)
    return out


def fingerprint(c: Column) -> Column:
    """SHA-256 in hex of the normalized text."""
    return F.sha2(norm_text(c), 256)


def chunk_id(doc: Column, version: Column, index: Column, text: Column) -> Column:
    return F.concat_ws(":", doc.cast("string"), version, index.cast("string"), F.substring(fingerprint(text), 1, 16))


def content_hash(title: Column, summary: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", *(trim(F.coalesce(c, F.lit(""))) for c in (title, summary, url))), 256)


def norm_url(c: Column) -> Column:
    """Comparable URL: lower host and path, no port of its own, tracking parameters dropped, the rest sorted by name, hash kept."""
    t = F.regexp_replace(trim(c), "/$", "")
    scheme = F.lower(F.regexp_extract(t, "^(?i)(https?)://", 1))
    host = F.lower(F.regexp_extract(t, "^(?i)https?://([^/?#:]*)", 1))
    path = F.regexp_replace(F.lower(F.regexp_extract(t, "^(?i)https?://[^/?#]*([^?#]*)", 1)), "/$", "")
    params = F.filter(F.split(F.regexp_extract(t, r"\?([^#]*)", 1), "&"), lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(TRACKING))
    named = F.transform(params, lambda p, i: F.struct(F.substring_index(p, "=", 1).alias("k"), i.alias("i"), F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))).alias("p")))
    search = F.array_join(F.transform(F.array_sort(named), lambda s: s["p"]), "&")
    full = F.concat(scheme, F.lit("://"), host, path, F.when(search != "", F.concat(F.lit("?"), search)).otherwise(""), F.regexp_extract(t, "(#.+)$", 1))
    return F.when(c.isNull() | (c == ""), "").when(F.lower(t).rlike("^https?://"), full).otherwise(F.lower(t))


def norm_url_eval(c: Column) -> Column:
    """URL as evaluation compares it: lower case, no hash, no final slash unless nothing but the origin is left."""
    t = F.regexp_replace(F.lower(trim(c)), "#.*$", "")
    return F.when(t.rlike("^https?://[^/]+/$"), t).otherwise(F.regexp_replace(t, "/$", ""))


def norm_title(c: Column) -> Column:
    t = F.regexp_replace(F.lower(trim(F.coalesce(c, F.lit("")))), r"\s+", " ")
    return trim(F.regexp_replace(t, r"[^\w\s-]", ""))


def stable_id(fp: Column, url: Column, source_id: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(blank(fp), blank(url), source_id)


#: Fixed value: where a document of the planning register is shown.
REGISTER = "https://omgevingswet.overheid.nl/regels-op-de-kaart/documenten/"


def register_id(c: Column) -> Column:
    """A document's identifier in an address of the planning register, or null: after /documenten/ or /document/, an /akn/ path, or
    a segment that looks like one. Identifiers with _ for / are turned back."""
    slashed = lambda x: F.when(x.startswith("_akn_"), F.replace(x, F.lit("_"), F.lit("/"))).otherwise(x)
    plain = lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B")))
    found = lambda p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    segment = plain(found(r"^https?://[^/?#]+(?:/[^?#]*)?/(_akn_[^/?#]*|akn[^/?#]*|NL\.IMRO\.[^/?#]*)"))
    return F.coalesce(slashed(plain(found(r"/documenten/([^/?#]+)"))), plain(found(r"/document/([^/?#]+)")), plain(found(r"^https?://[^/?#]+[^?#]*?(/akn/[^?#]*)")), slashed(F.when(segment.startswith("akn"), F.concat(F.lit("/"), segment)).otherwise(segment)))


def public_url(c: Column, known_id: Column | None = None) -> Column:
    """The public page of an address of the planning register: public addresses as they are, API and old addresses by the identifier
    in them, others (the bare domain too) by ``known_id``, or null."""
    lower = F.lower(c)
    api = lower.contains("/api/") | lower.rlike(r"service\.(?:pre\.)?omgevingswet\.overheid\.nl|/documenten/_(?:zoek|suggereer)|/publiek/")
    old = c.contains("omgevingswet.overheid.nl/document/")
    page = lambda i: F.concat(F.lit(REGISTER), F.replace(i, F.lit("/"), F.lit("_")))
    known = page(known_id) if known_id is not None else F.lit(None).cast("string")
    return F.when(c.contains("omgevingswet.overheid.nl/regels-op-de-kaart/documenten/"), c).when(api | old, F.coalesce(page(register_id(c)), known)).otherwise(known)


def query_terms(c: Column, longer_than: int = 2) -> Column:
    return F.filter(F.split(F.lower(c), r"\s+"), lambda w: F.length(w) > longer_than)


def without_stopwords(words: Column) -> Column:
    """Keeps order and repeats."""
    return F.filter(words, lambda w: ~w.isin(STOPWORDS))


def tokens(c: Column) -> Column:
    """Distinct tokens after lower case, trimming and collapsing."""
    return F.array_distinct(F.filter(F.split(F.lower(trim(c)), r"\s+"), lambda w: w != ""))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Of two token arrays."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_tokens(a: Column, b: Column) -> Column:
    ta, tb = F.lower(trim(a)), F.lower(trim(b))
    return F.when(ta == tb, F.when(ta == "", 0.0).otherwise(1.0)).otherwise(jaccard(tokens(a), tokens(b)))


def jaccard_arr(a: Column, b: Column) -> Column:
    clean = lambda c: tokens(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\w\s]", " "))
    return jaccard(clean(a), clean(b), 1.0)


def levenshtein_sim(a: Column, b: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.lower(trim(c)), r"\s+", " ")
    x, y = clean(a), clean(b)
    return F.when(x == y, 1.0).otherwise(1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(dot(a, b) / norms)


def days(at: Column, as_of: Column) -> Column:
    """Days from ``at`` to ``as_of``, with fractions."""
    return (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(at.cast("timestamp"))) / 86_400_000_000.0


def recency_exp(at: Column, as_of: Column, scale: float = 365.0) -> Column:
    return F.when(at.isNull(), 0.5).otherwise(F.exp(-days(at, as_of) / scale))


def recency_piecewise(at: Column, as_of: Column) -> Column:
    d = days(at, as_of)
    return F.when(at.isNull(), 0.5).when(d < 0, 1.0).when(d <= 365, 1 - 0.5 * d / 365).when(d <= 3650, 0.5 * (1 - (d - 365) / 3285)).otherwise(0.0)


def recency_step(at: Column, as_of: Column) -> Column:
    y = days(at, as_of) / 365
    return F.when(y < 0, 0.0).when(y < 1, 1.0).when(y < 2, 0.7).when(y < 5, 0.4).otherwise(0.1)


def recency_linear(at: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - days(at, as_of) / 365)


def lookup(c: Column, table: dict[str, float], default: float = 0.5) -> Column:
    out = F.when(F.lit(False), 0.0)
    for k, v in table.items():
        out = out.when(c == k, v)
    return out.otherwise(default)


def authority(source: Column, publisher: Column) -> Column:
    p = F.lower(publisher)
    by_name = F.when(p.contains("rijk") | p.contains("national"), 0.9).when(p.contains("provincie") | p.contains("provincial"), 0.85).when(p.contains("gemeente") | p.contains("municipal"), 0.8).otherwise(0.5)
    return F.when(source.isin(list(SOURCE_AUTHORITY)), lookup(source, SOURCE_AUTHORITY)).when(publisher.isNotNull(), by_name).otherwise(0.5)


def snippet(text: Column, term: Column, before: int = 50, width: int = 200) -> Column:
    """A window around the first hit, with ellipses where text was cut; the head of the text if there is no hit."""
    start = F.greatest(F.position(F.lower(term), F.lower(text)) - 1 - before, F.lit(0))
    cut = F.substring(text, start + 1, F.lit(width))
    return F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + width < F.length(text), "...").otherwise(""))


def entropy(probabilities: Column) -> Column:
    """In bits, over probabilities normalized to sum 1."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda s, x: s + x)
    p = F.transform(F.filter(probabilities, lambda x: x > 0), lambda x: x / total)
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - x * F.log2(x))


def normal_cdf(z: Column) -> Column:
    """By the Abramowitz and Stegun approximation 7.1.26 of erf (fixed coefficients)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-x * x)
    return 0.5 * (1 + F.when(z < 0, -erf).otherwise(erf))


def error_norm(c: Column) -> Column:
    return trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\d+", "N"), "['\"]", ""), r"\s+", " "))


#: Category: pattern, in order of priority. Fixed values.
ERROR_CATEGORIES = (("timeout", "timeout|timed out"), ("network", "network|econn|socket|dns"), ("assertion", "assert|expect"), ("database", "mongo|sql|database|query"), ("auth", "unauthori|forbidden|401|403"), ("syntax", "syntax|unexpected token|parse"))


def error_category(c: Column) -> Column:
    out = F.when(F.lit(False), "")
    for name, pattern in ERROR_CATEGORIES:
        out = out.when(F.lower(c).rlike(pattern), name)
    return out.otherwise("unknown")


DUTCH_MONTHS = ["januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december"]


def parse_date(c: Column) -> Column:
    """ISO, day-month-year or Dutch dates; null for none."""
    s = F.lower(trim(c))
    month = F.array_position(F.array(*map(F.lit, DUTCH_MONTHS)), F.regexp_extract(s, r"^\d{1,2} ([a-z]+) \d{4}$", 1))
    dutch = F.when(month > 0, F.concat_ws("-", F.regexp_extract(s, r"(\d{4})$", 1), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(s, r"^(\d{1,2})", 1), 2, "0")))
    return F.coalesce(F.try_to_date(s, "yyyy-MM-dd"), F.try_to_date(s, "d-M-yyyy"), F.try_to_date(s, "d/M/yyyy"), F.try_to_date(dutch, "yyyy-MM-dd"))


def municipality(c: Column) -> Column:
    """A municipality's bare name: lower case, without its kind, hyphens as blanks."""
    s = F.regexp_replace(F.lower(trim(c)), JURISDICTION_PREFIX, "")
    return trim(F.regexp_replace(F.regexp_replace(s, "[-']", " "), r"\s+", " "))


def same_municipality(a: Column, b: Column) -> Column:
    """Whether two names mean one municipality: equal in their letters, or one inside the other with five letters or more."""
    strict = lambda c: F.regexp_replace(municipality(c), "[^a-z]", "")
    x, y = strict(a), strict(b)
    return (x != "") & (y != "") & ((x == y) | ((F.least(F.length(x), F.length(y)) >= 5) & (F.contains(x, y) | F.contains(y, x))))


def best_municipality(name: Column, known: list[str]) -> Column:
    """The known name that means the same, else the nearest by Levenshtein at 0.8 or more of the bare names, else null.

    ``known`` is a list in the plan, as long as the country has municipalities.
    """
    near = F.transform(F.array(*map(F.lit, known)), lambda k: F.struct(F.when(same_municipality(name, k), 2.0).otherwise(levenshtein_sim(municipality(name), municipality(k))).alias("s"), k.alias("k")))
    best = F.array_max(F.filter(near, lambda n: n["s"] >= 0.8))
    return best["k"]


def domain(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, "^(?i)[a-z]+://([^/?#:]+)", 1)), r"^www\.", "")


def url_path(url: Column) -> Column:
    p = F.regexp_extract(url, "^(?i)[a-z]+://[^/?#]+([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def token_estimate(c: Column) -> Column:
    return F.ceil(F.length(c) * 0.25)


def preprocess(c: Column) -> Column:
    """Decimal commas to points, curly quotes to straight, runs of dots and blanks collapsed."""
    s = F.regexp_replace(c, r"(\d),(\d)", "$1.$2")
    s = F.regexp_replace(F.regexp_replace(s, "[“”„]", '"'), "[‘’]", "'")
    return trim(F.regexp_replace(F.regexp_replace(s, r"\.{2,}", "."), r"\s+", " "))


def strip_html(html: Column) -> Column:
    """Visible text by regular expressions: scripts, styles, comments and tags out, five entities decoded, blanks collapsed."""
    s = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1>", " ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?s)<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return trim(F.regexp_replace(s, r"\s+", " "))
