"""Sinks: upserts, files in several formats, RDF and graph exchange, content-addressed artifacts."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RENDER_ROWS = 100_000


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str, on_insert: list[str] = ()) -> DataFrame:
    """The table after ``new`` replaced rows of its keys; of several new rows the last by ``order`` counts; ``on_insert`` columns
    keep their old values."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    last = new.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    if on_insert:
        held = old.select(*keys, *(F.col(c).alias(f"_{c}") for c in on_insert))
        last = last.join(held, keys, "left")
        for c in on_insert:
            last = last.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*old.columns))


def upsert_vectors(old: DataFrame, new: DataFrame, dims: int) -> DataFrame:
    """Vectors by (chunk_id, model_id), the latest by updated_at; vectors of another length are refused."""
    bad = new.where((F.size("embedding") != dims) | F.col("embedding").isNull()).limit(1).count()
    if bad:
        raise ValueError(f"vectors must have {dims} components")
    return upsert(old, new, ["chunk_id", "model_id"], "updated_at")


def bulk_update(df: DataFrame, key: str, ids: list, column: str, value) -> DataFrame:
    return df.withColumn(column, F.when(F.col(key).isin(ids), F.lit(value)).otherwise(F.col(column)))


def _flat(df: DataFrame) -> DataFrame:
    return df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))


def write(df: DataFrame, path: str, kind: str) -> None:
    """csv, tsv, json (lines), xml or parquet, written by the executors."""
    w = df.write.mode("overwrite")
    if kind in ("csv", "tsv"):
        _flat(df).write.mode("overwrite").option("header", True).option("sep", "\t" if kind == "tsv" else ",").option("quoteAll", kind == "csv").csv(path)
    elif kind == "xml":
        w.option("rowTag", "row").option("rootTag", "rows").format("xml").save(path)
    elif kind == "json":
        w.json(path)
    elif kind == "parquet":
        w.parquet(path)
    else:
        raise ValueError(kind)


def render(df: DataFrame, kind: str, title: str = "Export", most: int = RENDER_ROWS) -> str:
    """A whole document as text for results of at most ``most`` rows: json, yaml, md, html or rtf; larger results are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write them as files")
    cols, data = df.columns, [r.asDict(recursive=True) for r in rows]
    cell = lambda v: "" if v is None else str(v)
    if kind == "json":
        return json.dumps(data, default=str, ensure_ascii=False, indent=2)
    if kind == "yaml":
        return "".join("- " + "\n  ".join(f"{c}: {json.dumps(r[c], default=str, ensure_ascii=False)}" for c in cols) + "\n" for r in data)
    if kind == "md":
        line = lambda vs: "| " + " | ".join(v.replace("|", "\\|").replace("\n", " ") for v in vs) + " |\n"
        return f"# {title}\n\n" + line(cols) + line(["---"] * len(cols)) + "".join(line([cell(r[c]) for c in cols]) for r in data)
    if kind == "html":
        row = lambda t, vs: "<tr>" + "".join(f"<{t}>{_html.escape(v)}</{t}>" for v in vs) + "</tr>"
        return f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><table>{row('th', cols)}{''.join(row('td', [cell(r[c]) for c in cols]) for r in data)}</table>"
    if kind == "rtf":
        esc = lambda v: "".join(c if ord(c) < 128 else f"\\u{ord(c) if ord(c) < 32768 else ord(c) - 65536}?" for c in v.replace("\\", "\\\\").replace("{", "\\{").replace("}", "\\}"))
        return "{\\rtf1 " + "".join("\\tab ".join(esc(cell(r[c])) for c in cols) + "\\par\n" for r in data) + "}"
    raise ValueError(kind)


def json_array(df: DataFrame):
    """Pieces of one JSON array, row by row, without holding the whole."""
    yield "["
    for i, r in enumerate(df.select(F.to_json(F.struct(*df.columns)).alias("j")).toLocalIterator()):
        yield ("," if i else "") + r["j"]
    yield "]"


def triples(df: DataFrame, graph: str | None = None) -> DataFrame:
    """(value) lines of N-Triples, or N-Quads with a graph, from (s, p, o, literal)."""
    esc = F.replace(F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    o = F.when(F.col("literal"), F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(F.concat(F.lit("<"), F.col("o"), F.lit(">")))
    return df.select(F.concat(F.lit("<"), F.col("s"), F.lit("> <"), F.col("p"), F.lit("> "), o, F.lit(f" <{graph}> ." if graph else " .")).alias("value"))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(value) lines of GraphML, in order of part, for ``write.text`` of one file or concatenation."""
    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), F.col("id").cast("string"), F.lit('"/>')).alias("value"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), F.col("src").cast("string"), F.lit('" target="'), F.col("dst").cast("string"), F.lit('"/>')).alias("value"))
    ends = nodes.sparkSession.createDataFrame([(0, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">'), (3, "</graph></graphml>")], "part int, value string")
    return ends.unionByName(n).unionByName(e).orderBy("part", "value").select("value")


def artifacts(df: DataFrame, path: str, content: str) -> None:
    """Content-addressed: one row a distinct content, laid out by the first two digits of its SHA-256."""
    d = df.withColumn("sha256", F.sha2(F.col(content), 256)).dropDuplicates(["sha256"]).withColumn("prefix", F.substring("sha256", 1, 2))
    d.write.mode("append").partitionBy("prefix").parquet(path)


def retained(df: DataFrame, at: str, as_of: str, days: int) -> DataFrame:
    return df.where(F.col(at) >= F.date_sub(F.lit(as_of).cast("date"), days))


_ESCAPES = {"html": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")), "md": (("|", "\\|"), ("\n", " ")), "rtf": (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\line "))}


def lines(df: DataFrame, kind: str, title: str = "Export") -> DataFrame:
    """(part, value): the text of an export in yaml, md, html or rtf, a line a row (part 1) between its head (0) and foot (2).

    Lines are column expressions, so a result of any size is rendered where its rows are.
    """
    names = df.columns

    def cell(c: str):
        out = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
        for a, b in _ESCAPES.get(kind, ()):
            out = F.replace(out, F.lit(a), F.lit(b))
        if kind == "rtf":  # characters beyond ASCII as signed 16-bit units
            code = lambda x: F.when(F.ascii(x) < 128, x).otherwise(F.concat(F.lit("\\u"), F.when(F.ascii(x) < 32768, F.ascii(x)).otherwise(F.ascii(x) - 65536).cast("string"), F.lit("?")))
            out = F.when(out.rlike(r"^[\x00-\x7F]*$"), out).otherwise(F.array_join(F.transform(F.split(out, ""), code), ""))
        return out

    joined = lambda before, sep, after: F.concat(F.lit(before), F.concat_ws(sep, *map(cell, names)), F.lit(after))
    head, foot = {
        "yaml": ("", ""),
        "md": (f"# {title}\n\n| {' | '.join(names)} |\n| {' | '.join('---' for _ in names)} |", ""),
        "html": (f"<!doctype html><meta charset=utf-8><title>{_html.escape(title)}</title><table><tr>{''.join(f'<th>{_html.escape(n)}</th>' for n in names)}</tr>", "</table>"),
        "rtf": ("{\\rtf1 ", "}"),
    }[kind]
    value = {"yaml": lambda: F.concat(F.lit("- "), F.to_json(F.struct(*names))), "md": lambda: joined("| ", " | ", " |"), "html": lambda: joined("<tr><td>", "</td><td>", "</td></tr>"), "rtf": lambda: joined("", "\\tab ", "\\par")}[kind]()
    ends = df.sparkSession.createDataFrame([(0, head), (2, foot)], "part int, value string").where("value <> ''")
    return ends.unionByName(df.select(F.lit(1).alias("part"), value.alias("value")))


def _sheet(rows: list[list]) -> bytes:
    """A workbook with one sheet: numbers as numbers, the rest as inline text."""
    import io
    import zipfile

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"<c><v>{v!r}</v></c>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{_html.escape(str(v), quote=False)}</t></is></c>'

    ns = "http://schemas.openxmlformats.org/"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{ns}package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="r1" Type="{ns}officeDocument/2006/relationships/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{ns}spreadsheetml/2006/main" xmlns:r="{ns}officeDocument/2006/relationships"><sheets><sheet name="Export" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{ns}package/2006/relationships"><Relationship Id="r1" Type="{ns}officeDocument/2006/relationships/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}spreadsheetml/2006/main"><sheetData>{"".join("<row>" + "".join(map(cell, r)) + "</row>" for r in rows)}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def _page_set(rows: list[list], per: int = 50) -> bytes:
    """A PDF of text lines, ``per`` a page."""
    esc = lambda s: s.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")
    text = [esc("\t".join("" if v is None else str(v) for v in r).replace("\n", " ")) for r in rows]
    pages = [text[i : i + per] for i in range(0, len(text), per)] or [[]]
    kids = " ".join(f"{4 + 2 * i} 0 R" for i in range(len(pages)))
    objects = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>".encode(), b"<</Type/Font/Subtype/Type1/BaseFont/Helvetica/Encoding/WinAnsiEncoding>>"]
    for i, page in enumerate(pages):
        body = b"BT /F1 9 Tf 14 TL 40 800 Td " + b"".join(b"(" + t + b") Tj T* " for t in page) + b"ET"
        objects.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 595 842]/Resources<</Font<</F1 3 0 R>>>>/Contents {5 + 2 * i} 0 R>>".encode())
        objects.append(b"<</Length %d>>\nstream\n%s\nendstream" % (len(body), body))
    out, at = b"%PDF-1.4\n", []
    for i, o in enumerate(objects):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, o)
    table = b"".join(b"%010d 00000 n \n" % x for x in at)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer<</Size %d/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % (len(at) + 1, table, len(at) + 1, len(out))


_OFFICE = {"xlsx": _sheet, "pdf": _page_set}


def office_files(df: DataFrame, kind: str, rows: int = 10_000) -> DataFrame:
    """(part, seq, content): files of at most ``rows`` rows each in xlsx (with a row of names) or pdf, made where the rows are."""
    import datetime

    import pandas as pd
    from pyspark import TaskContext

    names, make = df.columns, _OFFICE[kind]

    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v != v:
            return None
        return v if isinstance(v, (int, float, str)) else v.isoformat() if isinstance(v, (datetime.date, pd.Timestamp)) else str(v)

    def run(frames):
        part, seq, held = TaskContext.get().partitionId(), 0, []
        for f in frames:
            held += [[plain(v) for v in r] for r in f.itertuples(index=False, name=None)]
            while len(held) >= rows:
                yield pd.DataFrame({"part": [part], "seq": [seq], "content": [make([names] * (kind == "xlsx") + held[:rows])]})
                seq, held = seq + 1, held[rows:]
        if held:
            yield pd.DataFrame({"part": [part], "seq": [seq], "content": [make([names] * (kind == "xlsx") + held)]})

    return df.mapInPandas(run, "part int, seq int, content binary")


def sheet_rows(files: DataFrame, columns: str) -> DataFrame:
    """The rows of workbooks (content) made by ``office_files``, as ``columns`` (a schema of names and types)."""
    import io
    import zipfile
    from xml.etree import ElementTree

    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType.fromDDL(columns)

    def run(frames):
        for f in frames:
            for content in f["content"]:
                root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("xl/worksheets/sheet1.xml"))
                rows = [["".join(c.itertext()) if len(c) else None for c in r] for r in root.iter() if r.tag.endswith("}row")][1:]
                yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    text = files.select("content").mapInPandas(run, ", ".join(f"`{n}` string" for n in schema.names))
    return text.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema.fields))


def run_outputs(results: dict[str, DataFrame], folder: str, kinds: tuple[str, ...] = ("csv", "json")) -> dict[tuple[str, str], str]:
    """Writes each named result of a workflow in each format below ``folder``: path by (name, kind)."""
    paths = {(name, kind): f"{folder}/{name}.{kind}" for name in results for kind in kinds}
    for (name, kind), path in paths.items():
        df = results[name]
        if kind in _ESCAPES or kind == "yaml":
            lines(df, kind, name).orderBy("part").select("value").write.mode("overwrite").text(path)
        elif kind in _OFFICE:
            office_files(df, kind).write.mode("overwrite").parquet(path)
        else:
            write(df, path, kind)
    return paths
