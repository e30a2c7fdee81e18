"""WARC archives: written with revisit records for repeated payloads, read back by boundary-chain verification.

Writing: records are text, so Spark's text sink writes them whole (a record's last line end is the sink's), file by file, on any
store. Of equal payloads of at least ``least`` bytes, the row with the smallest page_id is the response and others revisit it;
the smallest ids are found by a grouping that counts before it shuffles, and only repeated payloads are joined back.

Reading: the record mark may also stand inside a payload, so marks prove nothing. Tasks list every candidate as (offset, successor
offset by its Content-Length); then pointer jumping from each file's start doubles its stride until all reachable candidates
are marked. Only these are records. A file's candidates are two numbers each, so a file's chain fits one task by far. A chain must
reach the end of its file: where a broken header or length ends it early, reading fails and names the file and the offset, or, if
asked, ``report`` lists what wasn't reached. Files compressed by gzip, record by record or whole, are read as well.

Defined cases: null html is an empty payload; a null url leaves the target out, line ends in it are escaped; a null page_id is
written as ``null`` and read back as null, and never is the smallest unless all are; rows that share payload and smallest page_id
are all responses; an empty table writes no record; other columns play no part; a header line that begins with white space
continues the line before it. Bytes that no chain reaches are no records.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm import common

LEAST = 100
FILE_BYTES = 32 << 20
#: Fixed values of the format.
MARK = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ID = "urn:docmill:page:"


def records(pages: DataFrame, least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value, size): each row's record as text without its last line end."""
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A").alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256)).withColumn("bytes", F.octet_length("html").cast("long"))
    long = p.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("c"))
    heads = common.written(long.where("c > 1").select("digest", "first"), "warc-heads")
    j = p.join(heads.withColumnRenamed("digest", "_d"), (F.col("digest") == F.col("_d")) & (F.col("bytes") >= least), "left")
    again = F.col("_d").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(again, "").otherwise(F.col("html")))
    name = lambda c: F.concat(F.lit(f"<{_ID}"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">\r\n"))
    value = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        F.when(again, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        name("page_id"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.col("url"), F.lit("\r\n")), F.lit("")),
        F.lit(f"WARC-Date: {date}\r\nWARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.lit("\r\n"),
        F.when(again, F.concat(F.lit(f"WARC-Profile: {REVISIT}\r\nWARC-Refers-To: "), name("first"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("_block"),
        F.lit("\r\n\r\n"),
        F.col("_block"),
        F.lit("\r\n"),
    )
    return j.withColumn("_block", block).select(value.alias("value"))


def write(pages: DataFrame, path: str, least: int = LEAST, file_bytes: int = FILE_BYTES) -> None:
    """Writes the records of ``pages`` (page_id, url, html) as archives of about ``file_bytes`` at ``path``."""
    mean = pages.agg(F.avg(F.coalesce(F.octet_length("html"), F.lit(0)) + 512).alias("m")).first()["m"] or 512
    records(pages, least).write.option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, int(file_bytes / mean))).text(path)


def _header(content: bytes, at: int) -> tuple[dict[bytes, bytes], int] | None:
    """(fields in lower case, offset of the block) of a candidate at ``at``, or None if it has no header."""
    end = content.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    fields = {}
    for line in re.sub(rb"\r\n[ \t]+", b" ", content[at:end]).split(b"\r\n")[1:]:
        k, sep, v = line.partition(b":")
        if not sep:
            return None
        fields.setdefault(k.strip().lower(), v.strip())
    return (fields, end + 4) if fields.get(b"content-length", b"").isdigit() else None


def candidates(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, successors) of every record mark whose header and length are sound; a successor may be the content's end."""
    at, to = [], []
    for m in MARK.finditer(content):
        h = _header(content, m.start())
        if h is None:
            continue
        end = h[1] + int(h[0][b"content-length"])
        if content[end : end + 4] == b"\r\n\r\n":
            at.append(m.start())
            to.append(end + 4)
    return np.array(at, np.int64), np.array(to, np.int64)


def reachable(at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The offsets that the chain from offset 0 reaches, by pointer jumping: each round doubles what a pointer skips."""
    n = len(at)
    order = np.argsort(at)
    at, to = at[order], to[order]
    nxt = np.searchsorted(at, to)
    jump = np.append(np.where((nxt < n) & (at[np.minimum(nxt, n - 1)] == to), nxt, n) if n else np.zeros(0, np.int64), n)
    seen = np.zeros(n + 1, bool)
    seen[0] = n > 0 and at[0] == 0
    while not (jump == n).all():
        seen[jump[np.flatnonzero(seen)]] = True  # before the jump doubles: all within the stride are marked
        jump = jump[jump]
    return at[seen[:n]]


def _plain(content: bytes) -> bytes:
    """The file's bytes, members of a gzip file one after the other."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content) + member.flush())
        content = member.unused_data.lstrip(b"\0")
    return b"".join(out)


def _parse(content: bytes, at: int) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of the record at ``at``."""
    fields, block = _header(content, at)
    end = block + int(fields[b"content-length"])
    kind, body = fields.get(b"warc-type", b"").decode(), block
    length = None
    if fields.get(b"content-type", b"").startswith(b"application/http"):
        head = content.find(b"\r\n\r\n", block, end)
        body = end if head < 0 else head + 4
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", content[block : max(head, block)])
        length = int(m[1]) if m else None
    number = lambda v: int(v) if (v := v.decode("utf-8", "replace").strip("<>").rpartition(":")[2]).lstrip("-").isdigit() else None
    if kind == "revisit":
        digest = fields.get(b"warc-payload-digest", b"").decode().removeprefix("sha256:")
    else:
        digest, length = hashlib.sha256(content[body:end]).hexdigest(), end - body
    url = fields.get(b"warc-target-uri")
    return (number(fields.get(b"warc-record-id", b"")), length, digest, kind, number(fields[b"warc-refers-to"]) if b"warc-refers-to" in fields else None, url.decode("utf-8", "replace") if url is not None else None)


def _chains(files: DataFrame) -> DataFrame:
    """(_path, chain, reached, bytes) of each file (path, content): its records' offsets, where their chain ends, and its length."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1), strict=True):
                raw = _plain(content.as_py())
                at, to = candidates(raw)
                at, to = np.append(at, -1), np.append(to, len(raw))  # one row more, which holds the file's length
                yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(at), pa.string()), pa.array(at), pa.array(to)], ["path", "at", "to"])

    def chain(f: pd.DataFrame) -> pd.DataFrame:
        mark = (f["at"] < 0).to_numpy()
        at, to = f["at"].to_numpy()[~mark], f["to"].to_numpy()[~mark]
        found = reachable(at, to)
        packed = zlib.compress(np.diff(found, prepend=0).astype("<i8").tobytes())
        reached = int(to[at == found[-1]][0]) if len(found) else 0
        return pd.DataFrame({"_path": [f["path"].iloc[0]], "chain": [packed], "reached": [reached], "bytes": [int(f["to"].to_numpy()[mark][0])]})

    edges = files.mapInArrow(scan, "path string, at long, to long")
    return edges.groupBy("path").applyInPandas(chain, "_path string, chain binary, reached long, bytes long")


def _files(spark: SparkSession, path: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content")


def report(spark: SparkSession, path: str) -> DataFrame:
    """(path, records_end, bytes) of each archive whose chain of records ends before the file does."""
    return _chains(_files(spark, path)).where("reached < bytes").select(F.col("_path").alias("path"), F.col("reached").alias("records_end"), "bytes")


def read(spark: SparkSession, path: str, broken: str = "raise") -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record of the archives at ``path``.

    ``broken``: "raise" fails at a file whose chain ends early, naming it and the offset; "keep" gives its records up to there
    (``report`` lists such files).
    """
    files = _files(spark, path)
    chains = common.written(_chains(files), "warc-chains")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content, packed in zip(b.column(0), b.column(1), strict=True):
                raw = _plain(content.as_py())
                at = np.cumsum(np.frombuffer(zlib.decompress(packed.as_py()), "<i8"))
                rows = [_parse(raw, a) for a in at.tolist()]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
    if broken == "raise":
        why = F.concat(F.lit("no WARC record in "), F.col("_path"), F.lit(" at offset "), F.col("reached"), F.lit(" of "), F.col("bytes"))
        chains = chains.withColumn("chain", F.when(F.col("reached") < F.col("bytes"), F.raise_error(why).cast("binary")).otherwise(F.col("chain")))
    both = files.join(chains, F.col("path") == F.col("_path")).select("content", "chain")
    return both.mapInArrow(parse, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
