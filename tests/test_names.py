"""Name matching and periods against brute force, and the guards of queries that users send."""

import random

import pytest

from docmill.operators import entities as E
from docmill.operators import guard
from docmill.sources import policy


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85])
def test_similar_names_loses_none(spark, least):
    rng = random.Random(3)
    names = {(rng.randint(0, 1), "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))) for _ in range(150)}
    want = {(k, x, y) for k, x in names for m, y in names if k == m and x < y and 1 - distance(x, y) / max(len(x), len(y)) >= least}
    got = E.similar_names(spark.createDataFrame(list(names), "block int, name string"), "block", least).collect()
    assert {(r["block"], r["x"], r["y"]) for r in got} == want and len(got) == len(want)


def test_overlapping_periods(spark):
    rng = random.Random(4)
    day = lambda d: f"2020-01-01 00:00:{d % 60:02d}"
    rows = []
    for i in range(200):
        s = rng.randint(0, 50)
        rows.append((i, rng.randint(0, 3), day(s), day(min(59, s + rng.choice([0, 1, 3, 9])))))
    df = spark.createDataFrame(rows, "k long, g int, s string, e string").selectExpr("k", "g", "cast(s as timestamp) s", "cast(e as timestamp) e")
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    got = [(r["a"], r["b"]) for r in E.overlapping_periods(df, "k", "g", "s", "e").collect()]
    assert sorted(got) == sorted(want)


def test_matches_of_a_large_group(spark):
    """A thousand entities of one name make a thousand matches, not a million."""
    rows = [(i, "t", "Same  Name", None, None, None) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, type string, name string, uri string, jurisdiction string, date int")
    got = E.find_matches(df, df).where("how = 'name'").collect()
    assert len(got) == 1000 and all(r["b"] == (0 if r["a"] else 1) for r in got)


@pytest.mark.parametrize("text", ["SELECT reflect('java.lang.System', 'exit', 0)", "SELECT java_method('a', 'b')", "SELECT * FROM parquet.`/etc`", "SELECT * FROM csv . x", "SELECT input_file_name() FROM five", "DROP TABLE x"])
def test_refused_queries(spark, text):
    with pytest.raises(ValueError):
        guard.read_only_sql(spark, text)


def test_broken_files(spark):
    df = spark.createDataFrame([(b"no zip",), (b"",), (None,), (b"%PDF-1.4 nothing",)], "content binary")
    assert [r[0] for r in df.select(policy.docx_text("content")).collect()] == [None] * 4
    assert [r[0] for r in df.select(policy.pdf_text("content")).collect()] == [None, None, None, ""]
    assert policy.bundles(df.selectExpr("'p' path", "content")).count() == 0
    raw = spark.createDataFrame([("<a><b></a>", "u"), (None, "u"), ("", "u")], "xml string, url string")
    assert policy.xml_documents(raw, "law").count() == 0
