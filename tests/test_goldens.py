"""Hand-computed cases and invariants."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docmill.functions import text as T
from docmill.operators import analytics as A
from docmill.operators import chunking, dedup, entities, evaluate, guard, retrieval, spatial
from docmill.operators import graph as G
from docmill.sources import readers, sinks
from tests.conftest import SMALL


def value(spark, column, **cells):
    row = spark.createDataFrame([tuple(cells.values()) or (0,)], list(cells) or ["_"])
    return row.select(column.alias("v")).first()["v"]


def test_text(spark):
    assert value(spark, T.norm_text(F.col("t")), t=" a\r\n\r\n\tb  c ") == "a\nb c"
    assert value(spark, T.jaccard_tokens(F.col("a"), F.col("b")), a="a b c", b="b c d") == 0.5
    assert value(spark, T.levenshtein_sim(F.col("a"), F.col("b")), a="kitten", b="sitting") == pytest.approx(1 - 3 / 7)
    assert value(spark, T.norm_url(F.col("u")), u="HTTPS://Ex.org/A/b/?utm_source=x&z=1&a=2#H") == "https://ex.org/a/b?a=2&z=1#H"
    assert value(spark, T.norm_url(F.col("u")), u="Not a URL/") == "not a url"
    assert str(value(spark, T.parse_date(F.col("d")), d="3 maart 2021")) == "2021-03-03"
    assert value(spark, T.recency_exp(F.lit(None).cast("timestamp"), F.lit("2024-01-01"))) == 0.5
    assert value(spark, T.strip_html(F.col("h")), h="<p>a&amp;b</p><script>x</script>c") == "a&b c"


def test_fusion(spark):
    kw = spark.createDataFrame([("u1", 1.0), ("u2", 0.0)], "d string, score double")
    sem = spark.createDataFrame([("u1", 1.0)], "d string, score double")
    got = {r["d"]: r["score"] for r in retrieval.fuse_weighted(kw, sem, "d").collect()}
    assert got == {"u1": pytest.approx(1.0), "u2": 0.0}
    kw = spark.createDataFrame([("u1", 2.0), ("u2", 1.0)], "d string, score double")
    got = {r["d"]: r["score"] for r in retrieval.fuse_rrf(kw, sem.withColumn("d", F.lit("u2")), "d").collect()}
    assert got == {"u1": pytest.approx(1 / 61), "u2": pytest.approx((1 / 62 + 1 / 61) * 1.1)}


def test_scores(spark):
    for scores, want in (([3.0, 3.0], [1, 1]), ([0.0, 0.0], [0, 0])):
        d = spark.createDataFrame([(s,) for s in scores], "s double")
        assert [r["norm"] for r in A.min_max(d, None, "s").collect()] == want
    c = spark.createDataFrame([(1, 0, 0, 0, 0)], "item long, clicks long, accepts long, rejects long, total long")
    r = spark.createDataFrame([], "item long, rating double")
    assert A.doc_quality(c, r, "item").first()["quality"] == pytest.approx(0.1)
    d = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", 10.0)], "k string, v double")
    assert A.percentiles(d, "k", "v").first()["p95"] == pytest.approx(9.2)


def test_ndcg(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, doc string, rank int")
    rel = spark.createDataFrame([("q", "a", 0), ("q", "b", 3), ("q", "c", 3)], "query string, doc string, relevance int")
    m = evaluate.metrics(run, rel, 2).first()
    assert m["ndcg"] == pytest.approx((3 / math.log2(3)) / 3) and m["precision"] == 1.0 and m["recall"] == 1.0
    assert evaluate.metrics(run, rel, 2, "all").first()["recall"] == pytest.approx(2 / 3)


def test_sequential_dedup(spark):
    for rows, want in (([(1, "i1", "u1"), (2, "i1", "u2"), (3, "i3", "u2")], [1, 3]), ([(1, "i1", "u1"), (2, "i2", "u1"), (3, "i2", "u3")], [1, 3])):
        d = spark.createDataFrame(rows, "seq long, a string, b string")
        assert sorted(r["seq"] for r in dedup.simple(d, "seq", "a", "b").collect()) == want
    rng = random.Random(3)
    rows = [(i, rng.choice([None, *"abcd"]), rng.choice("wxyz") + str(rng.randint(0, 3))) for i in range(40)]
    kept, seen = [], set()
    for i, a, b in rows:
        keys = {x for x in (("a", a), ("b", b)) if x[1] is not None}
        if not keys & seen:
            kept.append(i)
            seen |= keys
    d = spark.createDataFrame(rows, "seq long, a string, b string")
    assert sorted(r["seq"] for r in dedup.simple(d, "seq", "a", "b").collect()) == kept
    edges = [(i, j) for i in range(12) for j in range(i + 1, 12) if rng.random() < 0.2]
    want = []
    for i in range(12):
        if not any((k, i) in edges for k in want):
            want.append(i)
    e = spark.createDataFrame(edges, "a long, b long")
    assert sorted(r["id"] for r in dedup.greedy_mis(spark.range(12), e).collect()) == want


def test_graph(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "src long, dst long")
    assert {r["id"]: r["component"] for r in G.components(e).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}
    assert {r["id"]: r["component"] for r in G.strong_components(e).collect()} == {1: 3, 2: 3, 3: 3, 4: 4, 5: 5}
    assert sum(r["rank"] for r in G.pagerank(e).collect()) == pytest.approx(1.0)
    assert sorted((r["src"], r["dst"], round(r["confidence"], 2)) for r in G.transitive(e).collect()) == [(1, 3, 0.72), (2, 1, 0.72), (3, 2, 0.72)]
    star = spark.createDataFrame([(0, i) for i in range(1, 5)], "src long, dst long")
    got = {r["id"]: r["score"] for r in G.betweenness(star, G.nodes_of(star)).collect()}
    assert got[0] == 12
    two = spark.createDataFrame([(a + o, b + o) for o in (0, 10) for a in range(4) for b in range(a)] + [(0, 10)], "src long, dst long")
    c = {r["id"]: r["community"] for r in G.louvain(two).collect()}
    assert len({c[i] for i in range(4)}) == 1 and len({c[i + 10] for i in range(4)}) == 1 and c[0] != c[10]
    w = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 4, 1.0)], "src long, dst long, w double")
    assert sorted((r["src"], r["dst"]) for r in G.steiner(w, [1, 3, 4], "w").collect()) == [(1, 2), (2, 3), (3, 4)]


def test_hungarian():
    rng = np.random.default_rng(1)
    from itertools import permutations

    for n, m in ((3, 3), (2, 4), (4, 3)):
        w = rng.integers(1, 20, (n, m)).astype(float)
        got = sum(w[i, j] for i, j in entities.hungarian(w))
        big = w if n <= m else w.T
        assert got == max(sum(big[i, p[i]] for i in range(big.shape[0])) for p in permutations(range(big.shape[1]), big.shape[0]))


def test_spatial(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3), (0, 0))))
    assert value(spark, spatial.ring_area(ring)) == 12
    assert value(spark, spatial.in_ring(F.lit(1.0), F.lit(1.0), ring)) is True
    assert value(spark, spatial.in_ring(F.lit(5.0), F.lit(1.0), ring)) is False
    lat, lon = spatial.rd_to_wgs84(F.lit(155000.0), F.lit(463000.0))
    assert value(spark, lat) == pytest.approx(52.1551744) and value(spark, lon) == pytest.approx(5.38720621)


def test_guard(spark):
    spark.range(5).createOrReplaceTempView("five")
    assert guard.read_only_sql(spark, "SELECT * FROM five").count() == 5
    for bad in ("DROP TABLE five", "SELECT 1; SELECT 2", "WITH x AS (SELECT 1) INSERT INTO five SELECT * FROM x"):
        with pytest.raises(ValueError):
            guard.read_only_sql(spark, bad)
    with pytest.raises(ValueError):
        guard.condition("java_method('x')", ["a"])


def test_chunks():
    text = "# A\n" + "x" * 2000 + "\n# B\n" + "y" * 6000
    parts = chunking.segments(text, chunking.HEADINGS["default"])
    assert parts[0][2] == "# A" and parts[-1][1] == len(text)
    assert all(b - a <= chunking.HIGH + 2 * chunking.OVERLAP for a, b, _ in parts)
    assert chunking.segments("", chunking.HEADINGS["default"]) == []


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a|"b'), (2, None)], "id long, t string")
    for kind in ("csv", "tsv", "json", "parquet"):
        sinks.write(d, f"{tmp_path}/{kind}", kind)
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").count() == 2
    assert sinks.render(d, "md").count("\n") == 6 and "<td>2</td>" in sinks.render(d, "html")
    assert "".join(sinks.json_array(d)) == '[{"id":1,"t":"a|\\"b"},{"id":2}]'
    with pytest.raises(ValueError):
        sinks.render(d, "json", most=1)


def test_cdx(spark, tmp_path):
    (tmp_path / "x.cdx").write_text('nl,a)/ 20240101 {"url": "http://www.a.nl/x", "mime": "text/html", "status": "200"}\nbad line\n')
    r = readers.cdx(spark, str(tmp_path)).collect()
    assert [(x["urlkey"], x["domain"], x["status"]) for x in r] == [("nl,a)/", "a.nl", "200")]


def test_html(spark):
    p = spark.createDataFrame([("<title>T</title><p>a &lt; b</p><script>no</script>",)], "h string")
    r = p.select(readers.html_text("h").alias("x")).first()["x"]
    assert (r["title"], r["text"]) == ("T", "a < b")


def test_stream_equals_batch(spark, tmp_path):
    from docmill.streaming import events as S

    stream = S.tumbling(S.read(spark, SMALL))
    S.drain(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    batch = S.tumbling(spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r["start"], r["event_type"]): r["n"] for r in batch.collect()}
    last = max(k[0] for k in want)
    assert got and all(want[k] == n for k, n in got.items())
    assert all(k in got for k in want if (last - k[0]).total_seconds() > 7200)  # windows that the watermark has passed


def test_stateful_rates(spark, tmp_path):
    from docmill.streaming import events as S

    rows = []
    q = S.rates(S.read(spark, SMALL)).writeStream.outputMode("update").foreachBatch(lambda b, _: rows.extend(b.collect())).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = {r["user_id"]: (r["n"], r["e"]) for r in spark.read.parquet(f"{SMALL}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), F.avg((F.col("event_type") == "error").cast("int")).alias("e")).collect()}
    assert {r["user_id"]: r["seen"] for r in rows} == {k: v[0] for k, v in batch.items()}
    assert all(r["error_rate"] == pytest.approx(batch[r["user_id"]][1]) for r in rows)


def test_headings_of_each_strategy():
    from docmill.operators import chunking as C

    found = lambda text, name: C.headings(text, C.HEADINGS[name])
    md = "intro\n# Visie\ntekst\n### Wonen \n## Water\nArtikel 1. x"
    assert found(md, "default") == found(md, "policy") == [(6, 1, "Visie"), (20, 3, "Wonen"), (31, 2, "Water")]
    assert [p for _, p in C.outline(found(md, "default"))] == [("Visie",), ("Visie", "Wonen"), ("Visie", "Water")]
    assert found("Artikel 1 zonder punt\nHOOFDSTUK 2: Regels\nartikel 3a. Begrippen", "default") == [(22, 1, "HOOFDSTUK 2: Regels"), (42, 1, "artikel 3a: Begrippen")]
    stop = "Hoofdstuk 1 Algemeen\nafdeling 1.2: Regels\nArtikel 1.2.3\n\nTitel 4 Overig\nx Artikel 5"
    assert found(stop, "stop") == [(0, 1, "Algemeen"), (21, 2, "Regels"), (42, 3, "Titel 4 Overig")]  # without a title, the next line is taken for one
    assert found("Artikel 7", "stop") == [(0, 1, "7")]
    legal = "FEITEN\nA kocht.\n\nBeoordeling: het hof\nProcesverloop\nArtikel 3a: Termijn\nLid 2\nonderdeel 4. Slot\nGeschiedenis."
    assert found(legal, "legal") == [(0, 1, "FEITEN"), (17, 1, "Beoordeling"), (52, 1, "Artikel 3a: Termijn"), (72, 2, "Lid 2: onderdeel 4. Slot"), (96, 1, "Geschiedenis")]
    run = "Voorwoord Hoofdstuk 1: Inleiding Dit is de eerste zin van het stuk. Paragraaf 1.1 Doel\n\ntekst\nDeel 2: Bijlagen"
    assert found(run, "policy") == [(10, 1, "Hoofdstuk 1: Inleiding"), (68, 2, "Paragraaf 1.1: Doel"), (94, 1, "Deel 2: Bijlagen")]
    assert found("1 Doel\n1.1 Kader\n1.1.1 Wet\n2 Slot\n3. niet", "policy") == [(0, 1, "Doel"), (7, 2, "Kader"), (17, 3, "Wet"), (27, 1, "Slot")]
    assert [p for _, p in C.outline(found("1 Doel\n1.1 Kader\n2 Slot", "policy"))] == [("Doel",), ("Doel", "Kader"), ("Slot",)]
    assert all(found("gewone tekst zonder kop", n) == [] for n in C.HEADINGS)


def test_sections_carry_their_path():
    from docmill.operators import chunking as C

    text = "voor" + " w" * 900 + "\n# A\n" + "x " * 900 + "\n## B\n" + "y " * 3000
    parts = C.sections(text, C.HEADINGS["policy"], overlap=0)
    assert [p for *_, p in parts] == ["", "A", "A > B", "A > B"] and [h for *_, h, _ in parts] == ["", "# A", "## B", "## B"]
    assert "".join(text[a:b] for a, b, *_ in parts) == text
