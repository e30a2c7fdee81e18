"""Packing, conversation repair and spelling variants: brute force, invariants, SQL and the defined edge cases."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from heapq import heappop, heappush

import duckdb
import numpy as np
import pytest

from docmill.llm import common, conversations, packing, queries, variants
from tests.conftest import SMALL
from tests.llm.test_operators import buffers, edge_rows

P = pytest.importorskip("public_tokenizers")
WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def edge(spark):
    from tests.llm.test_operators import SCHEMA

    return spark.createDataFrame(edge_rows(), SCHEMA).cache()


def sql_rows(name, table):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    return con.sql(queries.ORACLE_SQL[name])


# 11
def tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path(WORDS))
    t.encode_special_tokens = True
    return t


def check_packing(rows, docs, capacity=packing.CAPACITY):
    """Pieces are the documents' ids, and sequences are gapless and not too long; returns their number."""
    t, of = tokenizer(), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
    want = Counter()
    for d, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            cut = np.array(ids[k : k + capacity], "<u4")
            want[d, k // capacity, k, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in bins.values():
        upto = 0
        for offset, length in sorted(x):
            assert offset == upto
            upto += length
        assert upto <= capacity
    return len(bins)


def test_packing(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = queries.op11_grouping_packing(spark, SMALL).collect()
    n = check_packing(rows, docs.select("doc_id", "text").collect())
    assert n <= packing.bound(np.array([r["length"] for r in rows]), packing.CAPACITY) + 1


def test_packing_in_levels(spark):
    """Small blocks, so that bins are opened and dealt again; never worse than best fit decreasing in one block's ways, and near the bound."""
    rng = random.Random(5)
    sizes = [rng.choice([rng.randint(1, 100), rng.randint(200, 700)]) for _ in range(3000)]
    items = spark.createDataFrame([(k, s, "own") for k, s in enumerate(sizes)], "k long, length int, `sequence_id` string")
    one = packing.pack(items, 1000, block=128)
    rows = one.collect()
    assert one.columns == ["k", "length", "sequence_id", "offset"] and sorted(r["k"] for r in rows) == list(range(3000))
    load = Counter()
    for r in rows:
        load[r["sequence_id"]] += r["length"]
    assert max(load.values()) <= 1000 and len(load) <= packing.bound(np.array(sizes), 1000) * 1.01 + 1
    again = packing.pack(items, 1000, block=128).collect()
    assert {frozenset(x) for x in groups(rows)} == {frozenset(x) for x in groups(again)}


def groups(rows):
    out = defaultdict(set)
    for r in rows:
        out[r["sequence_id"]].add(r["k"])
    return out.values()


def test_bound_and_genes():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = rng.integers(1, 11, 7)
        best = least_bins(sizes.tolist(), 10)
        assert packing.bound(sizes, 10) <= best
        got = packing.evolve(sizes, [], 10, 60, int(rng.integers(1 << 30)))[0]
        loads = np.bincount(got, sizes)
        assert loads.max() <= 10 and (loads > 0).all() and len(loads) == best
    assert packing.bound(np.array([6, 6, 6, 5]), 10) == 4 and packing.bound(np.zeros(0, int), 10) == 0


def least_bins(sizes, capacity):
    best = len(sizes)

    def go(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(sizes):
            best = len(loads)
            return
        for b in range(len(loads)):
            if loads[b] + sizes[i] <= capacity:
                go(i + 1, [*loads[:b], loads[b] + sizes[i], *loads[b + 1 :]])
        go(i + 1, [*loads, sizes[i]])

    go(0, [])
    return best


def test_crossover_injects_whole_bins():
    rng = np.random.default_rng(2)
    sizes = rng.integers(50, 900, 200)
    a, b = (packing.evolve(sizes, [], 1000, 0, s, size=3)[-1] for s in (1, 2))
    loads_b = np.bincount(b, sizes)
    child, loads = packing.crossover(a, b, loads_b, sizes, sizes.tolist(), 1000, rng)
    assert loads.max() <= 1000 and loads.sum() == sizes.sum() and (np.bincount(child, sizes) == loads).all()
    ours = {frozenset(np.flatnonzero(child == k).tolist()) for k in range(len(loads))}
    given = [k for k in range(len(loads_b)) if frozenset(np.flatnonzero(b == k).tolist()) <= max(ours, key=lambda s: len(s & set(np.flatnonzero(b == k).tolist())))]
    assert len(given) >= max(1, int(0.1 * len(loads_b)))


def test_evolution_improves():
    """Triplets that fill bins exactly: best fit alone needs more, and the islands' packings never get worse."""
    rng = np.random.default_rng(3)
    a = rng.integers(260, 480, 60)
    b = np.array([rng.integers(200, 980 - x - 199) for x in a])
    sizes = rng.permutation(np.concatenate([a, b, 1000 - a - b]))
    first = packing.evolve(sizes, [], 1000, 0, 4)
    later = packing.evolve(sizes, first, 1000, 400, 4)
    n = lambda x: int(x.max()) + 1
    square = lambda x: float((np.bincount(x, sizes) ** 2).sum())
    assert n(first[0]) > 60 and (n(later[0]) < n(first[0]) or square(later[0]) > square(first[0])) and n(later[0]) <= n(first[0])


def test_packing_edges(spark, edge):
    docs = edge.unionByName(edge.limit(1).selectExpr("77L doc_id", "repeat('naïve İstanbul’s café ﬁ é <|endoftext|> 12 ½ ', 900) text", *(f"`{c}`" for c in edge.columns[2:])))
    got = packing.pack(packing.pieces(docs, P.path(WORDS))).collect()
    check_packing(got, docs.select("doc_id", "text").collect())
    ids = packing.pack(packing.pieces(docs, P.path(WORDS), with_ids=True))
    filled = {r["sequence_id"]: r["ids"] for r in packing.sequences(ids).collect()}
    own = tokenizer().encode("other text", add_special_tokens=False).ids + [0]
    assert any(np.array(own, "<u4").tobytes() in x for x in filled.values()) and max(map(len, filled.values())) <= 4 * 2048
    empty = packing.pack(packing.pieces(docs.limit(0), P.path(WORDS)))
    assert empty.collect() == [] and empty.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    for bad in (0, 3000, None):
        with pytest.raises(Exception, match="length outside"):
            packing.pack(spark.createDataFrame([(bad,)], "length int")).collect()


# 12
WHITE = re.compile(r"[^\x20\x09-\x0D]")
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NAME = {"u": "user", "a": "assistant"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        last = WHITE.findall(text)[-1:]
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, digest) by search over all edits in order of cost and audit."""
    bad = faults(rows)
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, audit, i, state, out = heappop(heap)
        if (i, state) in done:
            continue
        if i == len(rows) and state in (0, 3):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        done.add((i, state))
        for terminal in "ua":
            if (state, terminal) in NEXT:
                heappush(heap, (cost + 5, audit + "I", i, NEXT[state, terminal], (*out, NAME[terminal] + ":")))
        if i < len(rows):
            role, text = rows[i]
            heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
            if bad[i] not in ("blank", "duplicate"):
                more = 5 * (bad[i] == "truncated")
                if (state, role[:1]) in NEXT:
                    heappush(heap, (cost + more, audit + "K", i + 1, NEXT[state, role[:1]], (*out, f"{role}:{text}")))
                for terminal in "ua":
                    if (state, terminal) in NEXT and role[:1] != terminal:
                        heappush(heap, (cost + 1 + more, audit + "R", i + 1, NEXT[state, terminal], (*out, f"{NAME[terminal]}:{text}")))


def talk(rng, n):
    return [(rng.choice(["user", "assistant", "system", "tool", "user", "assistant", ""]), rng.choice(["a.", "b!", "c", " ", "", "d?\n", "e.", "f.", "g.", "h"])) for _ in range(n)]


def letters(rows):
    return "".join(chr(65 + 4 * ("sua".find(r[:1]) if r[:1] and r[:1] in "sua" else 3) + conversations.FAULTS.index(f)) for (r, _), f in zip(rows, faults(rows), strict=True))


def test_parse_is_cheapest():
    rng = random.Random(3)
    for _ in range(1500):
        rows = talk(rng, rng.randint(0, 9))
        assert conversations.parse(letters(rows)) == cheapest(rows)[:2]


def test_blocks_agree_with_the_whole():
    """Tables of pieces, chained in any grouping, give the audit of the whole."""
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice("ABDEEEHIIILMP") for _ in range(rng.randint(1, 14)))
        cuts = sorted(rng.sample(range(1, len(text)), min(len(text) - 1, rng.randint(0, 4))))
        parts = [text[i:j] for i, j in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        tables = [conversations.table(p) for p in parts]
        k = rng.randint(1, len(tables))
        whole, after = conversations.chain(tables)
        if k < len(tables):
            assert conversations.chain([conversations.chain(tables[:k])[0], conversations.chain(tables[k:])[0]])[0] == whole
        s, end, audit, cost = 0, conversations.last_symbol(whole), "", 0
        for p, a in zip(parts, after, strict=True):
            c, x, to = conversations.Chart(p, {a[s, end]: 0}, False).read(s)
            audit, cost, s = audit + x, cost + c, to
        rest = conversations.Chart("", dict.fromkeys(conversations.ENDS, 0), True).read(s)
        assert (cost + rest[0], audit + rest[1]) == conversations.parse(text)


def test_repair_agrees_with_sql(spark):
    want = sql_rows("op12_earley_repair", "conversations")
    got = queries.op12_earley_repair(spark, SMALL)
    cols = want.columns
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.fetchall()))


EXTRA = "token string, audit string, _c string, block string, place string"


def test_repair_edges(spark, monkeypatch):
    rng = random.Random(6)
    talks = {c: talk(rng, rng.randint(1, 12)) for c in range(40)} | {None: [("user", "x."), ("assistant", "y.")], 99: [("user", "a."), ("assistant", "b.")] * 60, 98: talk(rng, 150)}
    rows = [(c, t, r, x, *"vwxyz") for c, turns in talks.items() for t, (r, x) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, " + EXTRA)
    for block, fan in ((4096, 256), (3, 2)):
        monkeypatch.setattr(conversations, "BLOCK", block)
        monkeypatch.setattr(conversations, "_FAN", fan)
        got = {r["conv_id"]: r for r in conversations.summary(df, df).collect()}
        assert set(got) == set(talks)
        for c, turns in talks.items():
            cost, audit, digest = cheapest(turns)
            r, bad = got[c], Counter(faults(turns))
            assert (r["cost"], r["audit"], r["repaired_sha256"]) == (cost, audit, digest)
            assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"]) == (0, bad["blank"], bad["duplicate"], bad["truncated"])
            assert r["illegal"] == sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    audits = spark.createDataFrame([(c, cheapest(t)[1]) for c, t in talks.items()], "conv_id long, audit string")
    said = defaultdict(list)
    for r in sorted(conversations.replay(df, audits).collect(), key=lambda r: r["place"]):
        said[r["conv_id"]].append(f"{r['role']}:{r['text']}")
    for c, turns in talks.items():
        assert hashlib.sha256("\n".join(said[c]).encode()).hexdigest() == cheapest(turns)[2]


def test_repair_nulls(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, "user", "b."), (1, 5, None, "c."), (1, 2, "assistant", None), (1, None, None, None), (2, None, "user", None), (3, 0, "user", "long. " * 200_000), (3, 4, "assistant", "x.")]
    df = spark.createDataFrame(rows, schema)
    got = {r["conv_id"]: r for r in conversations.summary(df, df).collect()}
    assert (got[1]["gaps"], got[1]["blank"], got[2]["gaps"], got[3]["gaps"], got[3]["audit"]) == (2, 2, 0, 3, "KK")
    none = spark.createDataFrame([(7, 0, "user", "x.")], schema)
    r = conversations.summary(df, none).collect()
    assert [tuple(x) for x in r] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert conversations.summary(df.limit(0), df.limit(0)).collect() == []
    # a damaged row may be all that a conversation has
    assert conversations.damage(df).columns == ["conv_id", "turn", "role", "text"]


# 13
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def lower(w):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)


def counted(docs, least=5):
    n = Counter()
    for d, text in docs:
        for w in map(lower, RUN.findall(text or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                n[w] += 1
    return {w: k for w, k in n.items() if k >= least}


def one_apart(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def grouped(n):
    near = {w: [x for x in n if one_apart(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) for w, x in near.items() if x}
    form = {w: f for w, f in best.items() if n[f] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_automaton():
    rng = random.Random(1)
    for _ in range(200):
        held = sorted({bytes(rng.choices(b"abc\xe9", k=rng.randint(0, 7))) for _ in range(rng.randint(1, 60))})
        a = variants.Automaton(held)
        for i, w in enumerate(held):
            at, n = np.array([a.start]), 0
            for ch in w:
                at, more = a.step(at, np.array([ch]))
                n += int(more[0])
            assert a.accepts[at[0]] and n == i
        # minimal: no two states accept the same endings
        ends = [None] * len(a.size)
        for s in range(1, len(a.size)):
            ends[s] = frozenset(([b""] if a.accepts[s] else []) + [bytes([int(a.key[t]) & 255]) + e for t in range(a.first[s], a.first[s + 1]) for e in ends[a.target[t]]])
        assert len(set(ends[1:])) == len(ends) - 1
        asked = [w for w in held if w] + [bytes(rng.choices(b"abcd", k=rng.randint(1, 8))) for _ in range(20)]
        found = Counter()
        for back in (False, True):
            q, h = variants.search(held, asked, back)
            found.update(zip(q.tolist(), h.tolist(), strict=True))
        want = Counter((i, j) for i, x in enumerate(asked) for j, y in enumerate(held) if one_apart(x, y))
        assert found == want


def test_runs_and_slips():
    texts = ["Ab×cÀÉß zz1zz", None, "", "日本abc’déf", "x", "ÿĀÿ", "a"]
    data, off = buffers(texts)
    chars, s, e, t = variants.runs(data, off)
    assert [(k, bytes(chars[i:j]).decode("latin-1")) for i, j, k in zip(s, e, t, strict=True)] == [(k, lower(w)) for k, x in enumerate(texts) for w in RUN.findall(x or "")]
    state = np.array([zlib.crc32(b"12:")] * len(s), np.uint32)
    assert variants.crc_on(state, chars, s, e).tolist() == [zlib.crc32(b"12:" + bytes(chars[i:j]).decode("latin-1").encode()) for i, j in zip(s, e, strict=True)]


@pytest.mark.parametrize("part", [20_000, 40])
def test_variants(spark, part):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = grouped(counted(docs.select("doc_id", "text").collect()))
    got = variants.group(variants.words(docs), part=part)
    assert sorted(map(tuple, got.collect()), key=str) == want and got.columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_agree_with_sql(spark):
    want = sql_rows("op13_spelling_variants", "documents")
    got = queries.op13_spelling_variants(spark, SMALL).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.fetchall()), key=str)


def test_variants_edges(spark, edge):
    """Chains of forms, ties, hot prefixes, long words, nulls, repeated rows, extra columns and empty tables."""
    long = "abcdefghij" * 2000
    n = {"prefixed": 3000, "prefixes": 600, "prefixas": 100, "prefixat": 20, "prefixaa": 100, "prefix": 700, "unlike": 9, long: 50, long + "x": 10, long[1:]: 5, "élevée": 30, "élevéé": 5}
    n |= {f"hotpre{a}{b}": 5 + (ord(a) * ord(b)) % 40 for a in "abcdefgh" for b in "abcdefgh"}
    rows = spark.createDataFrame(list(n.items()), "word string, n long")
    assert sorted(map(tuple, variants.group(rows, part=10).collect()), key=str) == grouped(n)
    pairs = variants.near(rows.selectExpr("encode(word, 'ISO-8859-1') _w", "n"), pairs=True, part=10).collect()
    assert Counter((r[0].decode("latin-1"), r[1].decode("latin-1")) for r in pairs) == Counter((a, b) for a in n for b in n if one_apart(a, b))
    more = edge.unionByName(edge).unionByName(edge)
    got = {r["word"]: r["n"] for r in variants.words(more).collect()}
    assert got == counted(more.select("doc_id", "text").collect())
    for none in (edge.limit(0), edge.where("text IS NULL")):
        assert variants.group(variants.words(none)).collect() == []
    assert common.shared_dir(spark)
