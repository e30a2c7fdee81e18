"""Questions, communities and entropy: hand-computed cases and brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from docmill.operators import communities as C
from docmill.operators import questions as Q
from docmill.operators import truthful


def one(spark, text):
    return Q.parse(spark.createDataFrame([(text,)], "q string"), "q").first()


def test_parse(spark):
    r = one(spark, "Find all regulation and land use in gemeente Utrecht about parking near schools")
    assert (r["intent"], r["kind"], r["location"], r["topic"]) == ("spatial", "entity", "gemeente", "parking near schools")
    assert r["entity_types"] == ["Regulation", "LandUse"] and r["keywords"] == ["regulation", "land", "use", "gemeente", "utrecht", "about", "parking", "near", "schools"]
    r = one(spark, "Wat is de relatie: beperkt het plan? (gekoppeld)")
    assert r["kind"] == "relationship" and r["intent"] == "factual" and r["relation_types"] == ["CONSTRAINS"] and r["location"] is None
    for none in (None, "", "   "):
        r = one(spark, none)
        assert (r["intent"], r["kind"], r["keywords"], r["entity_types"], r["location"], r["topic"]) == ("direct", "entity", [], [], None, None)


def test_plan(spark):
    asked = [(1, "Compare noise rules with parking rules."), (2, "verschil tussen a b en c d?"), (3, "one; two; three; four"), (4, "Who pays? and when?"), (5, "plain"), (6, None), (7, "red vs blue")]
    got = Q.plan(spark.createDataFrame(asked, "k int, q string"), "k", "q").collect()
    of = {k: [r for r in got if r["k"] == k] for k in range(1, 8)}
    assert [[r["query"] for r in sorted(of[k], key=lambda r: r["step"])] for k in of] == [["noise rules", "parking rules", asked[0][1]], ["a b", "c d", asked[1][1]], ["one", "two", "three", "four"], ["Who pays", "and when?"], ["plain"], [""], ["red", "blue", "red vs blue"]]
    assert [of[k][0]["strategy"] for k in of] == ["parallel", "parallel", "cascade", "sequential", "sequential", "sequential", "parallel"]
    assert {r["priority"] for r in of[3]} == {"high", "medium", "low"}


def test_answer_runs_cascades_until_enough(spark):
    docs = spark.createDataFrame([(1, "one one"), (2, "one two"), (3, "two"), (4, "three"), (5, "four four"), (6, None), (7, "")], "id int, text string")
    of = (docs, "id", "text", Q.vocabulary(docs, "text"))
    asked = spark.createDataFrame([(1, "one; two; three; four"), (2, "compare one with two")], "k int, q string")
    few = Q.answer(Q.plan(asked, "k", "q", expected=2), "k", *of, 10).collect()
    assert {r["id"] for r in few if r["k"] == 1} == {1, 2}  # the first step finds two, so no other runs
    more = {(r["k"], r["id"]): (r["score"], r["steps"]) for r in Q.answer(Q.plan(asked, "k", "q", expected=5), "k", *of, 10).collect()}
    assert {i for k, i in more if k == 1} == {1, 2, 3, 4} and more[1, 2] == (1.0, 2)  # two steps have four results, three have five
    # a later step that scores less leaves the score; documents without any of the terms aren't there
    assert more[2, 2] == (1.0, 3) and {i for k, i in more if k == 2} == {1, 2, 3}
    assert Q.answer(Q.plan(asked.limit(0), "k", "q"), "k", *of).count() == 0 and Q.answer(Q.plan(asked, "k", "q"), "k", docs.limit(0), "id", "text", Q.vocabulary(docs.limit(0), "text")).count() == 0


def test_facts(spark):
    e = spark.createDataFrame([(1, "small ring", "steel ring", "Requirement", "utrecht"), (2, "bolt", "for a ring", "LandUse", "delft"), (3, "gear", None, None, None)], "id int, name string, description string, type string, place string")
    q = spark.createDataFrame([(1, "find requirement for small ring voor Utrecht"), (2, None)], "k int, q string")
    got = {r["id"]: round(r["relevance"], 6) for r in Q.facts(Q.parse(q, "q"), "k", e).collect()}
    # "voor" is a word of place and "for" isn't one, but a keyword, which the second description holds beside "ring"
    assert got == {1: 1.0, 2: 0.7}


def entropy(m):
    s = sum(m)
    return -sum(x / s * math.log2(x / s) for x in m if x > 1e-12) if s > 1e-12 else 0.0


@pytest.mark.parametrize("alone", [False, True])
def test_entropy_shifts(spark, alone):
    rng = random.Random(1)
    votes = [(q, a, rng.random()) for q in range(6) for a in rng.sample("abcde", rng.randint(0, 4)) for _ in range(rng.randint(1, 2))]
    facts = [(q, f, rng.choice("abcdef"), 0.1 + rng.random()) for q in range(7) for f in range(rng.randint(1, 5))]
    got = truthful.entropy_shifts(spark.createDataFrame(votes, "question int, answer string, mass double"), spark.createDataFrame(facts, "question int, fact int, answer string, weight double"), 0.1, alone).collect()
    assert len(got) == len(facts)
    for r in got:
        rest = [(a, m) for q, a, m in votes if q == r["question"]] + ([] if alone else [(a, w) for q, f, a, w in facts if q == r["question"] and f != r["fact"]])
        masses = lambda rows: [sum(m for a, m in rows if a == b) for b in {a for a, _ in rows}]
        assert r["before"] == pytest.approx(entropy(masses(rest)), abs=1e-6) and r["after"] == pytest.approx(entropy(masses([*rest, (r["answer"], r["weight"])])), abs=1e-6)
        assert r["corrective"] == (r["delta"] > 0.1) and r["severity"] == ("high" if r["delta"] > 0.3 else "medium" if r["delta"] > 0.1 else "low")


def test_conflicts(spark):
    chunks = spark.createDataFrame([(1, 1, "The Ring road, year 1999"), (1, 2, "a ring without more"), (1, 3, "nothing"), (1, 4, "Ring: as told here in full"), (2, 5, "ring"), (1, 6, None)], "question int, chunk int, text string")
    schema = "question int, fact int, entity string, name string, description string, relations array<string>"
    facts = spark.createDataFrame([(1, 1, "e", "ring", "ring: as told", None), (1, 2, "e", "ring", None, ["Opposes"]), (1, 3, "x", None, None, None), (2, 4, "e", "ring", None, None)], schema)
    shifts = spark.createDataFrame([(1, 1, 0.5, True), (1, 2, 0.05, False), (1, 3, 0.9, True), (2, 4, 0.2, True)], "question int, fact int, delta double, corrective boolean")
    got = {(r["question"], r["chunk"], r["fact"]): (r["type"], r["severity"], r["filtered"]) for r in truthful.conflicts(chunks, facts, shifts).collect()}
    assert got == {
        (1, 1, 1): ("temporal", "high", True), (1, 1, 2): ("temporal", "high", True), (1, 2, 1): ("semantic", "high", True), (1, 2, 2): ("contradiction", "high", True),
        (1, 4, 1): ("factual", "high", True), (1, 4, 2): ("contradiction", "high", True), (2, 5, 4): ("semantic", "medium", False),
    }


def test_tree_of_cliques(spark):
    """Four cliques, two and two joined by a link: the cliques are communities, pairs of them the next level's, and a lone node is its own."""
    groups = [range(10 * k, 10 * k + 5) for k in range(1, 5)]
    edges = [(a, b) for g in groups for a in g for b in g if a < b] + [(14, 20), (34, 40)]
    nodes = spark.createDataFrame([(i,) for g in groups for i in g] + [(99,)], "id long")
    levels, members = C.tree(spark.createDataFrame(edges, "src long, dst long"), nodes, 3)
    of = {}
    for r in C.membership(levels, members).collect():
        of.setdefault((r["level"], r["community"]), set()).add(r["id"])
    assert sorted(map(sorted, (v for (lv, _), v in of.items() if lv == 0))) == [list(g) for g in groups] + [[99]]
    assert sorted(map(sorted, (v for (lv, _), v in of.items() if lv == 1))) == [[*groups[0], *groups[1]], [*groups[2], *groups[3]], [99]]
    assert {r["parent"] for r in levels.where("level = 2").collect()} == {None}
    lone = C.tree(spark.createDataFrame([], "src long, dst long"), nodes.limit(1), 2)
    assert lone[0].count() == 2 and lone[1].count() == 1


def test_selection_from_the_top(spark):
    rng = random.Random(2)
    parent = {(0, c): c // 3 for c in range(27)} | {(1, c): c // 3 for c in range(9)} | {(2, c): None for c in range(3)}
    score = {(q, lv, c): round(rng.random(), 3) for q in range(8) for lv, c in parent if rng.random() < 0.8}
    scored = spark.createDataFrame([(q, lv, c, 1, s) for (q, lv, c), s in score.items()], "q int, level int, community long, size int, score double")
    levels = spark.createDataFrame([(lv, c, p) for (lv, c), p in parent.items()], "level int, community long, parent long")
    got = {(r["q"], r["level"], r["community"]) for r in C.select(scored, "q", levels, 0.3, 99).collect()}
    want = set()
    for q in range(8):
        opened = {(2, c) for c in range(3) if score.get((q, 2, c), 0) >= 0.3}
        for lv in (1, 0):
            opened |= {(lv, c) for (x, c), p in parent.items() if x == lv and (lv + 1, p) in opened and score.get((q, lv, c), 0) > score[q, lv + 1, p]}
        want |= {(q, lv, c) for lv, c in opened if not any((lv - 1, d) in opened for (x, d), p in parent.items() if x == lv - 1 and p == c)}
    assert got == want
    ranks = C.select(scored, "q", levels, 0.3, 2).groupBy("q").agg(F.max("rank").alias("m")).collect()
    assert max(r["m"] for r in ranks) == 2
    assert C.select(scored, "q", levels.limit(0)).count() == 0
