"""Graph operators over edges (src, dst, ...). Loops cut lineage each round with the reliable checkpoint and stop on a count."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.operators.dedup import cut, discard


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()


def turned(edges: DataFrame, direction: str) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"out": edges.select("src", "dst"), "in": back, "both": edges.select("src", "dst").unionByName(back)}[direction].distinct()


def k_hop(edges: DataFrame, start: DataFrame, k: int | None, direction: str = "out") -> DataFrame:
    """(start, id, hops): nodes within k hops of each start, at their least distance; with k None, however far. A round's tables go once the next is written."""
    e, old, hops = turned(edges, direction), [], 0
    seen = front = cut(start.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")), old)
    while k is None or hops < k:
        hops, new = hops + 1, []
        nxt = front.join(e, front["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        front = cut(nxt.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hops", F.lit(hops)), new)
        if front.isEmpty():
            discard(edges.sparkSession, new)
            break
        seen = cut(seen.unionByName(front), new)
        discard(edges.sparkSession, old)
        old = new
    return seen


def bfs_paths(edges: DataFrame, start: DataFrame, depth: int, direction: str = "out", most: int | None = None) -> DataFrame:
    """(id, hops, path): one shortest path to each node from any start, the least by order of its nodes; ``most`` nodes at most,
    in order of hops, then id."""
    e = turned(edges, direction)
    seen = cut(start.select("id", F.lit(0).alias("hops"), F.array("id").alias("path")))
    front = seen
    for h in range(1, depth + 1):
        nxt = front.join(e, front["id"] == e["src"]).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        nxt = nxt.groupBy("id").agg(F.min("path").alias("path")).withColumn("hops", F.lit(h)).select("id", "hops", "path")
        front = cut(nxt.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return seen if most is None else seen.orderBy("hops", "id").limit(most)


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the least id that each node is connected with. Least labels of neighbours, then of labels."""
    e = cut(undirected(edges))
    ids = (nodes_of(edges) if nodes is None else nodes.select("id").unionByName(nodes_of(edges))).distinct()
    lab = cut(ids.withColumn("component", F.col("id")))
    while True:
        near = e.join(lab, e["dst"] == lab["id"]).groupBy("src").agg(F.min("component").alias("m"))
        step = lab.join(near, lab["id"] == near["src"], "left").select("id", F.least("component", F.coalesce("m", "component")).alias("c"), F.col("component").alias("old"))
        step = cut(step)
        own = step.select(F.col("id").alias("_i"), F.col("c").alias("_c"))
        nxt = cut(step.join(own, F.col("c") == F.col("_i"), "left").select("id", F.least("c", F.coalesce("_c", "c")).alias("component"), "old"))
        lab = nxt.select("id", "component")
        if nxt.where("component <> old").isEmpty():
            return lab


def strong_components(edges: DataFrame) -> DataFrame:
    """(id, component) by colouring: the greatest id that reaches a node colours it; what a colour's root is reached from, within
    the colour, is its component."""
    left, e, done = cut(nodes_of(edges)), cut(edges.select("src", "dst").where("src <> dst").distinct()), None
    while not left.isEmpty():
        colour = cut(left.withColumn("c", F.col("id")))
        while True:
            up = e.join(colour, e["src"] == colour["id"]).groupBy("dst").agg(F.max("c").alias("m"))
            nxt = cut(colour.join(up, colour["id"] == up["dst"], "left").select("id", F.greatest("c", F.coalesce("m", "c")).alias("c"), F.col("c").alias("old")))
            colour = nxt.select("id", "c")
            if nxt.where("c <> old").isEmpty():
                break
        x, y = colour.select(F.col("id").alias("src"), F.col("c").alias("cs")), colour.select(F.col("id").alias("dst"), F.col("c").alias("cd"))
        inside = cut(e.join(x, "src").join(y, "dst").where("cs = cd").select("src", "dst"))
        back = inside.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        found = cut(colour.where("id = c").select("id", F.col("c").alias("component")))
        front = found
        while True:
            front = cut(front.join(back, front["id"] == back["src"]).select(F.col("dst").alias("id"), "component").distinct().join(found, ["id"], "left_anti"))
            if front.isEmpty():
                break
            found = cut(found.unionByName(front))
        done = found if done is None else done.unionByName(found)
        left = cut(left.join(found, "id", "left_anti"))
        e = cut(e.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti"))
    return done


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """(id): nodes of the k-core."""
    e = cut(undirected(edges))
    while True:
        deg = e.groupBy("src").agg(F.count("*").alias("d"))
        low = cut(deg.where(F.col("d") < k).select(F.col("src").alias("id")))
        if low.isEmpty():
            return e.select(F.col("src").alias("id")).distinct()
        e = cut(e.join(low.select(F.col("id").alias("src")), "src", "left_anti").join(low.select(F.col("id").alias("dst")), "dst", "left_anti"))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, label): each round takes the most frequent label of the neighbours and the node itself, ties to the least; with its own
    vote two linked nodes settle on one label rather than swap theirs."""
    both = undirected(edges)
    e = cut(both.unionByName(both.select("src", F.col("src").alias("dst")).distinct()))
    lab = cut(e.select(F.col("src").alias("id")).distinct().withColumn("label", F.col("id")))
    for _ in range(rounds):
        votes = e.join(lab, e["dst"] == lab["id"]).groupBy("src", "label").agg(F.count("*").alias("n"))
        lab = cut(votes.groupBy(F.col("src").alias("id")).agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label")))
    return lab


def pagerank(edges: DataFrame, rounds: int = 20, damping: float = 0.85, cut_every: int = 2) -> DataFrame:
    """(id, rank), ranks sum to 1; the mass of nodes without out-edges is spread over all."""
    e = cut(edges.select("src", "dst").distinct())
    out = e.groupBy("src").agg(F.count("*").alias("d"))
    ids = cut(nodes_of(e))
    n = ids.count()
    ranks = ids.join(out, ids["id"] == out["src"], "left").select("id", "d", F.lit(1.0 / max(n, 1)).alias("rank"))
    # held by source, so that a round shuffles ranks alone; lost parts are made again from the checkpoint
    w = cut(e.join(out, "src").select("src", "dst", (1 / F.col("d")).alias("w"))).repartition("src").persist()
    for i in range(rounds):
        loose = ranks.agg(F.coalesce(F.sum(F.when(F.col("d").isNull(), F.col("rank"))), F.lit(0.0)).alias("loose"))
        got = w.join(ranks, w["src"] == ranks["id"]).groupBy("dst").agg(F.sum(F.col("w") * F.col("rank")).alias("got"))
        ranks = ranks.join(got, ranks["id"] == got["dst"], "left").join(F.broadcast(loose), F.lit(True))
        ranks = ranks.select("id", "d", ((1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)).alias("rank"))
        if (i + 1) % cut_every == 0 or i + 1 == rounds:
            ranks = cut(ranks)
    w.unpersist()
    return ranks.select("id", "rank")


def eigenvector(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """(id, score): power iteration on the undirected graph plus the identity, scaled to a greatest score of 1."""
    e = cut(undirected(edges))
    x = cut(e.select(F.col("src").alias("id")).distinct().withColumn("score", F.lit(1.0)))
    for _ in range(rounds):
        got = e.join(x, e["dst"] == x["id"]).groupBy("src").agg(F.sum("score").alias("g"))
        y = x.join(got, x["id"] == got["src"]).select("id", (F.col("score") + F.col("g")).alias("score"))
        top = y.agg(F.max("score").alias("t"))
        x = cut(y.join(F.broadcast(top), F.lit(True)).select("id", (F.col("score") / F.col("t")).alias("score")))
    return x


def degrees(edges: DataFrame) -> DataFrame:
    """(id, ins, outs)."""
    both = edges.select(F.col("src").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return both.groupBy("id").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"))


def _walks(near: tuple[np.ndarray, np.ndarray], ws: np.ndarray, wt: np.ndarray, sources: Iterator[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brandes' sums over the given sources of a graph in rows (starts, neighbours), where a node stands for ``ws`` sources and ``wt`` nodes:
    the score of each node, the sources that reach it, and the nodes of its component."""
    at, to = near
    n = len(ws)
    score, reach, size = np.zeros(n), np.zeros(n), np.zeros(n)
    depth, paths, share = np.full(n, -1), np.zeros(n), np.zeros(n)
    for s in sources:
        levels, steps = [np.array([s])], []
        depth[s], paths[s] = 0, 1.0
        while len(levels[-1]):
            f, d = levels[-1], len(levels)
            many = at[f + 1] - at[f]
            there = to[np.arange(many.sum()) + np.repeat(at[f] - np.cumsum(many) + many, many)]
            new = np.unique(there[depth[there] < 0])
            depth[new] = d
            down = depth[there] == d
            step = np.repeat(f, many)[down], there[down]
            np.add.at(paths, step[1], paths[step[0]])
            steps.append(step)
            levels.append(new)
        for up, low in reversed(steps):
            np.add.at(share, up, paths[up] / paths[low] * (wt[low] + share[low]))
        met = np.concatenate(levels)
        share[s] = 0.0
        score[met] += ws[s] * share[met]
        reach[met] += ws[s]
        size[met] = wt[met].sum()
        depth[met], paths[met], share[met] = -1, 0.0, 0.0
    return score, reach, size


def _within(e: DataFrame, w: DataFrame, n: int) -> DataFrame:
    """(id, core, A, B) of a small graph: every task walks from some of its nodes over a copy of its ``n`` edges, which is 16 bytes an edge."""
    spark = e.sparkSession
    pairs = e.toPandas().to_numpy()
    ids, flat = np.unique(pairs, return_inverse=True)
    pairs = flat.reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    weights = w.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi").select("id", (F.col("own") + F.col("sa")).cast("double"), (1 + F.col("sb")).cast("double")).toPandas().sort_values("id").to_numpy()[:, 1:].astype(float)
    at = np.searchsorted(pairs[:, 0], np.arange(len(ids) + 1))
    held = spark.sparkContext.broadcast((ids, at, pairs[:, 1].copy(), weights[:, 0].copy(), weights[:, 1].copy()))

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, at, to, ws, wt = held.value
        for p in parts:
            score, reach, size = _walks((at, to), ws, wt, (int(i) for i in p["id"] if ws[i] > 0))
            met = np.flatnonzero(reach)
            yield pd.DataFrame({"id": ids[met], "core": score[met], "A": reach[met], "B": size[met]})

    tasks = max(1, min(len(ids), 4 * spark.sparkContext.defaultParallelism))
    got = spark.range(0, len(ids), 1, tasks).mapInPandas(walk, f"id {e.schema['src'].dataType.simpleString()}, core double, A double, B double")
    return got.groupBy("id").agg(F.sum("core").alias("core"), F.sum("A").alias("A"), F.max("B").alias("B"))


def _between(e: DataFrame, w: DataFrame, at_once: int) -> DataFrame:
    """(id, core, A, B) of a graph of any size: the sources of a block of about ``at_once`` walk together, a join a level: forward with the numbers
    of shortest paths, then backward with the shares of the paths that go through. A level and its predecessor suffice to tell new nodes, so a
    round reads two levels, not all. A block's tables hold at most a row for each of its sources and each node, and are deleted once it is summed."""
    spark, total = e.sparkSession, None
    weights = w.select("id", (F.col("own") + F.col("sa")).cast("double").alias("ws"), (1 + F.col("sb")).cast("double").alias("wt"))
    start = weights.where("ws > 0").join(e.select(F.col("src").alias("id")).distinct(), "id", "left_semi")
    blocks = -(-start.count() // at_once)
    dealt = start.withColumn("_b", F.pmod(F.xxhash64("id"), F.lit(max(1, blocks))))
    for block in range(blocks):
        old: list[str] = []
        levels = [cut(dealt.where(F.col("_b") == block).select(F.col("id").alias("s"), "id", F.lit(1.0).alias("paths"), "wt"), old)]
        while True:
            new = levels[-1].join(e, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum("paths").alias("paths"))
            for before in levels[-2:]:
                new = new.join(before.select("s", "id"), ["s", "id"], "left_anti")
            new = cut(new.join(weights.select("id", "wt"), "id").select("s", "id", "paths", "wt"), old)
            if new.isEmpty():
                break
            levels.append(new)
        shares = [levels[-1].withColumn("share", F.lit(0.0))]
        for lower in reversed(levels[:-1]):
            back = shares[-1].join(e, F.col("id") == F.col("src")).groupBy("s", F.col("dst").alias("id")).agg(F.sum((F.col("wt") + F.col("share")) / F.col("paths")).alias("_g"))
            shares.append(cut(lower.join(back, ["s", "id"], "left").select("s", "id", "paths", "wt", (F.col("paths") * F.coalesce("_g", F.lit(0.0))).alias("share")), old))
        through = shares[0]
        for x in shares[1:]:
            through = through.unionByName(x)
        sizes = through.groupBy("s").agg(F.sum("wt").alias("B")).join(dealt.select(F.col("id").alias("s"), "ws"), "s")
        part = through.join(sizes, "s").groupBy("id").agg(F.sum(F.when(F.col("id") != F.col("s"), F.col("ws") * F.col("share")).otherwise(0.0)).alias("core"), F.sum("ws").alias("A"), F.max("B").alias("B"))
        part = cut(part)
        discard(spark, old)
        total = part if total is None else total.unionByName(part)
    if total is None:
        return spark.createDataFrame([], "id long, core double, A double, B double")
    return total.groupBy("id").agg(F.sum("core").alias("core"), F.sum("A").alias("A"), F.max("B").alias("B"))


def betweenness(edges: DataFrame, sources: DataFrame, at_once: int = 1000, held: int = 2_000_000) -> DataFrame:
    """(id, score): Brandes' sums over the shortest paths from the given sources, for every node that some other source reaches.

    Nodes with one neighbour are folded into it, round by round while that takes a twentieth of the nodes left: every path to or from a folded
    node runs by its neighbour, so products of counts give what folding hides, and only the rest is walked, each node standing for those
    folded into it. A rest of at most ``held`` edges is walked in numpy, its sources dealt to tasks; a larger one by ``_between``.
    """
    spark, kept = edges.sparkSession, []
    e = cut(undirected(edges), kept)
    own = sources.select("id").distinct().withColumn("own", F.lit(1))
    none = F.lit(0).cast("double")
    w = cut(e.select(F.col("src").alias("id")).distinct().join(own, "id", "left").select("id", F.coalesce("own", F.lit(0)).alias("own"), none.alias("sa"), none.alias("sb"), none.alias("sab")), kept)
    folded: list[DataFrame] = []
    left = w.count()
    while left:
        lone = cut(e.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("p")).where("n = 1").select("id", "p"), kept)
        # of two nodes that have but each other, the greater goes
        gone = lone.join(lone.select(F.col("id").alias("p"), F.lit(1).alias("_both")), "p", "left").where("_both IS NULL OR id > p").select("id", "p")
        gone = cut(gone.join(w, "id").select("id", "p", "own", "sa", "sb", "sab"), kept)
        n = gone.count()
        if n * 20 < left or not n:
            break
        folded.append(gone)
        a, b = F.col("own") + F.col("sa"), 1 + F.col("sb")
        more = gone.groupBy(F.col("p").alias("id")).agg(F.sum(a).alias("_a"), F.sum(b).alias("_b"), F.sum(a * b).alias("_ab"))
        add = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0.0))).alias(c)
        w = cut(w.join(gone.select("id"), "id", "left_anti").join(more, "id", "left").select("id", "own", add("sa", "_a"), add("sb", "_b"), add("sab", "_ab")), kept)
        e = cut(e.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), kept)
        left -= n
    n = e.count()
    core = cut(_within(e, w, n) if n <= held else _between(e, w, at_once), kept)
    # a node left without edges is its whole component; one with edges that no source reaches has no row in core
    alone = w.join(e.select(F.col("src").alias("id")).distinct(), "id", "left_anti").select("id", none.alias("core"), (F.col("own") + F.col("sa")).alias("A"), (1 + F.col("sb")).alias("B"))
    done = w.join(core.unionByName(alone), "id")
    for gone in reversed(folded):
        up = done.select(F.col("id").alias("p"), "A", "B")
        done = cut(done.unionByName(gone.join(up, "p").select("id", "own", "sa", "sb", "sab", none.alias("core"), "A", "B")), kept)
    score = (F.col("B") - 1) * F.col("sa") - F.col("sab") + (F.col("A") - F.col("sa") - F.col("own")) * F.col("sb") + F.col("core")
    out = cut(done.where("A > own").select("id", score.alias("score")))
    discard(spark, kept)
    return out


def _louvain(f: pd.DataFrame) -> pd.DataFrame:
    """Greedy moves to the neighbouring community of greatest gain, then the graph of communities, until nothing moves."""
    comp = f["component"].iloc[0]
    ids = np.unique(f[["src", "dst"]].to_numpy())
    at = {v: i for i, v in enumerate(ids)}
    near: list[dict[int, float]] = [{} for _ in ids]
    for a, b in zip(f["src"], f["dst"], strict=True):
        near[at[a]][at[b]] = near[at[a]].get(at[b], 0) + 1.0
    member = list(range(len(ids)))
    m2 = sum(sum(d.values()) for d in near)
    while True:
        n = len(near)
        com, deg = list(range(n)), [sum(d.values()) for d in near]
        tot, moved, any_move = deg[:], True, False
        while moved:
            moved = False
            for v in range(n):
                links: dict[int, float] = {}
                for u, w in near[v].items():
                    if u != v:
                        links[com[u]] = links.get(com[u], 0) + w
                tot[com[v]] -= deg[v]
                best, gain = com[v], links.get(com[v], 0) - tot[com[v]] * deg[v] / m2
                for c in sorted(links):
                    g = links[c] - tot[c] * deg[v] / m2
                    if g > gain + 1e-12:
                        best, gain = c, g
                tot[best] += deg[v]
                if best != com[v]:
                    com[v], moved, any_move = best, True, True
        if not any_move:
            break
        names = {c: i for i, c in enumerate(sorted(set(com)))}
        member = [names[com[c]] for c in member]
        bigger: list[dict[int, float]] = [{} for _ in names]
        for v in range(n):
            for u, w in near[v].items():
                x, y = names[com[v]], names[com[u]]
                bigger[x][y] = bigger[x].get(y, 0) + w
        near = bigger
    low: dict[int, int] = {}
    for v, c in zip(ids, member, strict=True):
        low[c] = min(low.get(c, v), v)
    return pd.DataFrame({"id": ids, "community": [low[c] for c in member], "component": comp})


def louvain(edges: DataFrame) -> DataFrame:
    """(id, community, component): modularity communities by moves over all nodes at once; no component is gathered in a task."""
    com = _levels(edges, lambda w, d, own, tot, out, every: w - tot * d, 6, 5)
    return com.join(components(undirected(edges)), "id").select("id", "community", "component")


def louvain_small(edges: DataFrame) -> DataFrame:
    """As ``louvain``, by sequential moves, for graphs of small components: each component must fit one task."""
    e = undirected(edges)
    comp = components(e)
    kind = dict(edges.dtypes)["src"]
    return e.join(comp, e["src"] == comp["id"]).select("src", "dst", "component").groupBy("component").applyInPandas(_louvain, f"id {kind}, community {kind}, component {kind}")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the modularity of (id, label) over the undirected graph."""
    e = undirected(edges)
    a, b = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    j = e.join(a, "src").join(b, "dst")
    m2 = j.agg(F.count("*").alias("m2"))
    per = j.groupBy("la").agg(F.count_if(F.col("la") == F.col("lb")).alias("inside"), F.count("*").alias("deg")).join(F.broadcast(m2), F.lit(True))
    return per.agg(F.sum(F.col("inside") / F.col("m2") - F.pow(F.col("deg") / F.col("m2"), 2)).alias("modularity"))


def community_stats(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, edges): counts of edges within and between communities."""
    x, y = labels.select(F.col("id").alias("src"), F.col("label").alias("la")), labels.select(F.col("id").alias("dst"), F.col("label").alias("lb"))
    return edges.join(x, "src").join(y, "dst").groupBy(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).agg(F.count("*").alias("edges"))


def shortest_paths(edges: DataFrame, start: DataFrame, weight: str, most_rounds: int = 200) -> DataFrame:
    """(start, id, cost, via) by relaxing rounds from each start; weights must not be negative."""
    best = cut(start.select(F.col("id").alias("start"), "id", F.lit(0.0).alias("cost"), F.lit(None).cast(dict(edges.dtypes)["src"]).alias("via")))
    front = best
    for _ in range(most_rounds):
        nxt = front.join(edges, front["id"] == edges["src"]).select("start", F.col("dst").alias("id"), (F.col("cost") + F.col(weight)).alias("cost"), F.col("src").alias("via"))
        nxt = nxt.groupBy("start", "id").agg(F.min(F.struct("cost", "via")).alias("b")).select("start", "id", F.col("b.cost").alias("new"), F.col("b.via").alias("new_via"))
        j = cut(best.join(nxt, ["start", "id"], "full_outer").withColumn("better", F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))))
        pick = lambda a, b: F.when(F.col("better"), F.col(b)).otherwise(F.col(a)).alias(a)
        front = cut(j.where("better").select("start", "id", pick("cost", "new"), pick("via", "new_via")))
        best = cut(j.select("start", "id", pick("cost", "new"), pick("via", "new_via")))
        if front.isEmpty():
            return best
    raise RuntimeError("paths did not settle")


def steiner(edges: DataFrame, terminals: list, weight: str, most: int = 64) -> DataFrame:
    """(src, dst): edges of a tree that joins a few terminals: shortest paths between them, a spanning tree of these, expanded."""
    if len(terminals) > most:
        raise ValueError(f"at most {most} terminals")
    spark = edges.sparkSession
    both = cut(edges.select("src", "dst", weight).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)).groupBy("src", "dst").agg(F.min(weight).alias(weight)))
    start = spark.createDataFrame([(x,) for x in terminals], f"id {dict(edges.dtypes)['src']}")
    dist = cut(shortest_paths(both, start, weight))
    pairs = dist.join(start.withColumnRenamed("id", "t"), F.col("id") == F.col("t"), "left_semi").where("start < id").select("start", "id", "cost").collect()  # at most most^2
    root = {x: x for x in terminals}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    chosen = []
    for r in sorted(pairs, key=lambda r: (r["cost"], r["start"], r["id"])):
        a, b = find(r["start"]), find(r["id"])
        if a != b:
            root[max(a, b)] = min(a, b)
            chosen.append((r["start"], r["id"]))
    schema = f"start {dict(edges.dtypes)['src']}, id {dict(edges.dtypes)['src']}"
    walk, out = cut(spark.createDataFrame(chosen, schema)), None
    while not walk.isEmpty():
        step = cut(walk.join(dist.select("start", "id", "via"), ["start", "id"]).where("via IS NOT NULL"))
        part = step.select(F.least("id", "via").alias("src"), F.greatest("id", "via").alias("dst"))
        out = part if out is None else out.unionByName(part)
        walk = step.select("start", F.col("via").alias("id"))
    return out.distinct() if out is not None else edges.select("src", "dst").limit(0)


def subgraph(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("src")), "src", "left_semi").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi")


def descendants(parents: DataFrame, root: DataFrame) -> DataFrame:
    """(id, hops) below the roots in (child, parent), however deep."""
    return k_hop(parents.select(F.col("parent").alias("src"), F.col("child").alias("dst")), root, None).select("id", "hops")


def transitive(edges: DataFrame, least: float = 0.5) -> DataFrame:
    """(src, dst, confidence): two hops without an edge; 0.9 x 0.8 for the one extra hop."""
    a, b = edges.select("src", F.col("dst").alias("mid")), edges.select(F.col("src").alias("mid"), "dst")
    two = a.join(b, "mid").where("src <> dst").select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    return two.withColumn("confidence", F.greatest(F.lit(least), F.lit(0.9 * 0.8)))


def supersedes(docs: DataFrame, key: str, group: str, at: str, least: float = 0.5) -> DataFrame:
    """(newer, older, confidence) of neighbours in time within a group: 0.8 - 0.1 a year apart, at least ``least``."""
    w = Window.partitionBy(group).orderBy(at, key)
    d = docs.select(F.col(key).alias("newer"), F.lag(key).over(w).alias("older"), ((F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(w).cast("timestamp"))) / (365 * 86_400_000_000.0)).alias("years"))
    return d.where("older IS NOT NULL").select("newer", "older", F.greatest(F.lit(least), 0.8 - 0.1 * F.col("years")).alias("confidence"))


def impact(edges: DataFrame, start: DataFrame, depth: int, level_weight: float = 0.5) -> DataFrame:
    """(start, affected, impact): min(1, sum of level weights / affected)."""
    hops = k_hop(edges, start, depth, "in").where("hops > 0")
    g = hops.groupBy("start").agg(F.count("*").alias("affected"), F.sum(F.pow(F.lit(level_weight), F.col("hops") - 1)).alias("s"))
    return g.select("start", "affected", F.least(F.lit(1.0), F.col("s") / F.col("affected")).alias("impact"))


def path_clusters(urls: DataFrame, url: str, depth: int = 2) -> DataFrame:
    """(cluster, n) by the first ``depth`` parts of a URL after its scheme."""
    parts = F.slice(F.filter(F.split(F.regexp_replace(F.regexp_replace(F.col(url), "^[a-zA-Z]+://", ""), "[?#].*$", ""), "/"), lambda p: p != ""), 1, depth)
    return urls.groupBy(F.array_join(parts, "/").alias("cluster")).agg(F.count("*").alias("n"))


def circular(nodes: DataFrame, radius: float = 1.0) -> DataFrame:
    """(id, x, y) around a circle in order of id; for graphs that are drawn, not for corpora."""
    n = nodes.agg(F.count("*").alias("n"))
    a = 2 * np.pi * (F.row_number().over(Window.orderBy("id")) - 1) / F.col("n")
    return nodes.join(F.broadcast(n), F.lit(True)).select("id", (radius * F.cos(a)).alias("x"), (radius * F.sin(a)).alias("y"))


def links_of(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, href, place): anchors of each page."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href=[\"']([^\"']+)[\"']"), 1)).alias("place", "href"))


def weighted_score(confidence: Column, recency: Column, authority: Column) -> Column:
    return 0.5 * confidence + 0.25 * recency + 0.25 * authority


def best_first(edges: DataFrame, start: DataFrame, weight: str, depth: int) -> DataFrame:
    """(id, score): the greatest product of weights over paths of at most ``depth`` edges."""
    best = cut(start.select("id", F.lit(1.0).alias("score")))
    front = best
    for _ in range(depth):
        nxt = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), (F.col("score") * F.col(weight)).alias("score"))
        front = cut(nxt.groupBy("id").agg(F.max("score").alias("score")))
        best = cut(best.unionByName(front).groupBy("id").agg(F.max("score").alias("score")))
    return best


def graph_problems(nodes: DataFrame, edges: DataFrame, vectors: DataFrame, dims: int) -> DataFrame:
    """(problem, n): dangling edges, orphans, nodes on cycles, repeated uris, connected parts, and vectors that aren't ``dims`` numbers."""
    e, ids = edges.select("src", "dst"), nodes.select("id")
    known = ids.distinct()
    found = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    whole = e.join(known.select(F.col("id").alias("src")), "src", "left_semi").join(known.select(F.col("id").alias("dst")), "dst", "left_semi")
    dangling = e.agg(F.count("*").alias("a")).join(whole.agg(F.count("*").alias("b")), F.lit(True)).select(F.lit("dangling").alias("problem"), (F.col("a") - F.col("b")).alias("n"))
    strong = strong_components(e)
    cyclic = strong.join(strong.groupBy("component").agg(F.count("*").alias("c")).where("c > 1"), "component", "left_semi").select("id").union(e.where("src = dst").select("src")).distinct()
    parts = components(e, known)
    return (
        dangling.unionByName(found(known.join(nodes_of(e), "id", "left_anti"), "orphan"))
        .unionByName(found(cyclic, "cyclic"))
        .unionByName(found(nodes.groupBy("uri").count().where("count > 1"), "duplicate_uri"))
        .unionByName(found(parts.join(known, "id", "left_semi").select("component").distinct(), "components"))
        .unionByName(found(vectors.where((F.size("embedding") != dims) | F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))), "bad_vector"))
    )


def centralities(edges: DataFrame) -> DataFrame:
    """(id, ins, outs, pagerank, eigenvector, betweenness) of every node, side by side."""
    out = degrees(edges)
    for name, df in (("pagerank", pagerank(edges).select("id", F.col("rank").alias("pagerank"))), ("eigenvector", eigenvector(edges).select("id", F.col("score").alias("eigenvector"))), ("betweenness", betweenness(edges, nodes_of(edges)).select("id", F.col("score").alias("betweenness")))):
        out = out.join(df, "id", "left").withColumn(name, F.coalesce(name, F.lit(0.0)))
    return out


def preorder(edges: DataFrame, root: int) -> DataFrame:
    """(id, place, depth) of a tree's nodes in the order of a depth-first walk that takes children by id.

    Subtree sizes are summed from the leaves up and places handed down from the root, a level a round, so no task walks the tree.
    """
    levels = [cut(edges.sparkSession.createDataFrame([(root,)], "id long").withColumn("up", F.lit(None).cast("long")))]
    e = cut(edges.where("src <> dst").select(F.col("src").alias("up"), F.col("dst").alias("id")))
    while True:
        nxt = cut(e.join(levels[-1].select(F.col("id").alias("up")), "up", "left_semi").select("id", "up"))
        if nxt.isEmpty():
            break
        levels.append(nxt)
    sized = [None] * len(levels)
    for d in range(len(levels) - 1, -1, -1):
        below = sized[d + 1].groupBy(F.col("up").alias("id")).agg(F.sum("size").alias("s")) if d + 1 < len(levels) else None
        here = levels[d].join(below, "id", "left").select("id", "up", (F.coalesce("s", F.lit(0)) + 1).alias("size")) if below is not None else levels[d].select("id", "up", F.lit(1).cast("long").alias("size"))
        sized[d] = cut(here)
    placed = sized[0].select("id", F.lit(0).cast("long").alias("place"))
    out = placed.withColumn("depth", F.lit(0))
    for d in range(1, len(sized)):
        before = F.sum("size").over(Window.partitionBy("up").orderBy("id")) - F.col("size")
        placed = cut(sized[d].withColumn("_b", before).join(placed.select(F.col("id").alias("up"), F.col("place").alias("_p")), "up").select("id", (F.col("_p") + 1 + F.col("_b")).alias("place")))
        out = out.unionByName(placed.withColumn("depth", F.lit(d)))
    return out


def relevant(edges: DataFrame, start: DataFrame, depth: int, stop: float) -> DataFrame:
    """(id, score) over edges (src, dst, w, node): the best relevance of a path to each node, which is 0.9 of the path so far, 0.1 of
    the node's own and 0.2 of the edge's weight, 1 at most; a path below ``stop`` goes no further. A score never falls by being
    reached better, so the best path to each node is enough to go on from."""
    best = cut(start.select("id", F.lit(1.0).alias("score")))
    front = best
    for _ in range(depth):
        nxt = front.join(edges, front["id"] == edges["src"]).select(F.col("dst").alias("id"), F.least(F.lit(1.0), 0.9 * F.col("score") + 0.1 * F.col("node") + 0.2 * F.col("w")).alias("score"))
        front = cut(nxt.where(F.col("score") >= stop).groupBy("id").agg(F.max("score").alias("score")))
        if front.isEmpty():
            break
        best = cut(best.unionByName(front).groupBy("id").agg(F.max("score").alias("score")))
    return best


def astar(edges: DataFrame, goals: DataFrame, weight: str, heuristic=None, most_rounds: int = 1000) -> DataFrame:
    """(start, goal, cost) of the cheapest path for each (start, goal); pairs without a path are left out.

    ``heuristic``: a function of (node, goal) columns to a column that never exceeds the cost that is left, 0 by default. Nodes whose
    cost so far plus heuristic can't beat the best path found are dropped each round; all starts advance together.
    """
    h = heuristic or (lambda node, goal: F.lit(0.0))
    best = cut(goals.select("start", "goal", F.col("start").alias("id"), F.lit(0.0).alias("cost")))
    front = best
    for _ in range(most_rounds):
        nxt = front.join(edges, front["id"] == edges["src"]).select("start", "goal", F.col("dst").alias("id"), (F.col("cost") + F.col(weight)).alias("cost"))
        nxt = nxt.groupBy("start", "goal", "id").agg(F.min("cost").alias("new"))
        got = best.where("id = goal").select("start", "goal", F.col("cost").alias("_found"))
        nxt = nxt.join(got, ["start", "goal"], "left").where(F.col("_found").isNull() | (F.col("new") + h(F.col("id"), F.col("goal")) < F.col("_found"))).drop("_found")
        j = cut(best.join(nxt, ["start", "goal", "id"], "full_outer"))
        better = F.col("new").isNotNull() & (F.col("cost").isNull() | (F.col("new") < F.col("cost")))
        front = cut(j.where(better).select("start", "goal", "id", F.col("new").alias("cost")))
        best = cut(j.select("start", "goal", "id", F.least("cost", "new").alias("cost")))
        if front.isEmpty():
            return best.where("id = goal").select("start", "goal", "cost")
    raise RuntimeError("paths did not settle")


#: How much a dependency of a type weighs, and how much its distance.
IMPACT_TYPE = {"OVERRIDES": 1.2, "AMENDS": 1.1, "IMPLEMENTS": 1.0, "REFINES": 0.9, "REFERENCES": 0.5}
IMPACT_LEVEL = {"direct": 1.0, "indirect": 0.7, "critical": 1.5}


def typed_impact(edges: DataFrame, start: DataFrame, depth: int, critical: Column | None = None) -> DataFrame:
    """(start, n, impact): min(1, mean over the affected of level weight x type weight x confidence) along edges (src, dst, type,
    confidence) against their direction. A node counts at its least distance, by its strongest edge there; ``critical``: a condition
    over the edge that makes it a critical one."""
    hops = k_hop(edges, start, depth, "in")
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in IMPACT_TYPE.items() for x in kv)), F.col("type"))
    level = F.when(F.col("h") == 1, IMPACT_LEVEL["direct"]).otherwise(IMPACT_LEVEL["indirect"])
    level = level if critical is None else F.when(critical, IMPACT_LEVEL["critical"]).otherwise(level)
    before = hops.select("start", F.col("id").alias("dst"), (F.col("hops") + 1).alias("h"))
    at = edges.join(before, "dst").join(hops.select("start", F.col("id").alias("src"), F.col("hops").alias("h")), ["start", "src", "h"])
    per = at.groupBy("start", "src").agg(F.max(level * F.coalesce(weight, F.lit(1.0)) * F.col("confidence")).alias("s"))
    return per.groupBy("start").agg(F.count("*").alias("n"), F.least(F.lit(1.0), F.sum("s") / F.count("*")).alias("impact"))


def numbered(df: DataFrame, by: str, name: str = "i") -> DataFrame:
    """``df`` with its place (from 0) in order of ``by``: ranges are numbered where they are, and offset by the ranges before."""
    put = cut(df.repartitionByRange(F.col(by)).sortWithinPartitions(by).withColumn("_at", F.monotonically_increasing_id()))
    put = put.withColumn("_p", F.shiftright("_at", 33)).withColumn("_n", F.col("_at").bitwiseAND((1 << 33) - 1))
    sizes = put.groupBy("_p").agg(F.count("*").alias("c"))  # a row a range
    before = sizes.select("_p", (F.sum("c").over(Window.orderBy("_p")) - F.col("c")).alias("_o"))
    return put.join(before, "_p").withColumn(name, F.col("_o") + F.col("_n")).drop("_at", "_p", "_n", "_o")


def grid(nodes: DataFrame, spacing: float, at: float = 100.0) -> DataFrame:
    """(id, x, y): rows of a square grid in order of id."""
    n = nodes.agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("_c"))  # one row
    j = numbered(nodes.select("id"), "id").join(F.broadcast(n), F.lit(True))
    return j.select("id", (at + F.pmod("i", "_c") * spacing).alias("x"), (at + F.expr("i div _c") * spacing).alias("y"))


def applies_to(area: DataFrame, rules: DataFrame, known: DataFrame, types: tuple[str, ...]) -> DataFrame:
    """(src, dst, confidence): a document's rule (doc, rule, type), by one of ``types``, applies to the areas (doc, area) that the
    document touches, unless that edge is known (src, dst)."""
    j = rules.where(F.col("type").isin(*types)).select("doc", "rule").distinct().join(area.distinct(), "doc")
    found = j.select(F.col("rule").alias("src"), F.col("area").alias("dst")).distinct().join(known.select("src", "dst"), ["src", "dst"], "left_anti")
    return found.withColumn("confidence", F.lit(0.85))


def mentions(entities: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, page): pages (page, words) that name an entity (id, name) in one of their distinct words; entities of one name share the
    look-up, so a word is joined once however many bear it."""
    by = entities.groupBy("name").agg(F.collect_list("id").alias("ids"))
    return pages.select("page", F.explode("words").alias("name")).join(by, "name").select(F.explode("ids").alias("id"), "page")


def node_changes(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change, fields): added, removed, updated (with the names of the changed fields) or unchanged."""
    a = old.select(key, F.struct(*columns).alias("_a"))
    b = new.select(key, F.struct(*columns).alias("_b"))
    differ = F.array_compact(F.array(*(F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns)))
    j = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(differ) > 0, "updated").otherwise("unchanged")
    return j.select(key, change.alias("change"), F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), differ).otherwise(F.array().cast("array<string>")).alias("fields"))


def _levels(edges: DataFrame, score, rounds: int, levels: int) -> DataFrame:
    """(id, community) by rounds of local moves over a weighted undirected graph, then over the graph of its communities.

    In a round every node looks at its neighbours' communities, but only half of the nodes (by a hash of node and round) move, so two
    neighbours seldom swap. ``score``: the gain, as a column, of a node that stands alone and joins a community: of w (its weight to the
    community), d (its degree), own (its inner weight), tot and cut (the community's degree and weight to the outside, without the
    node), all as shares of the total, and all (every community's weight to the outside).
    """
    e = cut(undirected(edges).select("src", "dst", F.lit(1.0).alias("w")))
    m2 = e.agg(F.sum("w")).first()[0] or 1.0
    e = cut(e.withColumn("w", F.col("w") / m2))
    member = cut(e.select(F.col("src").alias("id")).distinct().withColumn("node", F.col("id")))
    for _ in range(levels):
        own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0))
        com = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), own.alias("own")).withColumn("com", F.col("id")))
        for i in range(rounds):
            near = e.where("src <> dst").join(com.select(F.col("id").alias("dst"), F.col("com").alias("c")), "dst").select(F.col("src").alias("id"), "c", "w")
            near = near.unionByName(com.select("id", F.col("com").alias("c"), F.lit(0.0).alias("w"))).groupBy("id", "c").agg(F.sum("w").alias("w"))
            links = cut(near.join(com, "id"))
            per = links.where("c = com").groupBy("c").agg(F.sum("d").alias("tot"), F.sum(F.col("d") - F.col("own") - F.col("w")).alias("cut"))
            every = per.agg(F.sum("cut").alias("all"))  # one row
            at = links.join(per, "c").join(F.broadcast(every), F.lit(True))
            mine = F.col("c") == F.col("com")
            tot = F.when(mine, F.col("tot") - F.col("d")).otherwise(F.col("tot"))
            out = F.when(mine, F.greatest(F.lit(0.0), F.col("cut") - (F.col("d") - F.col("own") - 2 * F.col("w")))).otherwise(F.col("cut"))
            at = at.withColumn("g", F.round(score(F.col("w"), F.col("d"), F.col("own"), tot, out, F.col("all")), 12))
            best = at.groupBy("id", "com", "d", "own").agg(F.max(F.struct("g", (-F.col("c")).alias("n"))).alias("m"), F.max(F.when(mine, F.col("g"))).alias("stay"))
            could = F.col("m.g") > F.col("stay")
            free = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(2)) == 0
            nxt = cut(best.select("id", "d", "own", F.when(free & could, -F.col("m.n")).otherwise(F.col("com")).alias("com"), could.alias("could")))
            com = nxt.drop("could")
            if not nxt.where("could").limit(1).count():
                break
        member = cut(member.join(com.select(F.col("id").alias("node"), "com"), "node").select("id", F.col("com").alias("node")))
        a, b = com.select(F.col("id").alias("src"), F.col("com").alias("x")), com.select(F.col("id").alias("dst"), F.col("com").alias("y"))
        less = cut(e.join(a, "src").join(b, "dst").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.sum("w").alias("w")))
        if less.count() == e.count():
            break
        e = less
    low = member.groupBy("node").agg(F.min("id").alias("community"))
    return member.join(low, "node").select("id", "community")


def _settled(e: DataFrame, com: DataFrame, tolerance: float) -> DataFrame:
    """``com`` (id, d, own, com) after rounds of moves that raise modularity, as weights of ``e`` are shares of the total.

    A part of the nodes (half at first) moves in a round, each to its best community. A round that gains no more than ``tolerance`` is taken
    back and tried with half as many nodes, as moves made at once may spoil each other; below a sixteenth, or where none could move, it is settled.
    """
    old: list[str] = []
    kept, part, i = None, 2, 0
    while True:
        to = com.select(F.col("id").alias("dst"), F.col("com").alias("c"))
        near = e.where("src <> dst").join(to, "dst").select(F.col("src").alias("id"), "c", "w").unionByName(com.select("id", F.col("com").alias("c"), F.lit(0.0).alias("w")))
        links = cut(near.groupBy("id", "c").agg(F.sum("w").alias("w")).join(com, "id"), old)
        per = links.where("c = com").groupBy("c").agg(F.sum("d").alias("tot"), F.sum(F.col("w") + F.col("own")).alias("inside"))
        score = per.agg(F.sum(F.col("inside") - F.col("tot") * F.col("tot"))).first()[0]
        if kept is not None and score <= kept[0] + tolerance:
            score, com, links, per = kept
            part *= 2
        kept = (score, com, links, per)
        others = F.when(F.col("c") == F.col("com"), F.col("tot") - F.col("d")).otherwise(F.col("tot"))
        gain = links.join(per, "c").withColumn("g", F.round(F.col("w") - others * F.col("d"), 12))
        best = gain.groupBy("id", "d", "own", "com").agg(F.min(F.struct((-F.col("g")).alias("less"), "c")).alias("b"), F.max(F.when(F.col("c") == F.col("com"), F.col("g"))).alias("stay"))
        could = -F.col("b.less") > F.col("stay")
        turn = F.pmod(F.xxhash64("id", F.lit(i)), F.lit(part)) == 0
        i += 1
        after = cut(best.select("id", "d", "own", F.when(could & turn, F.col("b.c")).otherwise(F.col("com")).alias("com"), could.alias("could")), old)
        if part > 16 or after.where("could").isEmpty():
            out = cut(com)
            discard(e.sparkSession, old)
            return out
        com = after.drop("could")


def _refined(e: DataFrame, com: DataFrame) -> DataFrame:
    """(id, com, fine): each community of ``com`` (id, d, com) split from single nodes up into parts that are connected and well linked to it.

    A node that is alone, and linked to the rest of its community as well as chance would, joins the part of most gain among those as well linked.
    Nodes that may move in a round join only parts that don't move in it, so that parts stay connected. Each move makes one node fewer that is
    alone, so this ends without a bound on the rounds.
    """
    spark, old = e.sparkSession, []
    a, b = com.select(F.col("id").alias("src"), F.col("com").alias("x")), com.select(F.col("id").alias("dst"), F.col("com").alias("y"))
    inner = cut(e.where("src <> dst").join(a, "src").join(b, "dst").where("x = y").select("src", "dst", "w"), old)
    whole = com.groupBy("com").agg(F.sum("d").alias("ds"))
    linked = inner.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("_w"))
    well = F.coalesce("_w", F.lit(0.0)) >= F.col("d") * (F.col("ds") - F.col("d")) - 1e-15
    state = cut(com.join(whole, "com").join(linked, "id", "left").select("id", "com", "d", "ds", well.alias("ok"), F.col("id").alias("fine")), old)
    i = 0
    while True:
        i += 1
        turn = lambda x: F.pmod(F.xxhash64(x, F.lit(i)), F.lit(2)) == 0  # noqa: B023, E731
        sizes = state.groupBy(F.col("fine").alias("c")).agg(F.count("*").alias("n"), F.sum("d").alias("tot"), F.max("ds").alias("ds"))
        mine = state.join(sizes.select(F.col("c").alias("fine"), (F.col("n") == 1).alias("alone")), "fine").select("id", "fine", "d", "ok", "alone")
        links = inner.join(state.select(F.col("id").alias("dst"), F.col("fine").alias("c")), "dst").groupBy(F.col("src").alias("id"), "c").agg(F.sum("w").alias("w"))
        links = links.join(mine, "id").where("c <> fine")
        out = links.groupBy("c").agg(F.sum("w").alias("out"))
        to = sizes.join(out, "c").where("out >= tot * (ds - tot) - 1e-15").select("c", "n", "tot")
        could = cut(links.where("alone AND ok").join(to, "c").withColumn("g", F.round(F.col("w") - F.col("tot") * F.col("d"), 12)).where("g > 0"), old)
        if could.isEmpty():
            done = cut(state.select("id", "com", "fine"))
            discard(spark, old)
            return done
        take = could.where(turn("id") & ~((F.col("n") == 1) & turn("c"))).groupBy("id").agg(F.min(F.struct((-F.col("g")).alias("less"), "c")).alias("b"))
        state = cut(state.join(take, "id", "left").select("id", "com", "d", "ds", "ok", F.coalesce("b.c", "fine").alias("fine")), old)


def leiden(edges: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """(id, community): modularity communities by Leiden's method: two partitions at once, the coarse one of moves and a fine one within it.

    A level moves nodes until modularity settles, refines each community into well-linked connected parts, and goes on with these parts as
    nodes, which start in the coarse communities; so a later level may take a community apart again, as Louvain's can't. Levels
    end when parts are no fewer than nodes. Communities are connected. All nodes move at once by joins; nothing is gathered in a task or the
    driver but a round's score. No edges give no rows; loops, repeated and reversed edges count as ``undirected`` has them.
    """
    old: list[str] = []
    spark = edges.sparkSession
    e = cut(undirected(edges).select("src", "dst", F.lit(1.0).alias("w")), old)
    m2 = e.agg(F.sum("w")).first()[0] or 1.0
    e = cut(e.withColumn("w", F.col("w") / m2), old)
    member = cut(e.select(F.col("src").alias("id")).distinct().withColumn("node", F.col("id")), old)
    begin = member.select("id", F.col("id").alias("com"))
    while True:
        own = F.sum(F.when(F.col("src") == F.col("dst"), F.col("w")).otherwise(0.0))
        nodes = cut(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d"), own.alias("own")).join(begin, "id"), old)
        com = _settled(e, nodes, tolerance)
        fine = _refined(e, com)
        if fine.select("fine").distinct().count() == nodes.count():
            break
        low = fine.groupBy("com").agg(F.min("fine").alias("low"))
        begin = cut(fine.join(low, "com").select(F.col("fine").alias("id"), F.col("low").alias("com")).distinct(), old)
        member = cut(member.join(fine.select(F.col("id").alias("node"), "fine"), "node").select("id", F.col("fine").alias("node")), old)
        a, b = fine.select(F.col("id").alias("src"), F.col("fine").alias("x")), fine.select(F.col("id").alias("dst"), F.col("fine").alias("y"))
        e = cut(e.join(a, "src").join(b, "dst").groupBy(F.col("x").alias("src"), F.col("y").alias("dst")).agg(F.sum("w").alias("w")), old)
    a, b = com.select(F.col("id").alias("src"), F.col("com").alias("x")), com.select(F.col("id").alias("dst"), F.col("com").alias("y"))
    inside = e.join(a, "src").join(b, "dst").where("x = y").select("src", "dst")
    parts = components(inside, com.select("id")).select(F.col("id").alias("node"), "component")  # moves alone might leave a part unlinked
    label = member.join(parts, "node").select("id", "component")
    out = cut(label.join(label.groupBy("component").agg(F.min("id").alias("community")), "component").select("id", "community"))
    discard(spark, old)
    return out


def infomap(edges: DataFrame, rounds: int = 6, levels: int = 5) -> DataFrame:
    """(id, community): communities that shorten the description of a random walk: greedy moves by the two-level map equation.

    On an undirected graph a node is visited in proportion to its degree, so what a move changes of the equation are the terms of the
    node, of the community that it joins and of the exits in all.
    """

    def gain(w: Column, d: Column, own: Column, tot: Column, out: Column, every: Column) -> Column:
        plogp = lambda x: F.when(x > 1e-15, x * F.log2(x)).otherwise(0.0)
        alone, joined = d - own, F.greatest(F.lit(0.0), out + d - own - 2 * w)  # exits of the node, and of both together
        before = plogp(every) - 2 * plogp(out) + plogp(out + tot) - 2 * plogp(alone) + plogp(alone + d)
        after = plogp(F.greatest(F.lit(0.0), every + joined - out - alone)) - 2 * plogp(joined) + plogp(joined + tot + d)
        return before - after

    return _levels(edges, gain, rounds, levels)
