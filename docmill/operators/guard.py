"""Guards for text that users send: conditions and read-only SQL."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WORD = re.compile(r"'[^']*'|[A-Za-z_][\w.]*|\d+(?:\.\d+)?|[<>=!]=|[<>=()]|&&|\|\||!|\s+|,")
_ALLOWED = {"and", "or", "not", "true", "false", "null", "is", "in"}
#: Functions that a query text may call; all others are refused, as some reach files, classes or the session.
FUNCTIONS = frozenset("abs avg case cast ceil coalesce concat count date_trunc day exists filter first floor greatest if in lag last lead least length lower ltrim max min month nullif over rank dense_rank row_number regexp_extract regexp_like replace round rtrim split_part sqrt substr substring sum trim upper values year and or not on by as from where select when then else union all distinct having join using with limit order partition between like interval".split())
_BANNED = re.compile(r"(?i)\b(insert|update|delete|merge|drop|create|alter|truncate|grant|revoke|load|call|set|reset|cache|uncache|refresh|add|use|export|import|msck|analyze)\b")


def condition(expression: str, columns: list[str]) -> Column:
    """A boolean expression over dotted paths of known columns; anything else is refused."""
    out, at = [], 0
    while at < len(expression):
        m = _WORD.match(expression, at)
        if not m:
            raise ValueError(f"not allowed in a condition: {expression[at:at + 10]!r}")
        word, at = m[0], m.end()
        if re.match(r"[A-Za-z_]", word) and word.lower() not in _ALLOWED and word.split(".")[0] not in columns:
            raise ValueError(f"unknown name {word!r}")
        out.append({"&&": "AND", "||": "OR", "!": "NOT ", "==": "="}.get(word, word))
    return F.expr("".join(out))


def read_only_sql(spark: SparkSession, text: str, limit: int = 1000, most: int = 10_000, **args) -> DataFrame:
    """Runs one SELECT over registered views; a statement of any other kind, a function outside ``FUNCTIONS`` and a table named by its
    path are refused, and a limit is put on the result."""
    bare = re.sub(r"'[^']*'", "''", text).strip().rstrip(";")
    odd = {f.lower() for f in re.findall(r"([A-Za-z_]\w*)\s*\(", bare)} - FUNCTIONS - {t.lower() for t in re.findall(r"(?i)\b([A-Za-z_]\w*)\s+as\s*\(", bare)}
    if odd or "`" in bare or re.search(r"(?i)\b(?:from|join)\s+\w+\s*\.", bare):
        raise ValueError(f"not allowed in a query: {', '.join(sorted(odd)) or 'a table by its path'}")
    if len(text) > 100_000 or ";" in bare or not re.match(r"(?i)(select|with)\b", bare) or _BANNED.search(bare):
        raise ValueError("only one read-only statement is allowed")
    return spark.sql(text.strip().rstrip(";"), args=args or None).limit(min(limit, most))


def complexity(text: str) -> int:
    """A rough cost of a query text by its clauses (fixed points a clause)."""
    n = lambda p: len(re.findall(p, text, re.I))
    score = min(30, 5 * n(r"\bjoin\b")) + 3 * n(r"\bwhere\b|\bfilter\b") + 4 * n(r"\bleft\b|\boptional\b") + 5 * n(r"\bunion\b") + 10 * max(0, n(r"\bselect\b") - 1)
    return score + 15 * bool(n(r"\bgroup by\b|count\(|sum\(|avg\(")) + 10 * bool(n(r"\border by\b") and not n(r"\blimit\b")) + 8 * n(r"\bdistinct\b")


def match(nodes: DataFrame, edges: DataFrame, path: list[tuple[str, str, str | None]], most: int = 10_000) -> DataFrame:
    """A path pattern over nodes (id, label, properties) and edges (src, dst, type): one struct column for each named node.

    ``path``: (name, label, type of the edge to the next node or None at the end), as in ``(a:Nation)-[:PART_OF]->(b:Region)``.
    Each step is an equi-join; a result of more than ``most`` rows is cut, as a query endpoint does.
    """
    out = None
    for i, (name, label, _) in enumerate(path):
        node = nodes.where(F.col("label") == label).select(F.struct(*nodes.columns).alias(name), F.col("id").alias(f"_{name}"))
        if out is None:
            out = node
            continue
        before, _, kind = path[i - 1]
        step = edges.where(F.col("type") == kind).select(F.col("src").alias(f"_{before}"), F.col("dst").alias(f"_{name}"))
        out = out.join(step, f"_{before}").join(node, f"_{name}")
    return out.select(*(name for name, _, _ in path)).limit(most)


def patterns(triples: DataFrame, wanted: list[tuple[str, str, str]], optional: list[tuple[str, str, str]] = (), most: int = 10_000) -> DataFrame:
    """Bindings of the variables (terms led by ?) that fit every pattern (s, p, o) over triples (s, p, o); ``optional`` patterns may
    leave theirs null. Patterns join on the variables they share; one that shares none with those before it is refused."""

    def one(p: tuple[str, str, str]) -> DataFrame:
        rows = triples
        for c, term in zip("spo", p, strict=True):
            if not term.startswith("?"):
                rows = rows.where(F.col(c) == term)
        return rows.select(*(F.col(c).alias(term[1:]) for c, term in zip("spo", p, strict=True) if term.startswith("?")))

    out = None
    for p, how in [(p, "inner") for p in wanted] + [(p, "left") for p in optional]:
        rows = one(p)
        if out is None:
            out = rows
            continue
        shared = [c for c in rows.columns if c in out.columns]
        if not shared:
            raise ValueError(f"{p} shares no variable with the patterns before it")
        out = out.join(rows, shared, how)
    return out.limit(most)
