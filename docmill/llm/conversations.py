"""Conversation structure repair by error-correcting Earley parsing.

A conversation's turns are read as tokens: the initial of the role and the first fault (blank, duplicate, truncated). The grammar of role
initials, ``(s?(ua)+)?``, is right-linear here, so that an Earley chart has a handful of items a position:

    START -> e | s SYSTEM | u USER      SYSTEM -> u USER      USER -> a PAIR      PAIR -> e | u USER

Error productions widen it, each with a cost and the letter of its edit: K keeps a token as its terminal, R takes another token for the terminal u or
a, D skips a token and stays, I goes on without a token. The chart is filled from the last token to the first; an item ``(symbol, position)``
holds the least (cost, audit) of the rest. From one symbol the four edits have different letters, so cost and letter alone settle
ties, and an item needs only its cost, its letter and what it goes to. The completed chart's start item yields the repair.

A conversation may hold a third of all rows, so it is parsed in blocks of ``BLOCK`` tokens: a block's chart is completed once for each symbol it may end in, which gives
a table symbol -> symbol of costs; tables are combined upward in groups until a conversation has one, and the symbols at the blocks' borders are read
downward. Edits before a token belong to its block and those after the last token to the end, so that audits of one block are never a
prefix of each other, and comparing them block by block is comparing the whole. Equal blocks are parsed once a task.

Only the rows in order of their conversation (``replay``, and its digest, which is by nature one pass) stream through one task a conversation,
in constant memory but for the audit, which is part of the result.

Defined cases: nulls in role and text, and in the damage's key, are one space; a null turn comes first; turns that tie are ordered by role and by a digest
of the text; a null conv_id is a conversation; an empty role has the initial of no role; repeated rows are duplicates; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docmill.llm import common

BLOCK = 4096
_FAN = 256
#: Symbols of the grammar, the terminals each may read and what follows, and the symbols a conversation may end in.
START, SYSTEM, USER, PAIR = range(4)
READS: dict[int, dict[str, int]] = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": PAIR}, PAIR: {"u": USER}}
ENDS = (START, PAIR)
ROLES = {"u": "user", "a": "assistant"}
#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Tokens: s, u, a or x (another initial), and the fault; a token is a letter in the order of both.
INITIALS, FAULTS = "suax", ("", "blank", "duplicate", "truncated")
_A = ord("A")
_FAR = 1 << 60


def token(role: Column, fault: Column) -> Column:
    """The letter of a turn: A to P, initials in fours of the faults 0 to 3."""
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return F.char(F.lit(_A) + initial * 4 + fault)


def productions(symbol: int, letter: str) -> list[tuple[int, str, int]]:
    """(cost, edit, next symbol) of the ways in which ``symbol`` reads a token."""
    initial, fault = INITIALS[(ord(letter) - _A) // 4], (ord(letter) - _A) % 4
    out = [(DELETE, "D", symbol)]
    if fault in (1, 2):
        return out
    more = TRUNCATED if fault == 3 else 0
    for terminal, goes in READS[symbol].items():
        if terminal == initial:
            out.append((more, "K", goes))
        elif terminal in ROLES:
            out.append((REROLE + more, "R", goes))
    return out


def insertions(symbol: int) -> list[tuple[int, int]]:
    """(cost, next symbol) of the ways in which ``symbol`` goes on without a token."""
    return [(INSERT, goes) for terminal, goes in READS[symbol].items() if terminal in ROLES]


class Chart:
    """The completed chart of the tokens ``text``: items[position][symbol] = (cost, edit, next position, next symbol).

    ``ends``: the cost of each symbol after the last token. Whether edits may stand after it is the caller's choice (``tail``).
    """

    def __init__(self, text: str, ends: dict[int, int], tail: bool):
        self.text, n = text, len(text)
        last = {s: (c, "", n, s) for s, c in ends.items()}
        if tail:
            self._inserts(last, n)
        self.items = [last]
        for i in range(n - 1, -1, -1):
            after, here = self.items[-1], {}
            for symbol in READS:  # scan
                for cost, edit, goes in productions(symbol, text[i]):
                    if goes in after:
                        self._keep(here, symbol, (cost + after[goes][0], edit, i + 1, goes))
            self._inserts(here, i)
            self.items.append(here)
        self.items.reverse()

    @staticmethod
    def _keep(here: dict, symbol: int, item: tuple[int, str, int, int]) -> bool:
        if symbol in here and here[symbol][:2] <= item[:2]:
            return False
        here[symbol] = item
        return True

    def _inserts(self, here: dict, i: int) -> None:
        """Predicted symbols that need no token, until nothing gets cheaper."""
        agenda = list(here)
        while agenda:
            goes = agenda.pop()
            for symbol in READS:
                for cost, to in insertions(symbol):
                    if to == goes and self._keep(here, symbol, (cost + here[goes][0], "I", i, goes)):
                        agenda.append(symbol)

    def read(self, symbol: int) -> tuple[int, str, int]:
        """(cost, audit, last symbol) of the best completion from ``symbol`` at the first token."""
        cost, out, i = self.items[0][symbol][0], [], 0
        while self.items[i][symbol][1]:
            _, edit, i, symbol = self.items[i][symbol]
            out.append(edit)
        return cost, "".join(out), symbol


@lru_cache(20_000)
def parse(text: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    cost, audit, _ = Chart(text, dict.fromkeys(ENDS, 0), True).read(START)
    return cost, audit


@lru_cache(2_000)
def table(text: str) -> list[list[int]]:
    """[symbol][end symbol] = cost * 4 + place of the audit among those of the symbol's ends, or a large number."""
    rows: list[list[tuple[int, str, int]]] = [[] for _ in READS]
    for end in READS:
        chart = Chart(text, {end: 0}, False)
        for s in chart.items[0]:
            cost, audit, _ = chart.read(s)
            rows[s].append((cost, audit, end))
    out = []
    for found in rows:
        place = {audit: k for k, audit in enumerate(sorted(a for _, a, _ in found))}
        out.append([_FAR] * 4)
        for cost, audit, end in found:
            out[-1][end] = cost * 4 + place[audit]
    return out


def chain(tables: list[list[list[int]]]) -> tuple[list[list[int]], list[dict[tuple[int, int], int]]]:
    """(the table of the tables in a row, for each table the symbol after it by first symbol and end symbol of the whole)."""
    whole = tables[-1]
    after: list[dict[tuple[int, int], int]] = [{(s, t): t for s in READS for t in READS if whole[s][t] < _FAR}]
    for one in reversed(tables[:-1]):
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for s in READS:
            for m in READS:
                for t in READS:
                    if one[s][m] < _FAR and whole[m][t] < _FAR:
                        item = (one[s][m] // 4 + whole[m][t] // 4, one[s][m] % 4, whole[m][t] % 4, m)
                        if (s, t) not in best or item < best[s, t]:
                            best[s, t] = item
        whole = [[_FAR] * 4 for _ in READS]
        for s in READS:
            ends = sorted((item[1], item[2], t) for (x, t), item in best.items() if x == s)
            for place, (_, _, t) in enumerate(ends):
                whole[s][t] = best[s, t][0] * 4 + place
        after.append({k: item[3] for k, item in best.items()})
    return whole, after[::-1]


def last_symbol(whole: list[list[int]]) -> int:
    """The symbol after the last block of the best repair from START, given what its end costs."""
    rest = {s: item[0] for s, item in Chart("", dict.fromkeys(ENDS, 0), True).items[0].items()}
    return min((x // 4 + rest[t], x % 4, t) for t, x in enumerate(whole[START]) if x < _FAR)[2]


def damage(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) with faults planted by a hash of conversation and turn: a row in 20 each dropped, emptied,
    stripped of full stops, repeated, or given the role user."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    what = F.crc32(F.encode(key, "UTF-8")) % 20
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), what.alias("_what")).where("_what <> 0")
    out = out.withColumn("text", F.when(F.col("_what") == 1, "").when(F.col("_what") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    out = out.withColumn("role", F.when(F.col("_what") == 4, "user").otherwise(F.col("role")))
    return out.select("conv_id", "turn", "role", "text", F.explode(F.when(F.col("_what") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")).drop("_copy")


def _turns(rows: DataFrame) -> DataFrame:
    """``rows`` with _h, a digest of the text; nulls in role and text as one space."""
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")).withColumn("_h", F.unhex(F.sha2("text", 256)))


_ORDER = ["conv_id", "turn", "role", "_h"]


def _tokens(rows: DataFrame, done: list[str]) -> DataFrame:
    """(conv_id, turn, token, _pid, _idx): each turn's token and place in the order of conversations; texts themselves aren't shuffled."""
    spark = rows.sparkSession
    last = F.substring(F.rtrim("text", F.lit(common.SPACE)), -1, 1)
    fault = F.when(last == "", 1).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    short = common.written(_turns(rows).select("conv_id", "turn", "role", "_h", fault.alias("_f")), "conv-turns", drop=done)
    n = common.partitions_for(spark, short.count(), 1 << 20)
    put = common.ordered(short, [F.col(c) for c in _ORDER], n, "conv-order", drop=done)
    at = F.shiftleft(F.col("_pid").cast("long"), 40) + F.col("_idx")
    once = put.where("_f <> 1").groupBy("conv_id", "role", "_h").agg(F.min(at).alias("_first"), F.count("*").alias("_c")).where("_c > 1")
    once = once.select(F.col("conv_id").alias("_c0"), F.col("role").alias("_r0"), F.col("_h").alias("_h0"), "_first")
    both = put.join(once, F.col("conv_id").eqNullSafe(F.col("_c0")) & (F.col("role") == F.col("_r0")) & (F.col("_h") == F.col("_h0")) & (F.col("_f") != 1), "left")
    return both.select("conv_id", "turn", token(F.col("role"), F.when(F.col("_first") != at, 2).otherwise(F.col("_f"))).alias("token"), "_pid", "_idx")


def _blocks(tokens: DataFrame) -> DataFrame:
    """(conv_id, block, tokens): a conversation's tokens in stretches of at most ``BLOCK``, numbered from 0."""
    cut = tokens.groupBy("conv_id", "_pid", F.floor(F.col("_idx") / BLOCK).alias("_b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_idx", "token"))), lambda x: x["token"]), "").alias("tokens"))
    # one row for each stretch of a conversation
    return cut.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("_pid", "_b")) - 1).cast("long").alias("block"), "tokens")


def _string(t: list[list[int]]) -> str:
    return ",".join(str(x) for row in t for x in row)


def _rows_of(text: str) -> list[list[int]]:
    flat = [int(x) for x in text.split(",")]
    return [flat[i : i + 4] for i in range(0, 16, 4)]


def _parsed(tokens: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in tokens], columns=["cost", "audit"])


def _tabled(tokens: pd.Series) -> pd.Series:
    return tokens.map(lambda t: _string(table(t)))


def _chained(tables: pd.Series) -> pd.Series:
    return tables.map(lambda ts: _string(chain([_rows_of(t) for t in ts])[0]))


def _ending(whole: pd.Series) -> pd.Series:
    return whole.map(lambda t: last_symbol(_rows_of(t)))


def _borders(blocks: pd.Series, tables: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    out = []
    for bs, ts, s, t in zip(blocks, tables, first, last, strict=True):
        row = []
        for b, after in zip(bs, chain([_rows_of(x) for x in ts])[1], strict=True):
            row.append({"_block": int(b), "_from": int(s), "_to": after[int(s), int(t)]})
            s = row[-1]["_to"]
        out.append(row)
    return pd.Series(out)


def _block_parsed(tokens: pd.Series, first: pd.Series, last: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([Chart(x, {int(t): 0}, False).read(int(s))[:2] for x, s, t in zip(tokens, first, last, strict=True)], columns=["cost", "audit"])


def _grouped(level: DataFrame, own: str) -> DataFrame:
    """A level's tables in groups of ``_FAN``: (conv_id, block of the next level, blocks, tables in order)."""
    got = level.groupBy("conv_id", F.expr(f"block div {_FAN}").alias("_up")).agg(F.array_sort(F.collect_list(F.struct("block", own))).alias("_l"))
    return got.select("conv_id", "_up", F.col("_l.block").alias("_blocks"), F.col(f"_l.{own}").alias("_tables"))


def _long(blocks: DataFrame, done: list[str]) -> DataFrame:
    """(conv_id, block, cost, audit) of conversations of several blocks: tables upward, symbols downward, then each block's audit."""
    levels = [common.written(blocks.select("conv_id", "block", F.pandas_udf(_tabled, "string")("tokens").alias("table")), "conv-level", drop=done)]
    groups = []
    while True:
        groups.append(common.written(_grouped(levels[-1], "table"), "conv-groups", drop=done))
        levels.append(common.written(groups[-1].select("conv_id", F.col("_up").alias("block"), F.pandas_udf(_chained, "string")("_tables").alias("table")), "conv-level", drop=done))
        if not levels[-1].where("block > 0").limit(1).count():
            break
    known = levels[-1].select("conv_id", "block", F.lit(START).alias("_from"), F.pandas_udf(_ending, "long")("table").cast("int").alias("_to"))
    for g in reversed(groups):
        k = known.select(F.col("conv_id").alias("_c"), F.col("block").alias("_k"), "_from", "_to")
        at = g.join(k, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_up") == F.col("_k")))
        at = at.select("conv_id", F.explode(F.pandas_udf(_borders, "array<struct<_block:long,_from:int,_to:int>>")("_blocks", "_tables", "_from", "_to")).alias("_x"))
        known = common.written(at.select("conv_id", F.col("_x._block").alias("block"), "_x._from", "_x._to"), "conv-borders", drop=done)
    k = known.select(F.col("conv_id").alias("_c"), F.col("block").alias("_k"), "_from", "_to")
    own = blocks.join(k, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_k")))
    got = own.select("conv_id", "block", "_to", F.pandas_udf(_block_parsed, "cost long, audit string")("tokens", "_from", "_to").alias("_p"))
    # what follows the last token: one or two insertions where a pair is open
    rest = {s: Chart("", dict.fromkeys(ENDS, 0), True).read(s)[:2] for s in READS}
    ends = F.array(*(F.struct(F.lit(c).cast("long").alias("cost"), F.lit(a).alias("audit")) for _, (c, a) in sorted(rest.items())))
    last = got.withColumn("_last", F.max("block").over(Window.partitionBy("conv_id")) == F.col("block")).withColumn("_e", ends[F.col("_to")])
    extra = lambda k, none: F.when(F.col("_last"), F.col(f"_e.{k}")).otherwise(none)
    return last.select("conv_id", "block", (F.col("_p.cost") + extra("cost", 0)).alias("cost"), F.concat("_p.audit", extra("audit", "")).alias("audit"))


def _with_fault(k: int) -> str:
    return "".join(chr(_A + 4 * i + k) for i in range(len(INITIALS)))


def repairs(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows."""
    done: list[str] = []
    tokens = common.written(_tokens(rows, done), "conv-tokens")
    common.remove(rows.sparkSession, done)
    blocks = common.written(_blocks(tokens), "conv-blocks")
    # a pair of neighbours is looked at in its first turn's block, with the next block's first token at hand
    after = F.coalesce(F.substring(F.lead("tokens").over(Window.partitionBy("conv_id").orderBy("block")), 1, 1), F.lit(""))
    near = F.translate(F.concat("tokens", after), "".join(map(chr, range(_A, _A + 16))), "".join(4 * i for i in INITIALS))
    own = blocks.select("conv_id", "tokens", near.alias("_near"))
    illegal = F.length("_near") - 1 - F.regexp_count("_near", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    facts = own.groupBy("conv_id").agg(*(F.sum(F.regexp_count("tokens", F.lit(f"[{_with_fault(k)}]"))).alias(FAULTS[k]) for k in (1, 2, 3)), F.sum(illegal).alias("illegal"))
    turns = tokens.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"))
    many = blocks.where("block > 0").select("conv_id").distinct()
    if many.limit(1).count():
        m = many.select(F.col("conv_id").alias("_c"))
        of = F.col("conv_id").eqNullSafe(F.col("_c"))
        long = common.written(_long(common.written(blocks.join(m, of, "left_semi"), "conv-long", drop=done), done), "conv-audits")
        common.remove(rows.sparkSession, done)
        single = blocks.join(m, of, "left_anti")
        parts = long.groupBy("conv_id").agg(F.sum("cost").alias("cost"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    else:
        single, parts = blocks, None
    found = single.select("conv_id", F.pandas_udf(_parsed, "cost long, audit string")("tokens").alias("_p")).select("conv_id", "_p.cost", "_p.audit")
    found = found if parts is None else found.unionByName(parts)
    for other in (facts, turns):
        other = other.select(*(F.col(c).alias("_c" if c == "conv_id" else c) for c in other.columns))
        found = found.join(other, F.col("conv_id").eqNullSafe(F.col("_c"))).drop("_c")
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


def replay(rows: DataFrame, audits: DataFrame, digest: bool = False) -> DataFrame:
    """The repaired turns (conv_id, place, turn, role, text, edit: K, R or I) by ``audits`` (conv_id, audit); with ``digest`` instead
    (conv_id, repaired_sha256) of ``role:text`` joined by new lines.

    Turns stream through in order, the conversation's audit first.
    """
    common.small_batches(rows.sparkSession)
    empty = F.lit(None)
    turns = _turns(rows).select("conv_id", F.lit(1).alias("_kind"), "turn", "role", "text", "_h")
    heads = audits.select("conv_id", F.lit(0).alias("_kind"), empty.cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), empty.cast("binary").alias("_h"))
    dealt = turns.unionByName(heads).repartition("conv_id")
    dealt = dealt.sortWithinPartitions("conv_id", "_kind", "turn", "role", "_h").select("conv_id", "_kind", "turn", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(conversation, turn, role, text, edit) of each repaired turn; edit is empty at a conversation's end."""
        audit, at, symbol, conv, begun = "", 0, START, None, False

        def inserted() -> Iterator[tuple]:
            nonlocal at, symbol
            while at < len(audit) and audit[at] == "I":
                terminal = next(t for t in READS[symbol] if t in ROLES)
                at, symbol = at + 1, READS[symbol][terminal]
                yield conv, None, ROLES[terminal], "", "I"

        for b in batches:
            for c, kind, turn, role, text in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if not kind:
                    if begun:
                        yield from inserted()
                        yield conv, None, "", "", ""
                    audit, at, symbol, conv, begun = text, 0, START, c, True
                    continue
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                terminal = role[:1] if edit == "K" else next(t for t in READS[symbol] if t in ROLES)
                symbol = READS[symbol][terminal]
                yield conv, turn, role if edit == "K" else ROLES[terminal], text, edit
        if begun:
            yield from inserted()
            yield conv, None, "", "", ""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, first, out = hashlib.sha256(), True, ([], [])
        for conv, _, role, text, edit in walk(batches):
            if edit:
                h.update(f"{'' if first else '\n'}{role}:{text}".encode())
                first = False
                continue
            out[0].append(conv)
            out[1].append(h.hexdigest())
            h, first = hashlib.sha256(), True
            if len(out[0]) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["conv_id", "repaired_sha256"])
                out = ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string())], ["conv_id", "repaired_sha256"])

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["conv_id", "place", "turn", "role", "text", "edit"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        out, held, place = [], 0, 0
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)
        for conv, turn, role, text, edit in walk(batches):
            if not edit:
                place = 0
                continue
            out.append((conv, place, turn, role, text, edit))
            place, held = place + 1, held + len(text)
            if len(out) >= 2000 or held > 4 << 20:
                yield flush()
                out, held = [], 0
        yield flush()

    if digest:
        return dealt.mapInArrow(hashes, "conv_id long, repaired_sha256 string")
    return dealt.mapInArrow(messages, "conv_id long, place long, turn long, role string, text string, edit string")


def summary(rows: DataFrame, of: DataFrame) -> DataFrame:
    """One row for each conv_id of ``of``: what was found in ``rows`` and its cheapest repair; zeros where it has no rows."""
    found = common.written(repairs(rows), "conv-found")
    texts = replay(rows, found.select("conv_id", "audit"), digest=True).select(F.col("conv_id").alias("_d"), "repaired_sha256")
    found = found.select(*(F.col(c).alias("_c" if c == "conv_id" else c) for c in found.columns))
    out = of.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_d")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
