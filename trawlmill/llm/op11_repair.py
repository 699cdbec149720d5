"""Repair of the role structure of conversations by generalised LR parsing.

Method: the allowed sequences of role initials are a grammar, (s?(ua)+)?, from whose productions an LR table is built.  The
parser reads a conversation row by row with a graph-structured stack: nodes (state, node below) are shared between stacks, and
each stack top holds the least (cost, audit) of the edits that lead to it.  On a row every top is kept (delete), or the row is
shifted as it is (keep) or as user or assistant (rerole); between rows a user or assistant may be shifted (insert).  Where two
edits end in the same stack, the lesser (cost, audit) stays.  Two audits of the same rows at the same cost are never one the
beginning of the other, so the least of them stays the least whatever follows.

Conversations are cut into segments of SEGMENT_ROWS rows.  A segment is parsed from every stack that the grammar can be in, in
parallel; a conversation then only puts the tables of its segments together.  Rows are ordered by ranges, not within one task;
no conversation is held in memory, only its audit is.  The digest of a repaired conversation is one SHA-256, so its rows pass
through one task in order, as a stream.

Rows: a null in any column counts as one space (a null conversation is one of its own, null turns come first); ties of a turn go
by role, then by the MD5 of the text; equal rows are rows of their own and thereby duplicates.  A role that begins with none of
s, u, a can only be changed or deleted.  Extra columns are not read.  An empty table has no result rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trawlmill.llm.common import in_order, table

SEGMENT_ROWS = 1024
#: Segments whose tables are kept by a worker.
MEMO_SEGMENTS = 20_000
# The role grammar, costs, and the roles that edits give.
GRAMMAR = (("S", ""), ("S", "sB"), ("S", "B"), ("B", "Bua"), ("B", "ua"))
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
ROLES = {"u": "user", "a": "assistant"}
BLANKS = " \t\n\x0b\x0c\r"
LEGAL = ("su", "ua", "au")

Best = tuple[int, str]


class RoleParser:
    """LR table of a grammar and the graph-structured stack over it; node 0 is the empty stack."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.grammar = (("^", grammar[0][0]), *grammar)
        self.heads = {head for head, _ in self.grammar}
        self.follow = self._follow()
        self.states: list[frozenset] = [self._closure({(0, 0)})]
        self.nodes: list[tuple[int, int]] = [(0, -1)]
        self.ids = {(0, -1): 0}
        self.shifts: dict[tuple[int, str], tuple[int, ...]] = {}
        self.tops = [0]
        for top in self.tops:
            for terminal in sorted({c for _, body in grammar for c in body} - self.heads):
                self.tops += [t for t in self.shifted(top, terminal) if t not in self.tops]
            if len(self.tops) > 64:
                raise ValueError("a role grammar whose stacks stay below 64 is needed")
        self.accepting = {t for t in self.tops if self._accepts(t)}

    def _closure(self, items: set) -> frozenset:
        out, open_ = set(items), list(items)
        while open_:
            rule, dot = open_.pop()
            for i, (head, _) in enumerate(self.grammar):
                if self.grammar[rule][1][dot : dot + 1] == head and (i, 0) not in out:
                    out.add((i, 0))
                    open_.append((i, 0))
        return frozenset(out)

    def _follow(self) -> dict[str, set[str]]:
        """What can come after each head; no body of the grammar has a head that may be empty before its end."""
        out = {head: set() for head in self.heads}
        out["^"] = {"$"}
        first = {head: set() for head in self.heads}
        for _ in range(len(self.grammar) ** 2):
            for head, body in self.grammar:
                if body:
                    first[head] |= first[body[0]] if body[0] in self.heads else {body[0]}
                for i, c in enumerate(body):
                    if c in self.heads:
                        after = body[i + 1 : i + 2]
                        out[c] |= out[head] if not after else first[after] if after in self.heads else {after}
        return out

    def _goto(self, state: int, symbol: str) -> int | None:
        moved = {(rule, dot + 1) for rule, dot in self.states[state] if self.grammar[rule][1][dot : dot + 1] == symbol}
        if not moved:
            return None
        target = self._closure(moved)
        if target not in self.states:
            self.states.append(target)
        return self.states.index(target)

    def _pushed(self, below: int, symbol: str) -> int | None:
        state = self._goto(self.nodes[below][0], symbol)
        if state is None:
            return None
        node = (state, below)
        if node not in self.ids:
            self.ids[node] = len(self.nodes)
            self.nodes.append(node)
        return self.ids[node]

    def _reduced(self, top: int, ahead: str | None) -> list[int]:
        """Stacks after one reduction that the terminal ahead allows (any, where it is not known)."""
        out = []
        for rule, dot in self.states[self.nodes[top][0]]:
            head, body = self.grammar[rule]
            if dot == len(body) and head != "^" and (ahead is None or ahead in self.follow[head]):
                below = top
                for _ in body:
                    below = self.nodes[below][1]
                out += [n for n in [self._pushed(below, head)] if n is not None]
        return out

    def _settled(self, top: int) -> int:
        """The stack after reductions that need no look ahead: nothing but one reduction is possible."""
        items = self.states[self.nodes[top][0]]
        if len(items) == 1 and all(dot == len(self.grammar[rule][1]) > 0 for rule, dot in items):
            rule = next(iter(items))[0]
            if self.grammar[rule][0] not in ("^", self.grammar[1][0]):
                return self._settled(self._reduced(top, None)[0])
        return top

    def shifted(self, top: int, terminal: str) -> tuple[int, ...]:
        """All stacks after the terminal, with the reductions before it."""
        known = self.shifts.get((top, terminal))
        if known is None:
            stacks, out = [top], []
            for stack in stacks:
                stacks += [s for s in self._reduced(stack, terminal) if s not in stacks]
                node = self._pushed(stack, terminal)
                if node is not None:
                    out.append(self._settled(node))
            known = self.shifts[top, terminal] = tuple(dict.fromkeys(out))
        return known

    def _accepts(self, top: int) -> bool:
        stacks = [top]
        for stack in stacks:
            stacks += [s for s in self._reduced(stack, "$") if s not in stacks]
        return any((0, 1) in self.states[self.nodes[s][0]] for s in stacks)

    # --- edits ---

    def inserted(self, tops: dict[int, Best]) -> dict[int, Best]:
        """The tops and all that insertions lead to."""
        open_ = list(tops)
        while open_:
            top = open_.pop()
            cost, audit = tops[top]
            new = (cost + INSERT, audit + "I")
            for terminal in ROLES:
                for stack in self.shifted(top, terminal):
                    if stack not in tops or new < tops[stack]:
                        tops[stack] = new
                        open_.append(stack)
        return tops

    def read(self, tops: dict[int, Best], initial: str, fault: str) -> dict[int, Best]:
        """The tops after one row: its role's initial, and its fault (b, d, t or -)."""
        out: dict[int, Best] = {}

        def offer(stack: int, cost: int, audit: str) -> None:
            if stack not in out or (cost, audit) < out[stack]:
                out[stack] = (cost, audit)

        extra = TRUNCATED if fault == "t" else 0
        for top, (cost, audit) in tops.items():
            offer(top, cost + DELETE, audit + "D")
            if fault in "bd":
                continue
            for stack in self.shifted(top, initial):
                offer(stack, cost + extra, audit + "K")
            for terminal in ROLES:
                for stack in self.shifted(top, terminal):
                    offer(stack, cost + extra + REROLE, audit + "R")
        return self.inserted(out)

    def table(self, pattern: str) -> list[tuple[int, int, int, str]]:
        """(stack before, stack after, cost, audit) of a segment; the pattern has two characters for each row."""
        out = []
        for before in self.tops:
            tops: dict[int, Best] = {before: (0, "")}
            for i in range(0, len(pattern), 2):
                tops = self.read(tops, pattern[i], pattern[i + 1])
            out += [(before, after, cost, audit) for after, (cost, audit) in tops.items()]
        return out

    def placed(self, top: int, edit: str, initial: str) -> tuple[int, str]:
        """The stack after an edit that leaves a row, and the role's initial; what follows (s?(ua)+)? allows one only."""
        for terminal in [initial] if edit == "K" else ROLES:
            for stack in self.shifted(top, terminal):
                return stack, terminal
        raise ValueError("the audit is not of this conversation")


@lru_cache(maxsize=1)
def role_parser() -> RoleParser:
    return RoleParser()


@lru_cache(maxsize=MEMO_SEGMENTS)
def _table(pattern: str) -> list[tuple[int, int, int, str]]:
    return role_parser().table(pattern)


class _Audit:
    """Audits as chains of pieces, one for each segment, with a common beginning."""

    __slots__ = ("before", "piece", "cost", "stack")

    def __init__(self, before: "_Audit | None", piece: str, cost: int, stack: int):
        self.before, self.piece, self.cost, self.stack = before, piece, cost, stack

    def less(self, other: "_Audit") -> bool:
        if self.cost != other.cost:
            return self.cost < other.cost
        a, b, mine, others = self, other, [], []
        while a is not b:
            mine.append(a.piece)
            others.append(b.piece)
            a, b = a.before, b.before
        return "".join(reversed(mine)) < "".join(reversed(others))

    def chain(self) -> "list[_Audit]":
        out, at = [], self
        while at is not None:
            out.append(at)
            at = at.before
        return out[::-1]


# --- tables ---


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the planned damage of the contract."""
    key = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(key[0], F.lit(":"), key[1]).cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), kind.alias("kind"),
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
    )
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.where("kind <> 0").select("conv_id", "turn", "role", "text", copies.alias("copy")).drop("copy")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Staged: conv_id, turn, role, text, text_key, fault (b blank, t truncated, -), at (ascending in the order of the conversations)."""
    stripped = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(stripped == "", "b").when(F.substring(stripped, -1, 1).isin(".", "!", "?"), "-").otherwise("t")
    whole = rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    )
    whole = whole.select("*", F.md5(F.col("text").cast("binary")).alias("text_key"), fault.alias("fault"))
    return in_order(whole, ["conv_id", "turn", "role", "text_key"], "turns")


def _range(at: Column) -> Column:
    return F.shiftright(at, 33)


def segments(turns: DataFrame) -> DataFrame:
    """conv_id, at (of the first row), pattern, counts of the faults, and the turns' least, largest and number, for each segment."""
    same = ["conv_id", "role", "text_key"]
    often = turns.groupBy(*same).agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    on = " AND ".join(f"t.{c} <=> o.{c}" for c in same)
    marks = turns.drop("text").alias("t").join(often.alias("o"), F.expr(on), "left")
    fault = F.when(F.col("fault") == "b", "b").when(F.col("at") > F.col("first"), "d").otherwise(F.col("fault"))
    initial = F.substring("t.role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("?"), fault)
    chunk = F.floor(F.col("at").bitwiseAND((1 << 33) - 1) / SEGMENT_ROWS)
    marks = marks.select("t.conv_id", "turn", "at", _range(F.col("at")).alias("range"), chunk.alias("chunk"), code.alias("code"))
    count = [F.count_if(F.substring("code", 2, 1) == c).alias(name) for c, name in (("b", "blank"), ("d", "duplicate"), ("t", "truncated"))]
    pattern = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"]), "")
    return marks.groupBy("conv_id", "range", "chunk").agg(
        F.min("at").alias("at"), pattern.alias("pattern"), *count, F.min("turn").alias("least"), F.max("turn").alias("largest"),
        F.size(F.collect_set("turn")).cast("long").alias("turns"),
    ).drop("range", "chunk")


_TABLE = "array<struct<before:int,after:int,cost:long,audit:string>>"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: A conversation's header (kind 1: its counts and audit) and the plan of each of its segments (kind 2: audit, stack before).
_PLAN = "conv_id long, at long, kind int, piece string, stack int, counts array<long>"


def _parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    names = ("before", "after", "cost", "audit")
    for batch in batches:
        for part in (batch.slice(i, 100) for i in range(0, batch.num_rows, 100)):
            tables = [[dict(zip(names, row, strict=True)) for row in _table(p)] for p in part.column(2).to_pylist()]
            yield part.append_column("steps", pa.array(tables, kind))


def _put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments in order of conversation and place -> headers and plans."""
    parser = role_parser()
    current: list = []  # the conversation's id, once there is one
    tops: dict[int, _Audit] = {}
    starts: list[int] = []
    counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
    least = largest = last = None
    out: list[tuple] = []

    def finish() -> None:
        best = None
        for top, audit in tops.items():
            if top in parser.accepting and (best is None or audit.less(best)):
                best = audit
        chain = best.chain()
        gaps = 0 if least is None else min(largest - least + 1 - counts["turns"], (1 << 63) - 1)
        numbers = [gaps, counts["blank"], counts["duplicate"], counts["truncated"], counts["illegal"], best.cost]
        out.append((current[0], -1, 1, "".join(a.piece for a in chain), None, numbers))
        # what is inserted before the first row belongs to the first segment
        pieces = [chain[0].piece + chain[1].piece, *[a.piece for a in chain[2:]]]
        stacks = [0, *[a.stack for a in chain[1:-1]]]
        out.extend((current[0], at, 2, piece, stack, None) for at, piece, stack in zip(starts, pieces, stacks, strict=True))

    def emitted() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.int64()))
        columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "at", "kind", "piece", "stack", "counts"])

    for batch in batches:
        for row in batch.to_pylist():
            if current != [row["conv_id"]]:
                if current:
                    finish()
                    if len(out) >= 1000:
                        yield emitted()
                current, starts, least, largest, last = [row["conv_id"]], [], None, None, None
                counts = dict.fromkeys(counts, 0)
                tops = {t: _Audit(None, audit, cost, t) for t, (cost, audit) in parser.inserted({0: (0, "")}).items()}
            new: dict[int, _Audit] = {}
            for step in row["steps"]:
                before = tops.get(step["before"])
                if before is not None:
                    audit = _Audit(before, step["audit"], before.cost + step["cost"], step["after"])
                    if step["after"] not in new or audit.less(new[step["after"]]):
                        new[step["after"]] = audit
            tops = new
            starts.append(row["at"])
            for name in ("blank", "duplicate", "truncated", "turns"):
                counts[name] += row[name]
            initials = (last or "") + row["pattern"][::2]
            counts["illegal"] += sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
            last = initials[-1]
            if row["least"] is not None:
                counts["turns"] -= row["least"] == largest
                least = row["least"] if least is None else least
                largest = row["largest"]
    if current:
        finish()
    if out:
        yield emitted()


def plans(turns: DataFrame) -> DataFrame:
    """Headers and plans of the cheapest repairs of all conversations that have rows."""
    parsed = segments(turns)
    schema = f"conv_id long, at long, pattern string, blank long, duplicate long, truncated long, least long, largest long, turns long, steps {_TABLE}"
    parsed = parsed.mapInArrow(_parsed, schema)
    return parsed.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(_put_together, _PLAN)


def _stream(turns: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Headers, plans and rows of each conversation one after the other."""
    nothing = [F.lit(None).cast(k).alias(c) for c, k in (("role", "string"), ("text", "string"))]
    rows = plans(turns).select("*", *nothing)
    no_plan = [F.lit(None).cast(k).alias(c) for c, k in (("piece", "string"), ("stack", "int"), ("counts", "array<long>"))]
    rows = rows.unionByName(turns.select("conv_id", "at", F.lit(3).alias("kind"), *no_plan, "role", "text"))
    if conversations is not None:
        ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(ids.select("conv_id", F.lit(-1).cast("long").alias("at"), F.lit(0).alias("kind"), *no_plan, *nothing))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "at", "kind")


class _Replay:
    """Goes through the plans and rows of a stream and gives the repaired rows (role, text, edit)."""

    def __init__(self):
        self.parser, self.piece, self.at, self.stack = role_parser(), "", 0, 0

    def plan(self, piece: str, stack: int) -> Iterator[tuple[str, str, str]]:
        # a segment begins in the stack after the one before it; the first one's insertions come before its rows
        self.piece, self.at, self.stack = piece, 0, stack
        yield from self._insertions()

    def _insertions(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.piece) and self.piece[self.at] == "I":
            self.stack, initial = self.parser.placed(self.stack, "I", "")
            self.at += 1
            yield ROLES[initial], "", "I"

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        edit = self.piece[self.at]
        self.at += 1
        if edit != "D":
            self.stack, initial = self.parser.placed(self.stack, edit, role[:1])
            yield (role if edit == "K" else ROLES[initial]), text, edit
        yield from self._insertions()


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text, edit (Keep, Rerole, Insert) of the repaired conversations."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, place = _Replay(), 0
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["kind"] == 1:
                    place = 0
                    continue
                found = replay.plan(row["piece"], row["stack"]) if row["kind"] == 2 else replay.row(row["role"], row["text"])
                for role, text, edit in found:
                    out.append((row["conv_id"], place, role, text, edit))
                    place += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text", "edit"])

    return _stream(ordered_turns(rows), None).mapInArrow(run, "conv_id long, place long, role string, text string, edit string")


def repair_summaries(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, faults, cost, audit, repaired_sha256 for every conversation of the first table, by the rows of the second."""
    names = ["conv_id", *_COUNTS, "audit", "repaired_sha256"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, header, digest, first = _Replay(), None, hashlib.sha256(), True
        out: list[tuple] = []

        def emitted() -> pa.RecordBatch:
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if row["kind"] == 0:
                    if header is not None:
                        out.append((*header, digest.hexdigest()))
                    header, digest, first = (row["conv_id"], 0, 0, 0, 0, 0, 0, ""), hashlib.sha256(), True
                elif row["kind"] == 1:
                    header = (row["conv_id"], *row["counts"], row["piece"])
                else:
                    found = replay.plan(row["piece"], row["stack"]) if row["kind"] == 2 else replay.row(row["role"], row["text"])
                    for role, text, _ in found:
                        digest.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                        first = False
            if out:
                yield emitted()
        if header is not None:
            out.append((*header, digest.hexdigest()))
            yield emitted()

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return _stream(ordered_turns(rows), conversations).mapInArrow(run, schema)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair_summaries(conversations, damaged(conversations))
