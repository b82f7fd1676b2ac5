"""Repair of conversations: cost-to-go over turns and grammar, then a greedy walk.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``.  The state of
that grammar is the last initial.  From the last turn backwards, the least cost from
each place and state to a legal end is computed; a walk forwards then takes, of the
edits on some cheapest way, the one with the least initial: D(elete), I(nsert), K(eep),
R(erole).  In each state only one role can be inserted or given, so an initial says all.

Turns are dealt and sorted by conversation and turn over all tasks.  A conversation that
lies in one task, and isn't long, is finished there.  Others are cut into pieces of
bounded size, each with the least costs from every state before it to every one after
it; these compose backwards, and the pieces, with the costs that follow them, are walked
in order by one task, which holds one piece at a time: the digest of a conversation
can't be computed in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.arrow import prepare_workers
from tessera.plans.lineage import settle

#: Cost of a role given, of a deletion, of an insertion, and of keeping a truncated turn.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: States of the grammar: before all turns, or after a role with that initial.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
#: From each state, the state after the role that may be inserted or given.
NEXT = (USER, USER, ASSISTANT, USER)
#: From each state, the initials that may follow and the states after them.
KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL_END = (START, ASSISTANT)
LEGAL_PAIRS = {"su", "ua", "au"}
NEVER = 1 << 60
#: What is wrong with a turn, the first of these that holds.
FINE, BLANK, DUPLICATE, CUT = range(4)
SPACE = " \t\n\v\f\r"
#: Turns and characters of a piece that a task holds at most, but for one longer turn.
PIECE_TURNS, PIECE_CHARACTERS = 1 << 14, 1 << 22

LONG = (1 << 63) - 1


def faults(roles: list[str], texts: list[str], earlier: Iterable[int] = ()) -> bytearray:
    """The first fault of each turn; ``earlier`` are places of turns that are equal to
    one before these."""
    seen, again = set(), set(earlier)
    found = bytearray(len(roles))
    for k, turn in enumerate(zip(roles, texts)):
        kept = turn[1].rstrip(SPACE)
        if not kept:
            found[k] = BLANK
        elif turn in seen or k in again:
            found[k] = DUPLICATE
        elif kept[-1] not in ".!?":
            found[k] = CUT
        seen.add(turn)
    return found


def _inserted(costs: list[int]) -> tuple[int, ...]:
    """Least costs where turns may be inserted first."""
    u, a = costs[USER], costs[ASSISTANT]
    u, a = min(u, a + INSERT), min(a, u + INSERT)
    return min(costs[START], u + INSERT), min(costs[SYSTEM], u + INSERT), u, a


#: Least costs from the states after the last turn.
END = _inserted([0 if state in LEGAL_END else NEVER for state in STATES])


def costs_to_go(roles: list[str], marks: bytearray, end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The least costs from each state before each turn, and after the last."""
    after = end
    found = [after]
    for role, mark in zip(reversed(roles), reversed(marks)):
        if mark in (BLANK, DUPLICATE):
            now = [c + DELETE for c in after]
        else:
            initial, more = role[:1], TRUNCATED if mark == CUT else 0
            now = []
            for state in STATES:
                least = min(after[state] + DELETE, after[NEXT[state]] + REROLE + more)
                kept = KEEP[state].get(initial)
                now.append(least if kept is None else min(least, after[kept] + more))
        after = _inserted(now)
        found.append(after)
    found.reverse()
    return found


def transfer(roles: list[str], marks: bytearray) -> list[int]:
    """The least cost from each state before these turns to each one after them."""
    columns = [costs_to_go(roles, marks, tuple(0 if s == to else NEVER for s in STATES))[0] for to in STATES]
    return [min(columns[to][state], NEVER) for state in STATES for to in STATES]


class Walk:
    """Edits of a conversation, piece by piece, and what they leave."""

    def __init__(self):
        self.state, self.edits, self.kept = START, [], []

    def take(self, roles: list[str], texts: list[str], marks: bytearray, end: tuple[int, ...]) -> int:
        """Walk over some turns, given the costs after them; what that costs."""
        costs = costs_to_go(roles, marks, end)
        begun = costs[0][self.state]
        for k, (role, text) in enumerate(zip(roles, texts)):
            after, more = costs[k + 1], TRUNCATED if marks[k] == CUT else 0
            while True:
                state, now = self.state, costs[k][self.state]
                if after[state] + DELETE == now:
                    self.edits.append("D")
                    break
                if costs[k][NEXT[state]] + INSERT == now:
                    self._insert()
                    continue
                kept = KEEP[state].get(role[:1])
                if kept is not None and after[kept] + more == now:
                    self.edits.append("K")
                    self.state = kept
                    self.kept.append((role, text))
                else:
                    self.edits.append("R")
                    self.state = NEXT[state]
                    self.kept.append((ROLES[self.state], text))
                break
        return begun - costs[-1][self.state]

    def _insert(self) -> None:
        self.edits.append("I")
        self.state = NEXT[self.state]
        self.kept.append((ROLES[self.state], ""))

    def close(self) -> int:
        """Insert what is lacking at the end; what that costs."""
        cost = END[self.state]
        while self.state not in LEGAL_END:
            self._insert()
        return cost


class Summary:
    """All that is counted of a conversation, piece by piece."""

    def __init__(self):
        self.walk, self.cost, self.illegal, self.counts, self.last_role = Walk(), 0, 0, [0] * 4, None
        self.distinct, self.least, self.most = 0, None, None
        self.edits, self.digest, self.lines = [], sha256(), 0

    def take(self, turns: list[int | None], roles: list[str], texts: list[str], marks: bytearray, end: tuple[int, ...]) -> list[tuple[str, str]]:
        """Further turns, in order; those that the walk leaves."""
        self.cost += self.walk.take(roles, texts, marks, end)
        for mark in marks:
            self.counts[mark] += 1
        for role in roles:
            if self.last_role is not None and self.last_role[:1] + role[:1] not in LEGAL_PAIRS:
                self.illegal += 1
            self.last_role = role
        for turn in turns:
            if turn is not None and (self.most is None or turn != self.most):
                self.distinct += 1
                self.least = turn if self.least is None else self.least
                self.most = turn
        return self._flush()

    def _flush(self) -> list[tuple[str, str]]:
        left, self.walk.kept = self.walk.kept, []
        for role, text in left:
            self.digest.update((f"\n{role}:{text}" if self.lines else f"{role}:{text}").encode())
            self.lines += 1
        self.edits.append("".join(self.walk.edits))
        self.walk.edits = []
        return left

    def close(self) -> list[tuple[str, str]]:
        self.cost += self.walk.close()
        return self._flush()

    def row(self) -> tuple:
        gaps = min(self.most - self.least + 1 - self.distinct, LONG) if self.distinct else 0
        return gaps, self.counts[BLANK], self.counts[DUPLICATE], self.counts[CUT], self.illegal, self.cost, "".join(self.edits), self.digest.hexdigest()


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
LEFT = "place long, roles array<string>, texts array<string>"
PIECE = "seq long, turns array<long>, piece_roles array<string>, piece_texts array<string>, keys array<string>"


class _Rows:
    """Rows gathered into batches of bounded size."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.size = schema, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 200
        if self.size > PIECE_CHARACTERS:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*self.rows), self.schema)], schema=self.schema)
        self.rows, self.size = [], 0


def _schema(key: pa.DataType, *parts: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    named = [p.strip().split(" ") for p in ", ".join(parts).split(", ")]
    return pa.schema([("key", key), *[(name, kinds[kind]) for name, kind in named]])


def _pieces(turns_wanted: bool) -> Callable:
    """Sorted turns of a task to conversations that end in it, and pieces of others."""
    done = LEFT if turns_wanted else SUMMARY
    blanks = (None,) * len(done.split(", "))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        pieces, out, edge = 0, None, True  # edge: the conversation may have begun before
        key, turns, roles, texts, size, begun = None, [], [], [], 0, False

        def finished() -> Iterator[pa.RecordBatch]:
            summary = Summary()
            left = summary.take(turns, roles, texts, faults(roles, texts), END) + summary.close()
            row = (0, [r for r, _ in left], [t for _, t in left]) if turns_wanted else summary.row()
            yield from out.add((key, *row, *[None] * 5), size if turns_wanted else 2 * len(roles))

        def piece() -> Iterator[pa.RecordBatch]:
            nonlocal pieces
            seen, keys = set(), []
            for turn in zip(roles, texts):
                keys.append(None if turn in seen else md5(f"{key!r}:{len(turn[0])}:{turn[0]}{turn[1]}".encode()).hexdigest())
                seen.add(turn)
            yield from out.add((key, *blanks, task + pieces, turns, roles, texts, keys), size)
            pieces += 1

        for batch in batches:
            out = out or _Rows(_schema(batch.schema.field(0).type, done, PIECE))
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if begun and row[0] != key:
                    yield from piece() if edge else finished()
                    edge, turns, roles, texts, size = False, [], [], [], 0
                elif len(roles) >= PIECE_TURNS or size >= PIECE_CHARACTERS:
                    yield from piece()
                    edge, turns, roles, texts, size = True, [], [], [], 0
                begun, key = True, row[0]
                if row[2] is not None:
                    turns.append(row[1])
                    roles.append(row[2])
                    texts.append(row[3])
                    size += len(row[2]) + len(row[3])
        if begun:
            yield from piece()
            yield from out.end()

    return run


def _measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces with the marks of their turns and their transfer costs."""
    for batch in batches:
        roles, texts, earlier = (batch.column(k).to_pylist() for k in (3, 4, 5))
        marks = [faults(r, t, e or ()) for r, t, e in zip(roles, texts, earlier)]
        costs = [transfer(r, m) for r, m in zip(roles, marks)]
        new = [pa.array([bytes(m) for m in marks], pa.binary()), pa.array(costs, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], *new], names=["key", "seq", "turns", "piece_roles", "piece_texts", "marks", "costs"])


def _ends(pieces: pa.Table) -> pa.Table:
    """The least costs after each piece of a conversation, from its last backwards."""
    rows = sorted(zip(pieces.column("seq").to_pylist(), pieces.column("costs").to_pylist()), reverse=True)
    after, found = END, []
    for seq, costs in rows:
        found.append((seq, after))
        after = tuple(min(costs[4 * state + to] + after[to] for to in STATES) for state in STATES)
    return pa.table({"of": pa.array([s for s, _ in found], pa.int64()), "ends": pa.array([list(e) for _, e in found], pa.list_(pa.int64()))})


def _joined(turns_wanted: bool) -> Callable:
    """Pieces in order to conversations."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, summary = None, None, None

        def close() -> Iterator[pa.RecordBatch]:
            before = summary.lines
            left = summary.close()
            if not turns_wanted:
                yield from out.add((key, *summary.row()), summary.lines)
            elif left:
                yield from out.add((key, before, [r for r, _ in left], [t for _, t in left]), 0)

        for batch in batches:
            out = out or _Rows(_schema(batch.schema.field(0).type, LEFT if turns_wanted else SUMMARY))
            for k in range(batch.num_rows):
                own, _, turns, roles, texts, marks, _, _, ends = (c[k].as_py() for c in batch.columns)
                if summary is None or own != key:
                    if summary is not None:
                        yield from close()
                    key, summary = own, Summary()
                before = summary.lines
                left = summary.take(turns, roles, texts, bytearray(marks), tuple(ends))
                if turns_wanted and left:
                    yield from out.add((key, before, [r for r, _ in left], [t for _, t in left]), sum(len(t) for _, t in left))
        if summary is not None:
            yield from close()
            yield from out.end()

    return run


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of (conv_id, turn, role, text) with damage by
    crc32 of ``conv_id:turn``, modulo 20: 0 leaves of the row its conversation only
    (``gone``), 1 empties the text, 2 takes its ends of sentences, 3 repeats the row, 4
    makes its role user.  Nulls of role and text are one space, and so are those in
    what is hashed.  Repeated rows are damaged alike; an empty table gives one."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(named("conv_id"), F.lit(":"), named("turn")).cast("binary")) % 20
    role = F.when(kind == 4, "user").otherwise(named("role"))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(named("text"), "[.!?]", "")).otherwise(named("text"))
    times = F.explode(F.when(kind == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(kind == 0)))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("gone"))


def _repaired(conversations: DataFrame, key: str, turn: str, role: str, text: str, gone: str | None, turns_wanted: bool) -> DataFrame:
    prepare_workers(conversations.sparkSession)
    left_out = F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)
    there = lambda c: F.when(~left_out, c)
    named = lambda c: there(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col(f"`{key}`").alias("key"), there(F.col(f"`{turn}`").cast("long")).alias("turn"), named(role).alias("role"), named(text).alias("text"))
    # equal rows may be dealt to several tasks: any order of them is the same
    order = ["key", "turn", "role", F.substring("text", 1, 64), F.md5("text"), F.xxhash64(F.monotonically_increasing_id())]
    names = [f"o{k}" for k in range(len(order))]
    rows = rows.select("*", *[(F.col(o) if isinstance(o, str) else o).alias(n) for o, n in zip(order, names)])
    rows = rows.repartitionByRange(*names).sortWithinPartitions(*names).select("key", "turn", "role", "text")
    kind = f"key {rows.schema['key'].dataType.simpleString()}"
    done = LEFT if turns_wanted else SUMMARY
    staged = settle(rows.mapInArrow(_pieces(turns_wanted), f"{kind}, {done}, {PIECE}"))
    columns = ["key", *[p.split(" ")[0] for p in done.split(", ")]]
    pieces = staged.where("seq IS NOT NULL").select("key", *[p.split(" ")[0] for p in PIECE.split(", ")])

    keys = pieces.select("seq", F.posexplode("keys").alias("at", "turn_key")).where("turn_key IS NOT NULL")
    several = keys.groupBy("turn_key").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    earlier = keys.join(several, "turn_key").where("seq > first").groupBy("seq").agg(F.collect_list("at").alias("earlier")).withColumnRenamed("seq", "of")
    pieces = pieces.drop("keys").join(earlier, F.col("seq") == F.col("of"), "left").drop("of")
    measured = settle(pieces.mapInArrow(_measured, f"{kind}, seq long, turns array<long>, piece_roles array<string>, piece_texts array<string>, marks binary, costs array<long>"))
    ends = measured.select("key", "seq", "costs").groupBy("key").applyInArrow(_ends, "of long, ends array<long>")
    ordered = measured.join(ends, F.col("seq") == F.col("of")).repartition("key").sortWithinPartitions("key", "seq")
    joined = ordered.mapInArrow(_joined(turns_wanted), f"{kind}, {done}")
    return staged.where("seq IS NULL").select(*columns).unionByName(joined)


def repairs(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """One row for each conversation: what is wrong with it, the cheapest edits that
    make it legal, and a digest of what they leave.

    ``gaps`` are turns that lack between the least and the largest; ``blank``,
    ``duplicate`` and ``truncated`` count turns by their first fault, ``illegal``
    neighbours whose roles may not follow each other; ``cost`` and ``audit`` are those
    of the edits, and ``repaired_sha256`` of the lines ``role:text`` that are left.

    Turns are taken by number, nulls first, then by role, the text's first 64
    characters and its MD5.  A null role or text is one space; rows with a true ``gone``
    only say that their conversation exists.  Null is a conversation of its own.
    Repeated rows are duplicates; further columns are not looked at; an empty table
    gives no rows, a conversation without turns has an empty audit.
    """
    return _repaired(conversations, key, turn, role, text, gone, False).withColumnRenamed("key", key)


def repaired_turns(conversations: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None) -> DataFrame:
    """(key, turn, role, text) of the conversations that those edits leave; turns are
    numbered from 0.  Nulls and repeated rows are as in repairs()."""
    found = _repaired(conversations, key, turn, role, text, gone, True)
    rows = found.select("key", "place", F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "turn"))
    return rows.select(F.col("key").alias(key), (F.col("place") + F.col("at")).alias(turn), F.col("turn.roles").alias(role), F.col("turn.texts").alias(text))
