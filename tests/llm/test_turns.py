"""Repaired conversations against brute force, in one piece and in many."""

import hashlib
import random
import re
import zlib
from functools import cache

import pytest
from pyspark.sql import functions as F

from tessera.llm import queries, turns

FOLLOWING = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """All of a conversation's columns, from (turn, role, text) in order, by trying
    all edits of each turn."""
    seen, fault = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        fault.append("B" if not visible else "D" if (role, text) in seen else "T" if visible[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(i, state, inserted):
        ways = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def way(cost, edit, left, then):
            ways.append((cost + then[0], edit + then[1], left + then[2]))

        if inserted < 3:
            way(2, "I", ((NAMES[FOLLOWING[state]], ""),), best(i, FOLLOWING[state], inserted + 1))
        if i < len(rows):
            _, role, text = rows[i]
            way(3, "D", (), best(i + 1, state, 0))
            if fault[i] not in ("B", "D"):
                more = fault[i] == "T"
                if role[:1] == FOLLOWING[state] or (state == "" and role[:1] == "s"):
                    way(more, "K", ((role, text),), best(i + 1, role[:1], 0))
                way(2 + more, "R", ((NAMES[FOLLOWING[state]], text),), best(i + 1, FOLLOWING[state], 0))
        return min(ways, key=lambda w: w[:2], default=(1 << 40, "", ()))

    for i in reversed(range(len(rows) + 1)):  # from the end, so that calls don't nest deeply
        for state in FOLLOWING:
            best(i, state, 0)
    cost, audit, left = best(0, "", 0)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines = "\n".join(f"{r}:{t}" for r, t in left)
    return gaps, fault.count("B"), fault.count("D"), fault.count("T"), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest(), left


def wanted(data):
    conversations = {}
    for conv, turn, role, text in data:
        rows = conversations.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    order = lambda t: (t[0] is not None, t[0] or 0, t[1], t[2][:64], hashlib.md5(t[2].encode()).hexdigest())
    return {conv: brute(sorted(rows, key=order)) for conv, rows in conversations.items()}


def drawn(seed, n, most):
    rng = random.Random(seed)
    texts = ["Hello.", "What?", "no end", "  ", "", None, "Yes!", "a b c. ", "tail \t", "x" * 70 + "1.", "x" * 70 + "2."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    return [(c, rng.choice([None, *range(8)]), rng.choice(roles), rng.choice(texts)) for c in [*range(n), None] for _ in range(rng.randint(1, most))]


def repaired(spark, data, partitions=4):
    found = turns.repairs(turns.damaged(spark.createDataFrame(data, SCHEMA).repartition(partitions)), gone="gone")
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


@pytest.mark.parametrize("piece", [1 << 14, 5, 1])
def test_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE_TURNS", piece)
    data = drawn(piece, 60, 12)
    assert repaired(spark, data) == {k: v[:-1] for k, v in wanted(data).items()}


def test_given_table(spark):
    folder = "/root/testdata/sf0.01"
    data = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r)[1:] for r in queries.op12_turns(spark, folder).collect()}
    assert found == {k: v[:-1] for k, v in wanted(data).items()}


@pytest.mark.parametrize("piece", [1 << 14, 4])
def test_repaired_turns(spark, monkeypatch, piece):
    monkeypatch.setattr(turns, "PIECE_TURNS", piece)
    data = drawn(9, 40, 10)
    rows = turns.repaired_turns(turns.damaged(spark.createDataFrame(data, SCHEMA)), gone="gone").collect()
    found = {}
    for r in sorted(rows, key=lambda r: r.turn):
        assert r.turn == len(found.setdefault(r.conv_id, []))
        found[r.conv_id].append((r.role, r.text))
    assert found == {k: list(v[-1]) for k, v in wanted(data).items() if v[-1]}


def test_one_conversation_has_most_rows(spark, monkeypatch):
    monkeypatch.setattr(turns, "PIECE_TURNS", 30)
    rng = random.Random(7)
    hot = [(0, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"turn {k}" + rng.choice([".", ".", "", "?"])) for k in range(400)]
    hot += [(0, 300, "user", "the same.")] * 200 + [(0, k, "assistant", "said often.") for k in range(0, 400, 5)]
    data = hot + [(k, 0, "user", "Hi.") for k in range(1, 60)]
    plain = turns.repairs(spark.createDataFrame(data, SCHEMA).repartition(8))
    order = lambda t: (t[0], t[1], t[2][:64], hashlib.md5(t[2].encode()).hexdigest())
    want = brute(sorted([r[1:] for r in hot], key=order))[:-1]
    found = {r.conv_id: tuple(r)[1:] for r in plain.collect()}
    assert found[0] == want and len(found) == 60 and found[1][6] == "KI"


def test_odd_tables(spark):
    assert turns.repairs(turns.damaged(spark.createDataFrame([], SCHEMA)), gone="gone").collect() == []
    dropped = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    found = repaired(spark, [(dropped, 0, "user", "Hi.")])
    assert found == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    wide = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "Yes.")], SCHEMA).select("*", *[F.lit(1).alias(n) for n in ("key", "o0", "seq", "gaps", "gone", "cost")])
    (row,) = turns.repairs(wide).collect()
    assert row.audit == "KK" and row.cost == 0
    long = spark.createDataFrame([("c", 1, "user", "a " * 3_000_000 + "."), ("c", 2, "assistant", "b " * 3_000_000)], "conv_id string, turn int, role string, text string")
    (row,) = turns.repairs(long).collect()
    assert (row.audit, row.truncated, row.cost) == ("KK", 1, 1)
