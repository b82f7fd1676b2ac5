"""Sharding and mixing against plain Python, and their SQL."""

import random
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing, sharding


def some(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(i, "x" * rng.randint(0, 300), f"s{rng.randint(0, 3)}") for i in range(n)]
    rows += [(7, "same" * 30, "s0")] * 25 + [(None, None, None), (None, "y", None), (9000, "z" * 5000, "s1")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_shards_fit(spark):
    docs = some(spark)
    rows = sharding.assign_shards(docs, limit=1000).collect()
    assert len(rows) == docs.count()
    bytes_, keys = defaultdict(int), defaultdict(set)
    for r in rows:
        bytes_[r.depth, r.prefix, r.page] += r.n_bytes
        keys[r.depth, r.prefix, r.page].add((r.doc_id, r.n_bytes))
    over = [k for k, b in bytes_.items() if b > 1000]
    assert [next(iter(keys[k]))[0] for k in over] == [9000]
    prefixes = {(r.depth, r.prefix) for r in rows}
    for depth, prefix in prefixes:  # no shard lies in another
        assert not any((d, prefix >> (depth - d)) in prefixes for d in range(depth))
    sums = defaultdict(int)
    for r in rows:
        sums[r.depth, r.prefix] += r.n_bytes
    assert all(sums[r.depth, r.prefix] == r.shard_bytes for r in rows)
    # only prefixes above the limit were split
    for depth, prefix in prefixes - {(0, 0)}:
        parent = sum(b for (d, p), b in sums.items() if d >= depth and p >> (d - depth + 1) == prefix >> 1)
        assert parent > 1000


def test_shards_of_nothing(spark):
    empty = some(spark).where("false")
    assert sharding.assign_shards(empty).collect() == []
    one = sharding.assign_shards(some(spark), limit=1 << 30).collect()
    assert {(r.depth, r.prefix) for r in one} == {(0, 0)}


def targets(sizes, weights=(5, 2, 1)):
    """The water level by repeated sharing, in fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    cap = {s: Fraction(2 * sizes[s]) for s in order}
    left, open_, found = Fraction(3, 2) * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= cap[s]}
        if not full:
            return found | {s: unit * weight[s] for s in open_}
        for s in full:
            found[s] = cap[s]
            left -= cap[s]
        open_ -= full
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_targets(spark, seed):
    rng = random.Random(seed)
    sizes = {name: rng.choice([0, 1, rng.randint(1, 1000), 10**6]) for name in ["b", "a", "é", None, "Z", "aa", ""]}
    rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    want = targets(sizes)
    assert all(abs(got[s] - float(want[s])) <= 1e-6 * max(1, want[s]) for s in sizes)


def words(spark, n=3000, seed=5):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 120)), rng.choice(["a"] * 12 + ["b", "b", "c", "d", None])) for i in range(n)]
    return spark.createDataFrame(rows + [(3, "w w", "tiny"), (3, "w w", "tiny"), (None, None, "a"), (5, "\x0b w w ", "a")], "doc_id long, text string, source string").repartition(4)


def test_mix_meets_targets(spark):
    docs = words(spark)
    rows = mixing.mix(docs, shard=4096).collect()
    assert len(rows) == docs.count()
    taken, target = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(16, 0.01 * t), (s, taken[s], t)
    again = mixing.mix(docs.repartition(7), shard=4096).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, rows))
    assert mixing.mix(docs.where("false")).collect() == []


def test_seats_are_by_highest_quotients(spark):
    """With one shard, each source's blocks are those of a plain apportionment."""
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.randint(1, 90)), f"s{i % 7}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs, shard=1 << 30).collect()
    taken, target, size = defaultdict(int), {}, defaultdict(int)
    for r in found:
        taken[r.source] += r.taken
        target[r.source] = r.target
        size[r.source] += r.size
    seats = dict.fromkeys(target, 0)
    for _ in range(round(sum(target.values()) / mixing.BLOCK)):
        best = max(seats, key=lambda s: (target[s] / (2 * seats[s] + 1), s))
        seats[best] += 1
    for s in seats:
        assert taken[s] == min(seats[s] * mixing.BLOCK, 2 * size[s])


def test_mixed_rows_repeat_and_cut(spark):
    docs = words(spark, 200).withColumn("__n_words", F.lit("kept"))
    want = sum(r.taken for r in mixing.mix(docs).collect())
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert rows.select(F.sum(mixing.n_words("text"))).first()[0] == want
    text = spark.createDataFrame([(" a\n b  c ", 2)], "text string, n int")
    assert text.select(mixing.first_words("text", "n").alias("v")).first().v == " a\n b"
