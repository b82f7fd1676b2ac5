"""Facet counts kept by a stream against a full count of the last versions."""

import random

import pytest

from tessera.sources.sinks import read_store
from tessera.streaming import jobs

SCHEMA = "doc_id long, at long, values array<string>"


def changes(seed):
    rng = random.Random(seed)
    out = []
    for at in range(120):
        values = rng.choice([None, [], ["a"], ["a", "b"], ["b", "c", "c"], ["d"]])
        out.append((rng.randrange(15), rng.choice([at, at // 3]), values))
    return out


def counted(rows):
    last = {}
    for d, at, v in rows:
        key = (at, v is None, v or [])
        if d not in last or key > last[d]:
            last[d] = key
    out = {}
    for _, deleted, values in last.values():
        for v in set(values if not deleted else []):
            out[v] = out.get(v, 0) + 1
    return out


def kept(spark, store):
    return {r.value: r.n for r in jobs.facet_counts(spark, store).collect()}


@pytest.mark.parametrize("seed,size", [(1, 120), (2, 30), (3, 17)])
def test_batches_and_replays(spark, tmp_path, seed, size):
    rows = changes(seed)
    items, store = f"{tmp_path}/items", f"{tmp_path}/facets"
    rng = random.Random(seed)
    for number, start in enumerate(range(0, len(rows), size)):
        batch = spark.createDataFrame(rows[start : start + size] + rng.sample(rows[: start + 1], 1), SCHEMA).repartition(3)
        if number % 2:  # a failure between the two writes, or after them
            jobs.merge_items(batch, number, items)
        jobs.merge_items(batch, number, items)
        jobs.merge_deltas(spark, number, items, store)
        if number % 3 == 1:
            jobs.merge_items(batch, number, items)
            jobs.merge_deltas(spark, number, items, store)
        assert kept(spark, store) == counted(rows[: start + size])
    jobs.compact_deltas(spark, store, number)
    assert kept(spark, store) == counted(rows)


def test_stream(spark, tmp_path):
    rows = changes(9)
    for k in range(4):
        spark.createDataFrame(rows[k * 30 : k * 30 + 30], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    query = jobs.keep_facets(jobs.stream(spark, f"{tmp_path}/in", SCHEMA, 1), f"{tmp_path}/items", f"{tmp_path}/facets", f"{tmp_path}/c")
    query.awaitTermination()
    assert kept(spark, f"{tmp_path}/facets") == counted(rows)


def test_readers_outlive_a_write(spark, tmp_path):
    store = f"{tmp_path}/items"
    jobs.merge_items(spark.createDataFrame([(1, 1, ["a"])], SCHEMA), 0, store)
    begun = read_store(spark, store)
    jobs.merge_items(spark.createDataFrame([(1, 2, ["b"])], SCHEMA), 1, store)
    assert [r["values"] for r in begun.collect()] == [["a"]]
    for k in range(2, 8):
        jobs.merge_items(spark.createDataFrame([(1, k + 1, ["b"])], SCHEMA), k, store)
    folders = [p for p in tmp_path.glob("items/*") if p.name != "_versions" and any(p.rglob("*.parquet"))]
    assert len(folders) <= 4
