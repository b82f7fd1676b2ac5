"""Vector codes against brute force, their pruning, and odd tables."""

import math
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import annular, queries

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """{vec_id: (code, error, label_error, digest)} by comparing all with all."""
    kept = sorted((k, [math.floor(4096 * float(np.float32(x))) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v))
    size = len(kept[0][1]) // 8
    parts = [[v[p * size : (p + 1) * size] for _, v, _ in kept] for p in range(8)]
    books = [list(part[:16]) for part in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(book))

    for _ in range(6):
        for p, book in enumerate(books):
            taken = {}
            for x in parts[p]:
                taken.setdefault(nearest(x, book)[1], []).append(x)
            for k, xs in taken.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    codes, labels = {}, {}
    for n, (key, _, label) in enumerate(kept):
        found = [nearest(parts[p][n], books[p]) for p in range(8)]
        error = sum(d for d, _ in found)
        labels[label] = labels.get(label, 0) + error
        codes[key] = "".join(f"{k:02x}" for _, k in found), error, label
    return {k: (c, e, labels[label], digest) for k, (c, e, label) in codes.items()}


def collected(found):
    return {r.vec_id: (r.code, r.error, r.label_error, r.codebooks_sha256) for r in found.collect()}


def vectors(rng, n, size=16):
    rows = [(int(k), [float(x) for x in np.round(rng.normal(0, 0.3, size), 2)], int(k) % 3 or None) for k in range(n)]
    return rows + [(n, None, 1), (n + 1, [None] + [0.5] * (size - 1), 1), (n + 2, [float("nan")] * size, 2), (n + 3, [float("inf")] + [0.0] * (size - 1), 2), (n + 4, [0.0] * size, 2)]


@pytest.mark.parametrize("n", [300, 9])
def test_against_brute_force(spark, n):
    rows = vectors(np.random.default_rng(n), n)
    assert collected(annular.with_codes(spark.createDataFrame(rows, SCHEMA).repartition(5))) == brute(rows)


def test_given_table_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert collected(queries.op11_codes(spark, "/root/testdata/sf0.001")) == brute(rows)


def test_pruned_search_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    entries = rng.integers(-4000, 4000, (16, 8)) * rng.integers(0, 6, (16, 1))
    entries[7], entries[9] = entries[3], -entries[2]
    book = annular.Codebook(entries)
    parts = np.concatenate([rng.integers(-9000, 9000, (2000, 8)), entries, (entries[:8] + entries[8:]) // 2, np.zeros((1, 8), np.int64)])
    all_of_them = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
    index, apart, done = book.nearest(parts)
    assert (index == all_of_them.argmin(1)).all() and (apart == all_of_them.min(1)).all()
    assert done < 0.8 * all_of_them.size
    near, _, few = book.nearest(entries + 1)
    assert (near == ((entries[:, None] + 1 - entries[None]) ** 2).sum(2).argmin(1)).all() and few < 16 * 16 / 2
    large = annular.Codebook(np.array([[1 << 27, 0], [0, 1 << 27]]))
    assert large.nearest(np.array([[1 << 27, 1], [1, 1 << 27], [5, 5]]))[0].tolist() == [0, 1, 0]


def test_odd_tables(spark):
    assert annular.with_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    none = spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)
    assert annular.with_codes(none).collect() == []
    mixed = spark.createDataFrame([(1, [0.5] * 9, 1), (2, [0.25] * 9, None), (3, [0.5] * 4, 1), (None, [0.5] * 9, None), (2, [0.25] * 9, None)], SCHEMA)
    found = [tuple(r) for r in annular.with_codes(mixed).orderBy("vec_id", "code").collect()]
    assert [r[0] for r in found] == [None, 1, 2, 2, 3]
    assert found[-1][2:4] == (None, None) and all(len(r[2]) == 16 for r in found[:4]) and all(r[3] == 0 for r in found[:4])
    huge = spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1), (3, [1.0] * 8, 1)], SCHEMA)
    assert all(r.error >= 0 for r in annular.with_codes(huge).collect())
    assert annular.with_codes(spark.createDataFrame([(1, [], 1)], SCHEMA)).collect()[0].code == "00" * 8


def test_clashing_names_and_hot_labels(spark):
    rng = np.random.default_rng(4)
    rows = vectors(rng, 200)
    names = ["vector", "key", "code", "error", "cell", "of", "size", "label_error"]
    wide = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit(7).alias(n) for n in names])
    assert collected(annular.with_codes(wide)) == brute(rows)
    hot = [(k, v, 1 if k % 3 else 2) for k, v, _ in rows]
    want = brute(hot)
    assert collected(annular.with_codes(spark.createDataFrame(hot, SCHEMA))) == want
    before, annular.LABELS_BROADCAST = annular.LABELS_BROADCAST, 1
    try:
        assert collected(annular.with_codes(spark.createDataFrame(hot, SCHEMA))) == want
    finally:
        annular.LABELS_BROADCAST = before


def test_partitions_do_not_matter(spark):
    rows = vectors(np.random.default_rng(8), 500)
    df = spark.createDataFrame(rows, SCHEMA)
    assert collected(annular.with_codes(df.repartition(1))) == collected(annular.with_codes(df.repartition(23)))
