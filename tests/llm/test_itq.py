import numpy as np
import pytest

from tessera.llm import itq


def brute_force(rows, least=0.9):
    n = len(rows)
    links = [set() for _ in range(n)]
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in rows]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = itq.unit(np.array([rows[i][1], rows[j][1]], float))
                if a @ b >= least:
                    links[i].add(j)
                    links[j].add(i)
    seen = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if seen[j] < seen[i]:
                    seen[i], changed = seen[j], True
    return [(rows[i][0], len(links[i]), min(rows[k][0] for k in range(n) if seen[k] == seen[i])) for i in range(n)], links


def test_small_table(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((80, 32))
    rows = [list(map(float, v)) for v in base]
    for k in range(60):
        v = base[k % 5] + rng.standard_normal(32) * 0.12
        rows.append(list(map(float, v * rng.uniform(0.1, 9))))
    rows += [rows[0], rows[0], [x * 1e200 for x in rows[1]], None, [], [0.0] * 32, [float("nan")] * 32, [None, 1.0], [1.0, float("inf")], [1.0, 2.0], [2.0, 4.0]]
    order = rng.permutation(len(rows))
    data = [(int(i), rows[i]) for i in order]
    want, _ = brute_force(data)
    found = itq.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>").repartition(3))
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_empty(spark):
    assert itq.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


@pytest.mark.parametrize("cosine,least", [(0.9, 0.9), (0.95, 0.99)])
def test_recall_at_given_cosine(spark, cosine, least):
    """Pairs at just this cosine, the hardest that must link."""
    rng = np.random.default_rng(2)
    a = itq.unit(rng.standard_normal((600, 64)))
    b = rng.standard_normal((600, 64))
    b = itq.unit(b - (b * a).sum(1, keepdims=True) * a)
    c = cosine + 1e-6
    pairs = np.vstack([a, c * a + np.sqrt(1 - c * c) * b])
    rows = [(i, list(map(float, v))) for i, v in enumerate(pairs)]
    found = {r.vec_id: r.n_links for r in itq.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert sum(found.values()) / 1200 >= least


def test_dense_groups_and_their_surroundings(spark):
    """Two dense groups, one of them with copies, and vectors near them: all links
    as by brute force, at 1 and at 16 partitions."""
    rng = np.random.default_rng(7)
    base = itq.unit(rng.standard_normal((3, 32)))
    rows = [base[k % 2] + rng.standard_normal(32) * 0.01 for k in range(400)]
    rows += [base[k % 3] + rng.standard_normal(32) * 0.07 for k in range(60)]
    rows += list(rng.standard_normal((100, 32))) + rows[:20]
    data = [(int(i), list(map(float, v))) for i, v in enumerate(rows)]
    x = itq.unit(np.array(rows))
    near = x @ x.T >= 0.9
    want = near.sum(1) - 1
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "16"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            found = itq.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("vec_id").collect()
            got = np.array([r.n_links for r in found])
            assert (got <= want).all() and got.sum() >= 0.98 * want.sum()
            assert {r.component_id for r in found[:400:2]} == {found[0].component_id}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_tables_grow_with_the_logarithm():
    for n in (100, 10_000, 10**6, 10**9):
        t = itq.planned(n, 0.9)
        assert t.width == max(12, int(np.ceil(np.log2(n)))) and t.width * t.count <= 64 * t.words
    assert itq.planned(10**9, 0.9).count < 25
