"""Best rows of many lists, and nearest vectors, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import catalogue, channels, matching, postings


@pytest.mark.parametrize("partitions", [1, 5])
def test_best_matches(spark, partitions, monkeypatch):
    monkeypatch.setattr(matching, "_LISTS", 7)
    rng = np.random.default_rng(4)
    held = {d: {f"w{w}": int(rng.integers(1, 4)) for w in rng.integers(0, 30, 8)} for d in range(700)}
    lists = [[f"w{w}" for w in sorted(set(rng.integers(0, 34, rng.integers(1, 6)).tolist()))] for _ in range(40)] + [["none"], []]
    hits = spark.createDataFrame([(d, t, n) for d, own in held.items() for t, n in own.items()], "id long, token string, weight long").repartition(partitions)
    asked = spark.createDataFrame([(k, w) for k, w in enumerate(lists + lists[:3])], "k int, words array<string>")
    found = {}
    for r in matching.best_matches(hits, asked, 9).orderBy("k", "rank").collect():
        found.setdefault(r.k, []).append((r.id, r.n, r.weight))
    for k, words in enumerate(lists + lists[:3]):
        scores = [(-sum(w in own for w in words), -sum(own.get(w, 0) for w in words), d) for d, own in held.items()]
        assert found.get(k, []) == [(d, -n, -w) for n, w, d in sorted(scores)[:9] if n], k


def test_nearest(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 8)).astype("float32")
    base[100:130] = base[0]  # ties
    rows = [(k, v.tolist()) for k, v in enumerate(base)] + [(900, [0.0] * 8), (901, None), (902, [1.0, 2.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    wanted = spark.createDataFrame([(k, base[k].tolist()) for k in (0, 7, 120)], "query_id long, vector array<float>")
    found = channels.nearest(vectors.repartition(3), wanted, 10).collect()
    assert {r.vec_id for r in found if r.cosine is None} == {900, 901, 902}
    for q in (0, 7, 120):
        exact = [(-round(float(base[k].astype(float) @ base[q].astype(float) / np.sqrt((base[k].astype(float) ** 2).sum() * (base[q].astype(float) ** 2).sum())), 6), k) for k in range(300)]
        own = sorted((-round(r.cosine, 6), r.vec_id) for r in found if r.query_id == q and r.cosine is not None)
        assert own[:10] == sorted(exact)[:10]


def test_one_question_builds_no_index(spark, tmp_path):
    spark.createDataFrame([(1, "one two\ntwo", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    key = spark.sparkContext.applicationId, str(tmp_path)
    first = sorted(tuple(r) for r in catalogue.QUERIES["token_df"](spark, str(tmp_path)).collect())
    assert key not in postings._built  # failed before
    scan = postings.at_hand(spark, str(tmp_path))
    words = spark.createDataFrame([("two",), ("two",), ("none",)], "token string")
    hits = sorted(tuple(r) for r in scan.hits(words).collect())
    stored = postings.of_tables(spark, str(tmp_path))
    assert postings.at_hand(spark, str(tmp_path)) is stored
    assert hits == sorted(tuple(r) for r in stored.hits(words).collect()) and len(hits) == 2
    assert first == sorted(tuple(r) for r in catalogue.QUERIES["token_df"](spark, str(tmp_path)).collect())
