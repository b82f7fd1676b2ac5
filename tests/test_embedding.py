"""The embedding stage: failures, pages and diagnostics."""

import numpy as np

from tessera.sources.sinks import read_store
from tessera.streaming import embedding


def embedders():
    """Within a function, so that they travel to tasks by value."""

    def fragile(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("cannot embed this")
        return embedding.hashed(texts)

    def broken(texts):
        return [[float("nan")] * 3] * len(texts)

    return fragile, broken


fragile, broken = embedders()


def test_a_failing_batch_stops_and_repeats_no_other(spark):
    rows = [(k, "bad text" if k in (5, 17) else f"text {k}") for k in range(40)]
    found = embedding.embedded(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", "text", fragile, batch_size=8).collect()
    assert sorted(r.id for r in found) == list(range(40))
    assert {r.id for r in found if r.error} == {5, 17} and all((r.vector is None) == (r.error is not None) for r in found)
    good = {r.id: r.vector for r in found if not r.error}
    assert all(np.allclose(good[k], embedding.hashed([f"text {k}"])[0]) for k in good)
    assert {r.tries for r in found if r.id >= 24} == {1} and {r.tries for r in found if r.id < 8 and not r.error} == {3}


def test_odd_rows(spark):
    found = embedding.embedded(spark.createDataFrame([(1, None), (2, ""), (2, "")], "doc_id long, text string"), "doc_id", "text").collect()
    assert sorted((r.id, len(r.vector), sum(map(abs, r.vector))) for r in found) == [(1, 64, 0.0), (2, 64, 0.0), (2, 64, 0.0)]
    assert embedding.embedded(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []
    (row,) = embedding.embedded(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", "text", broken).collect()
    assert row.error.startswith("ValueError")
    asked = embedding.embedded(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "doc_id", "text", query=True).first()
    assert np.allclose(asked.vector, embedding.hashed([embedding.INSTRUCTION + "x"])[0])


def test_pages_are_resumed(spark, tmp_path):
    store = f"{tmp_path}/vectors"
    rows = spark.createDataFrame([(k, "bad" if k == 3 else f"text {k}") for k in range(25)], "doc_id long, text string")
    seen = [embedding.backfill(spark, rows, "doc_id", "text", store, 10, fragile)["rows"] for _ in range(4)]
    assert seen == [10, 20, 25, 25]
    assert embedding.diagnostics(read_store(spark, store)) == {"rows": 25, "vectors": 24, "errors": 1, "tried_again": 10, "kinds_of_errors": 1}
    after = embedding.backfill(spark, rows, "doc_id", "text", store, 10, embedding.hashed, retry=True)
    assert (after["rows"], after["errors"]) == (25, 0)
