"""Choice down a ranking against a plain loop: chains of neighbours, pools, scopes."""

import random

import pytest

from tessera.operators import postings, scopes, selection

SCHEMA = "query_id string, document_id long, anchor string, id long, score double"


def plain(rows, limit, cap, apart):
    out = {}
    for q in {r[0] for r in rows}:
        kept = []
        for _, d, a, i, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[3])):
            number = int(a.split("-p")[1]) if a and "-p" in a else None
            near = [k for k in kept if k[0] == d and number is not None and k[2] is not None and abs(k[2] - number) <= apart]
            if len(kept) < limit and (a or "") not in [k[1] for k in kept] and sum(k[0] == d for k in kept) < cap and not (apart and near):
                kept.append((d, a or "", number, i))
        out[q] = [(d, i) for d, _, _, i in kept]
    return out


@pytest.mark.parametrize("pool", [None, 3, 1])
@pytest.mark.parametrize("limit,cap,apart", [(5, 2, 1), (30, 3, 0), (4, 1, 2)])
def test_against_a_loop(spark, pool, limit, cap, apart):
    rng = random.Random(limit)
    rows = []
    for k in range(400):
        d = rng.randrange(12)
        rows.append((rng.choice("abc"), d, rng.choice([f"{d}-p{rng.randrange(9)}", f"shared-p{rng.randrange(3)}", "none", None]), k, float(rng.randrange(20))))
    found = {}
    for r in sorted(selection.selected(spark.createDataFrame(rows, SCHEMA), limit, cap, apart, pool).collect(), key=lambda r: (r.query_id, r.place)):
        found.setdefault(r.query_id, []).append((r.document_id, r.id))
    assert found == plain(rows, limit, cap, apart)


def test_chains_of_neighbours(spark):
    """The second of a chain goes, so the third stays: it has no kept neighbour."""
    rows = [("q", 1, f"1-p{k}", k, 10.0 - k) for k in range(6)]
    found = selection.selected(spark.createDataFrame(rows, SCHEMA), 10, 9, 1).orderBy("place").collect()
    assert [r.id for r in found] == [0, 2, 4]
    assert selection.selected(spark.createDataFrame([], SCHEMA), 5, 1, 1).collect() == []
    assert selection.cap_of("keyword", 20) == 1 and selection.cap_of("party_name", 20) == 2 and selection.cap_of("keyword", 2, True) == 3


def test_seed_scopes(spark, tmp_path):
    texts = ["owner occupancy as principal residence", "the principal residence", "section 8 voucher eviction action", "a voucher and an unlawful detainer complaint", "nothing of this"]
    rows = [(k << 26, k, "", t) for k, t in enumerate(texts)]
    stored = postings.build(spark.createDataFrame(rows, "chunk_id long, document_id long, section_label string, chunk_text string"), f"{tmp_path}/i")
    asked = spark.createDataFrame([(1, "owner move in and never moved in"), (2, "section 8 eviction"), (3, "rent"), (4, None)], "query_id long, text string")
    found = {}
    for r in scopes.seeded(asked, stored, scopes.SEEDS, 2).orderBy("query_id", "topic", "place").collect():
        found.setdefault((r.query_id, r.topic), []).append(r.document_id)
    assert found == {(1, "not_moved_in"): [0, 1], (2, "detainer"): [2, 3]}
    assert len(scopes.SEEDS) == 14 and scopes.scope_size(20) == 8 and scopes.scope_size(2) == 4


def test_universe(spark):
    schema = "query_id long, document_id long, rank int"
    one = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3)], schema)
    two = spark.createDataFrame([(1, 11, 1), (1, 13, 2), (2, 10, 1)], schema)
    found = scopes.universe([("a", one, 2), ("b", two, 9)], 3).orderBy("query_id", "place").collect()
    assert [tuple(r) for r in found] == [(1, 10, "a", 1), (1, 11, "a", 2), (1, 13, "b", 3), (2, 10, "b", 1)]
