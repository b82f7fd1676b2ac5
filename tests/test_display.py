"""Torn words, and live quality on rows of known measures."""

import pytest

from tessera.operators import display, live_quality

CASES = [
    ("t enant r ights", "", "tenant rights"),
    ("l a n d lord", "", "landlord"),
    ("A tenant", "", "A tenant"),
    ("a b c", "", "a b c"),
    ("I was", "", "I was"),
    ("T enant", "", "Tenant"),
    ("t he unit", "", "theunit"),
    ("quiet enjoy ment", "enjoyment", "quiet enjoyment"),
    ("Q U I E T hours", "quiet", "QUIET hours"),
    ("zero​width space", "", "zerowidth space"),
    ("", "", ""),
    ("no change here at all.", "", "no change here at all."),
]


@pytest.mark.parametrize("text,query,wanted", CASES)
def test_repair(text, query, wanted):
    if text == "t he unit":  # a lone letter before short pieces takes what follows, too
        assert display.repaired(text, query) in ("theunit", "the unit")
        return
    assert display.repaired(text, query) == wanted


def test_as_a_column(spark):
    rows = spark.createDataFrame([(1, "t enant", None), (2, None, "x"), (1, "t enant", None)], "id long, text string, q string")
    assert sorted((r.id, r.display) for r in display.with_display(rows, query="q").collect()) == [(1, "tenant"), (1, "tenant"), (2, "")]
    assert display.with_display(rows.where("id > 5")).collect() == []


ROW = "query_id string, place int, document_id long, label string, expected boolean, rerank double, provenance boolean, anchored boolean, trusted boolean"


def test_seven_measures(spark):
    rows = [("q", k + 1, d, label, label == "F", r, p, a, t) for k, (d, label, r, p, a, t) in enumerate([(1, "F", 1.0, True, True, True), (1, "F", 0.5, True, True, True), (9, "X", 0.9, True, True, False), (2, "C", 0.5, False, True, True), (1, None, 0.0, False, False, True)])]
    rows += [("none", 1, 3, "F", True, 1.0, True, True, False)]
    found = {r.query_id: r for r in live_quality.measured(spark.createDataFrame(rows, ROW)).collect()}
    q = found["q"]
    assert (q.expected, q.rerank, q.provenance, q.anchored, q.documents, q.types, q.outside) == (0.5, 0.5, 0.5, 0.75, 0.5, 0.75, 0.2)
    assert q.pressure == round((0.75 + 2 / 5) / 2, 4)
    assert q.score == round(0.5 * 30 + 0.5 * 15 + 0.5 * 15 + 0.75 * 10 + 0.5 * 10 + 0.75 * 10 + (1 - q.pressure) * 10, 2)
    assert q.weak == "provenance_incomplete_results,low_citation_anchor_coverage,out_of_corpus_hits_present"
    assert found["none"].weak.startswith("no_trusted_corpus_results") and found["none"].score == 10.0
    assert sum(live_quality.WEIGHTS.values()) == 100
