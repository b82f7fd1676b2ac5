"""Operators over whole items, on small tables of their own."""

import pytest

from tessera.operators import catalogue

FILLER = "zebra yonder xylem willow violet umber tundra saddle"


@pytest.fixture
def tables(spark, tmp_path):
    def put(items, texts):
        spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
        return str(tmp_path)

    return put


def rows(spark, name, folder):
    return sorted(tuple(r) for r in catalogue.QUERIES[name](spark, folder).collect())


def test_sentence_overlap_of_late_tokens(spark, tables):
    item = " ".join(f"word{i}" for i in range(30))
    late = " ".join(f"word{i}" for i in range(20, 28))
    apart = " ".join(f"word{i}" for i in (6, 4, 2, 3, 5))  # a run, in any order
    folder = tables([item, "too few words here"], [f"{FILLER} {late}", apart, "word1 word2 word3 word4 word6", None, ""])
    assert rows(spark, "sentence_overlap", folder) == [(0, 0, 8, 0.12), (0, 1, 5, 0.05)]


def test_containment_of_whole_and_short_items(spark, tables):
    long = f"{FILLER} and then the rest that differs"
    folder = tables([long, "Short item", "a b c d", "", None], [f"x{long} y", f"{FILLER} and then another rest", "a short itemised list", "a b c", "za b c dz", None])
    assert rows(spark, "phrase_containment", folder) == [(0, 0), (1, 2), (2, 4)]


def test_adjacency_of_all_tokens(spark, tables):
    folder = tables(["one two three four five", "one two", "six", ""], ["one two three four six", "zero one two three four five one two three four five", "one-two six six", None])
    assert rows(spark, "phrase_adjacency", folder) == [(0, 1, 2), (1, 0, 1), (1, 1, 2), (2, 0, 1), (2, 2, 2)]
