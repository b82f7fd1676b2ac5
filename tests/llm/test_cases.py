"""Empty tables, clashing names, hot keys and very long texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, chaining, langid, minhash, mixing, quality, queries, sharding, suffixes, wordpiece

SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.mark.parametrize("operator", ["op1", "op2", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "mixed"])
def test_empty_table(spark, operator):
    docs = spark.createDataFrame([], SCHEMA)
    run = {
        "op1": lambda: minhash.near_duplicates(docs),
        "op2": lambda: suffixes.without_repeats(docs),
        "op3": lambda: sharding.assign_shards(docs),
        "op4": lambda: wordpiece.with_piece_counts(docs, queries.PIECES),
        "op5": lambda: chaining.shared_passages(docs),
        "op6": lambda: quality.with_quality(docs, quality.references(docs)),
        "op7": lambda: mixing.mix(docs),
        "op8": lambda: bpe.with_tokens(docs, queries.BYTE_PAIRS),
        "op9": lambda: langid.with_language(docs, langid.train(docs)),
        "mixed": lambda: mixing.mixed_rows(docs),
    }[operator]
    assert run().collect() == []


def test_clashing_names(spark):
    names = ["__marks", "marks", "own", "text_key", "kept", "n", "key", "hash", "taken", "size", "nth", "c0", "none"]
    rows = [(1, "word " * 200, "s", *range(len(names))), (2, "other words here", None, *range(len(names)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{n}` long" for n in names))
    cut = suffixes.without_repeats(docs).orderBy("doc_id").collect()
    assert [r.n_removed for r in cut] == [1000, 0]
    assert all(r[n] == k for r in cut for k, n in enumerate(names) if n != "kept")
    mixed = mixing.mixed_rows(docs).collect()
    assert all(r[n] == k for r in mixed for k, n in enumerate(names)) and {r.doc_id for r in mixed} <= {1, 2}
    assert mixing.mixed_rows(docs).columns == docs.columns


def test_hot_keys(spark):
    """Rows equal in all columns, and null keys, by the hundred thousand."""
    n = 200_000
    docs = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("s").alias("source"))
    shards = sharding.assign_shards(docs, limit=100_000)
    found = shards.groupBy("page").agg(F.count("*").alias("n")).agg(F.count("*"), F.max("n"), F.sum("n")).first()
    assert found[0] == -(-n // (100_000 // 13)) and found[1] * 13 <= 100_000 and found[2] == n
    others = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("w"), "id").alias("text"), F.lit("t").alias("source"))
    mixed = mixing.mix(docs.unionByName(others))
    assert mixed.count() == n + 1000 and mixed.where("taken > 2 * size").count() == 0
    by = {r.source: r for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.min("target").alias("target")).collect()}
    assert all(abs(r.taken - r.target) <= 0.02 * r.target + 16 for r in by.values())


def test_very_long_texts(spark):
    rng = np.random.default_rng(3)
    text = " ".join(f"w{x}" for x in rng.integers(0, 5000, 300_000))
    docs = spark.createDataFrame([(1, text, "en", "s"), (2, text + " more", "en", "s"), (3, "short", "en", "s")], SCHEMA)
    groups = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert groups == {1: 1, 2: 1, 3: 3}
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.without_repeats(docs, drop_text=True).collect()}
    assert cut == {1: (len(text), len(text)), 2: (len(text) + 5, len(text)), 3: (5, 0)}
    found = {r.doc_id: r.n_words for r in quality.with_quality(docs, quality.references(docs), drop_text=True).collect()}
    assert found == {1: 300_000, 2: 300_001, 3: 1}


def test_one_very_long_word():
    """As many tokens as the library makes of it, in memory of a few numbers a byte."""
    from tokenizers import Tokenizer

    rng = random.Random(4)
    word = "".join(rng.choice(["the", "ing", "q", "zx", "ation"]) for _ in range(60_000))
    pairs = bpe.BytePairs(queries.BYTE_PAIRS)
    own = pairs.encode(word).tolist()
    assert pairs.decode(np.array(own, np.int32)).decode() == word
    short = word[:3000]
    library = Tokenizer.from_file(queries.BYTE_PAIRS)
    library.no_truncation()
    library.no_padding()
    assert pairs.encode(short).tolist() == library.encode(short, add_special_tokens=False).ids


def test_settle_wants_a_shared_folder(spark, monkeypatch):
    from tessera.plans import lineage

    class Context:
        master = "spark://somewhere:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(ValueError):
        lineage.checkpoint_dir(Session())


def test_one_language_judges():
    """Characters of one language and words of another don't add up to a pass."""
    classes, words = np.zeros(quality.CLASSES), np.zeros(quality.WORD_BINS)
    classes[0], classes[4], words[1] = 80, 20, 100
    other = np.zeros(quality.CLASSES)
    other[5] = 100
    known = {"a": (classes, np.roll(words, 3)), "b": (other, words)}
    text = " ".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(80))
    *_, by_classes, by_words, kept = quality.judge(text, known)
    assert not kept and by_classes < 0.25 and by_words == pytest.approx(1.0)
