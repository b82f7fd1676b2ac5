import random

import numpy as np
import pytest

from tessera.llm import minhash
from tessera.llm.components import components


def brute_force(texts, idf, similarity=0.8):
    sets = [minhash.weighted_shingles(t, idf) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i][0]) and len(sets[j][0]) and minhash.jaccard(sets[i], sets[j]) >= similarity:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    words = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [words(rng.randint(1, 120)) for _ in range(60)]
    passage = words(40)
    for _ in range(20):
        texts.append(words(30) + passage + words(30))
    for _ in range(4):
        base = words(150)
        texts.append(base)
        for _ in range(12):
            own = list(base)
            for _ in range(rng.randint(1, 4)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(own)
    texts = [" ".join(t) for t in texts]
    texts += [texts[5], texts[5].upper(), None, "", " \n", None, "one two", "one  two"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3), (3, 7)])
def test_groups(spark, monkeypatch, seed, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    want = brute_force(texts, minhash.shingle_idf(docs))
    assert [got[i] for i in range(len(texts))] == want


def test_repeated_rows_and_nulls(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.class_id or 0) for r in minhash.near_duplicates(docs).collect()))
    assert got == [(0, 0), (0, 1), (1, 1), (1, 1), (7, 7)]
    assert minhash.near_duplicates(docs.where("false")).collect() == []


def test_samples_estimate_similarity():
    idf = np.linspace(1, 5, minhash.SLOTS)
    rng = random.Random(3)
    words = [str(rng.randrange(200)) for _ in range(400)]
    a = minhash.weighted_shingles(" ".join(words), idf)
    b = minhash.weighted_shingles(" ".join(words[:300] + words[320:]), idf)
    n = 2048
    same = (minhash.samples(*a, n) == minhash.samples(*b, n)).mean()
    assert abs(same - minhash.jaccard(a, b)) < 0.05


def test_components(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(100, 160)] + [(5, 5), (7, 3), (3, 7)] + [(1000, 1001 + i) for i in range(50)]
    rng.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[7] == got[3] == 3
    assert {got[1000 + i] for i in range(51)} == {1000}


def test_blocks_by_bytes(spark, monkeypatch):
    """Blocks of few bytes give the same groups."""
    texts = corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 2000)
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == want


def test_recall_on_documents(spark):
    """Links of real documents at 0.8 by brute force that are in one group."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    idf = minhash.shingle_idf(docs)
    rows = docs.where("text IS NOT NULL").orderBy("doc_id").collect()
    sets = [minhash.weighted_shingles(r.text, idf) for r in rows]
    group = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    linked = [(i, j) for i in range(len(rows)) for j in range(i) if len(sets[i][0]) and len(sets[j][0]) and minhash.jaccard(sets[i], sets[j]) >= 0.8]
    found = [group[rows[i].doc_id] == group[rows[j].doc_id] for i, j in linked]
    assert linked and sum(found) >= 0.99 * len(found)
