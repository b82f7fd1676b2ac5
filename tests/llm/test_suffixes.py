import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm import suffixes


def brute_force(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for d in data:
        for i in range(len(d) - length + 1):
            seen[d[i : i + length]] = seen.get(d[i : i + length], 0) + 1
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(d, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, texts, **parameters):
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, n_spans string").repartition(3)
    found = suffixes.without_repeats(rows, **parameters).withColumn("sha", F.sha2("kept", 256)).orderBy("doc_id").collect()
    return [(r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in found]


def corpus(seed, n=60, alphabet="abé \n", size=300):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(alphabet) for _ in range(k))
    passages = [word(rng.randint(20, 90)) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = [word(rng.randint(0, size)) for _ in range(rng.randint(0, 4))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            cut = rng.randint(0, 15)
            parts.insert(rng.randint(0, len(parts)), p[cut:] if rng.random() < 0.5 else p)
        texts.append("".join(parts))
    texts += [None, "", "short", "ab" * 200, "a" * 130, texts[0], texts[0], texts[3]]
    base = word(400)
    for _ in range(8):
        at = rng.randint(0, 399)
        texts.append(base[:at] + "#" + base[at + 1 :])
    return texts


@pytest.mark.parametrize("seed,length,gram,block", [(1, 40, 12, 7), (2, 40, 40, 5), (3, 33, 8, 3)])
def test_against_all_windows(spark, seed, length, gram, block):
    texts = corpus(seed)
    assert run(spark, texts, length=length, gram=gram, block=block) == brute_force(texts, length)


def test_production_length(spark):
    texts = corpus(4, n=40, alphabet="abcdefgh ", size=900)
    rng = random.Random(9)
    shared = "".join(rng.choice("xyz ") for _ in range(405))
    texts += [texts[i] + shared[rng.randint(0, 8) :] + str(i) for i in range(20)]
    assert run(spark, texts) == brute_force(texts, 400)


def test_empty_table(spark):
    assert run(spark, []) == []
