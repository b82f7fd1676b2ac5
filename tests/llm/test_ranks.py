"""Encoding by ranks against the library; appends, edits and odd texts."""

import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tessera.llm import queries, ranks

LETTERS = "abcdefghijklmnoprstuvwz    \n\t'éüß漢字🙂0123456789.,!\x1c\x85 \xa0<>|"


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def own(request):
    return ranks.Ranks(public_tokenizers.path(request.param), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(own):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})


def drawn(rng, n):
    pool = rng.sample(LETTERS, rng.randint(2, len(LETTERS)))
    return "".join(rng.choice(pool) for _ in range(n))


def test_random_texts(own, library):
    rng = random.Random(1)
    for _ in range(1500):
        text = drawn(rng, rng.randint(0, 150))
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_given_texts(spark, own, library):
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        assert own.encode(row.text or "").tolist() == library.encode_ordinary(row.text or "")


def test_prefixes(own):
    """Every prefix's tokens are those of its bytes; appends and edits change nothing else."""
    raw = tiktoken.Encoding("raw", pat_str=r"(?s).+", mergeable_ranks=own.rank, special_tokens={})
    rng = random.Random(2)
    for _ in range(150):
        word = "".join(rng.choice(["a", "b", "the", "ing", " ", "er", "é", "zz", "  ", "ation"]) for _ in range(rng.randint(1, 40)))
        grown = ranks.Prefixes(own)
        for c in word:
            assert grown.append(c.encode()) == len(c.encode())
        assert grown._last == ranks.Prefixes(own, word.encode())._last
        for k in range(1, len(word) + 1):
            if word[:k].encode() not in own.rank:
                assert grown.tokens(len(word[:k].encode())) == raw.encode_ordinary(word[:k])
        at = rng.randint(0, len(grown.data))
        grown.edit(at, min(rng.randint(0, 9), len(grown.data) - at), rng.choice([b"", b"x", b"the", b" e"]))
        assert grown._last == ranks.Prefixes(own, bytes(grown.data))._last


def test_an_edit_costs_little(own):
    text = b"the quick brown foxes jumped " * 2000
    grown = ranks.Prefixes(own, text)
    assert grown.edit(len(text) // 2, 3, b"xyz") < 4 * own.longest
    assert grown.tokens() == ranks.Prefixes(own, text[: len(text) // 2] + b"xyz" + text[len(text) // 2 + 3 :]).tokens()


def test_edited_texts(own):
    rng = random.Random(3)
    for _ in range(800):
        encoded = ranks.Encoded(own, drawn(rng, rng.randint(0, 80)))
        for _ in range(4):
            at = rng.randint(0, len(encoded.text))
            encoded.edit(at, rng.randint(0, min(8, len(encoded.text) - at)), drawn(rng, rng.randint(0, 5)))
            assert encoded.ids().tolist() == own.encode(encoded.text).tolist()
    long = ranks.Encoded(own, "one two three " * 5000)
    assert long.edit(30_000, 2, "q") < 6


def test_query_against_the_library(spark, library):
    wanted = {}
    for row in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        ids = tiktoken_ids(row.text)
        wanted[row.doc_id] = len(ids), sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha256((row.text or "").encode()).hexdigest()
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_ranks(spark, "/root/testdata/sf0.001").collect()}
    assert found == wanted


def tiktoken_ids(text, known={}):  # noqa: B006
    if not known:
        own = ranks.Ranks(queries.RANKS, public_tokenizers.PATTERN)
        known["library"] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.rank, special_tokens={})
    return known["library"].encode_ordinary(text or "")


def test_odd_rows_and_edits(spark):
    schema = "doc_id long, text string, n_tokens string, edits array<struct<at: int, removed: int, inserted: string>>"
    rows = [(1, None, "x", None), (2, "", "x", []), (3, "hello there", "x", [(5, 0, ","), (0, 1, "J"), None]), (3, "hello there", "x", [(5, 0, ","), (0, 1, "J"), None]), (4, "a" * 3000, "x", [(9999, 5, "!")]), (5, "abc", "x", [(None, None, None)])]
    docs = spark.createDataFrame(rows, schema)
    plain = ranks.with_rank_tokens(docs, queries.RANKS, public_tokenizers.PATTERN)
    assert sorted((r.doc_id, r.n_tokens, r.token_ids) for r in plain.collect()) == sorted((k, len(tiktoken_ids(t)), tiktoken_ids(t)) for k, t, *_ in rows)
    edited = ranks.with_rank_tokens(docs, queries.RANKS, public_tokenizers.PATTERN, edits="edits")
    wanted = {1: "", 2: "", 3: "Jello, there", 4: "a" * 3000 + "!", 5: "abc"}
    assert all(bytes(r.decoded).decode() == wanted[r.doc_id] and r.token_ids == tiktoken_ids(wanted[r.doc_id]) for r in edited.collect())
    assert ranks.with_rank_tokens(docs.where("doc_id > 9"), queries.RANKS, public_tokenizers.PATTERN).collect() == []
    clash = docs.select("doc_id", "text", F.lit(1).alias("decoded"), F.lit(2).alias("ids"))
    assert {r.ids for r in ranks.with_rank_tokens(clash, queries.RANKS, public_tokenizers.PATTERN).collect()} == {2}


def test_one_very_long_match(own):
    word = "".join(random.Random(5).choice(["the", "ing", "q", "zx"]) for _ in range(60_000))
    assert own.decode(own.encode(word)) == word.encode()
