"""Token counts, encoding, language, quality: each against a plainer way."""

import random
import unicodedata
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import bpe, langid, quality, queries, wordpiece

ODD = [None, "", " ", "\n\n", "a", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "don't I'LL we've 12345 ½ ²", "​\U0001f600\x00\xa0\xad", "aaaa" * 300, "   x  \n\n y\t", "é" * 50, "日本語 テキスト", "#### $$$ %%%", "word " * 400]


def documents(spark, folder="/root/testdata/sf0.001"):
    return spark.read.parquet(f"{folder}/documents.parquet")


def with_odd(spark, extra=""):
    rows = [(i, t, t) for i, t in enumerate(ODD)] + [(0, "a", None), (None, "b c", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").repartition(3)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_is_the_library(spark, tokenizer):
    rows = with_odd(spark).unionByName(documents(spark).select("doc_id", "text", F.lit("").alias("n_tokens")))
    found = bpe.with_tokens(rows, queries.BYTE_PAIRS, outputs=tuple(bpe.OUTPUTS)).collect()
    assert len(found) == rows.count()
    for r in found:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        text = tokenizer.decode(ids, skip_special_tokens=False)
        assert (r.token_ids, r.n_tokens, r.decoded) == (ids, len(ids), text)
        assert r.ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_bpe_on_random_text(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    pairs, rng = bpe.BytePairs(queries.BYTE_PAIRS), random.Random(1)
    for _ in range(1500):
        text = "".join(rng.choice("abcdeinorstuh  thereing'’é\n\t0123ßœ") for _ in range(rng.randint(1, 80)))
        assert pairs.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert pairs.decode(pairs.encode(text)).decode() == text


def test_every_token_is_one(tokenizer):
    pairs = bpe.BytePairs(queries.BYTE_PAIRS)
    for text, (ids, _) in pairs._whole.items():
        if pairs._split(text) == [text]:
            assert np.frombuffer(ids, np.int32).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def greedy(word, initial, inner):
    at, n, pieces = 0, 0, initial
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n, pieces = end, n + 1, inner
    return n


def test_longest_match_is_greedy():
    rng = random.Random(2)
    for _ in range(60):
        make = lambda: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        initial, inner = make(), make()
        match = wordpiece.LongestMatch(initial, inner)
        for _ in range(80):
            word = "".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))
            assert match.count(word) == greedy(word, initial, inner), (word, initial, inner)


def test_piece_counts_of_documents(spark):
    match = wordpiece.from_sentencepiece(queries.PIECES)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    initial, inner = {p[1:] for p in pieces if p[0] == "▁" and len(p) > 1}, {p for p in pieces if "▁" not in p}
    rows = documents(spark).select("doc_id", "text").limit(60).unionByName(with_odd(spark).select("doc_id", "text"))
    for r in wordpiece.with_piece_counts(rows, queries.PIECES).collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        counts = [greedy(w, initial, inner) for w in words]
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(words), sum(c or 1 for c in counts), counts.count(0))
    assert match.count("") == 0


def test_language(spark):
    docs = documents(spark, "/root/testdata/sf0.01").withColumn("held", langid.held_out())
    model = langid.train(docs.where("not held"))
    found = langid.with_language(docs, model)
    rows = found.where("held").select("lang", "lang_pred", "score").collect()
    assert len(rows) > 150
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.99
    assert all(0 <= r.score <= 1 for r in rows)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(with_odd(spark).where("n_tokens is null or doc_id > 0"), model).collect()}
    assert odd[1] == odd[2] == odd[13] == ("und", 0.0)
    none = langid.train(docs.where("false"))
    assert {r.lang_pred for r in langid.with_language(docs.limit(5), none).collect()} == {"und"}
    again = langid.train(docs.where("not held"))
    assert np.array_equal(again.weights, model.weights) and again.temperature == model.temperature


def test_held_out_is_crc32(spark):
    import zlib

    rows = spark.range(200).withColumnRenamed("id", "doc_id").withColumn("held", langid.held_out()).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def plain_counts(text):
    text = text or ""
    words = [w for w in text.encode().split()]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    chars = sum(c not in " \t\n\v\f\r" for c in text)
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), chars, sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_counts_and_verdicts(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    known = quality.references(docs)
    assert sorted(known) == ["de", "en", "es", "fr"]
    short = docs.where("length(text) < 6000").unionByName(with_odd(spark).select("doc_id", "text", F.lit(None).cast("string").alias("lang")))
    for r in quality.with_quality(short, known).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_counts(r.text)
        if r.base_failed:
            assert not r.kept
    noise = " ".join(f"w{i}### {i}&&&" for i in range(60))
    clean = docs.where("lang = 'en' and length(text) between 1500 and 4000").first().text
    rows = spark.createDataFrame([(1, noise), (2, clean)], "doc_id long, text string")
    verdict = {r.doc_id: r.kept for r in quality.with_quality(rows, known).collect()}
    assert verdict[1] is False and verdict[2] is True
    assert quality.references(docs.where("false")) == {}


def test_distance_is_jensen_shannon():
    a, b = np.array([3.0, 1, 0]), np.array([1.0, 1, 2])
    p, q = a / 4, b / 4
    m = (p + q) / 2
    kl = lambda x: sum(v * np.log2(v / w) for v, w in zip(x, m) if v)
    assert abs(quality.distance(a, b) - ((kl(p) + kl(q)) / 2) ** 0.5) < 1e-12
    assert quality.distance(a, a) == 0 and quality.distance(a, 0 * a) == 1
    assert unicodedata.category("a") == "Ll" and quality.class_histogram("Ab 1é")[0] == 2
