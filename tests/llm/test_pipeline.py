import random

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import bpe, minhash, queries


def corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    text = docs.where("length(text) > 600").orderBy("doc_id").first().text
    odd = [(None, text, "en", None, 1), (5000, None, "en", "src1", 0), (5001, "", None, "src2", 0), (5002, "### 123", "en", "src3", 7), (5003, text, "en", "src4", len(text)), (5003, text, "en", "src4", len(text))]
    return docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("lang_pred", F.lit("own")).withColumn("kept", F.lit(1))


def test_stages(spark):
    docs = corpus(spark)
    before = {r.doc_id: r.text for r in docs.collect()}
    (_, language), (_, near), (_, strings), (_, mix), (_, encode) = corpus_pipeline.STAGES
    one = language(spark, docs, "").cache()
    assert one.columns == docs.columns
    gone = set(before) - {r.doc_id for r in one.collect()}
    assert gone == {5000, 5001, 5002}
    assert {r.lang_pred for r in one.collect()} == {"own"}

    two = near(spark, one, "").cache()
    assert two.columns == docs.columns
    groups = minhash.near_duplicates(one.select("doc_id", "text")).where("`group` is not null")
    assert two.count() == groups.select("group").distinct().count()
    ids = [r.doc_id for r in two.collect()]
    assert 5003 not in ids and None not in ids and len(set(ids)) == len(ids)

    three = strings(spark, two, "").cache()
    assert three.columns == docs.columns and three.count() == two.count()
    assert three.where("n_chars <> length(text)").count() == 0

    four = mix(spark, three, "").cache()
    assert four.columns == docs.columns
    texts = {r.doc_id: r.text for r in three.collect()}
    assert all(texts[r.doc_id].startswith(r.text) for r in four.collect())

    pairs = bpe.BytePairs(queries.BYTE_PAIRS)
    five = encode(spark, four, "").collect()
    assert sorted(pairs.decode(r.token_ids).decode() for r in five) == sorted(r.text for r in four.collect())


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d e f g", "en", "s", 13)] * 4 + [(1, "z y x w v u t", "en", "s", 13), (1, "", "en", "s", 0), (1, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.text for r in kept) == ["", "", "a b c d e f g", "z y x w v u t"]


def test_empty_and_unlabelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.collect() == []
    unlabelled = docs.limit(20).withColumn("lang", F.lit(None).cast("string"))
    assert corpus_pipeline.language(spark, unlabelled, "").count() == 20


def test_run(spark):
    found = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert found.where("n_tokens > 0").count() > 100


def test_passages_of_fifty_words_go(spark):
    """Passages of 50 to 60 words that two documents share are gone after the string
    stage, and other documents are as they were."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(3, 8)))
    words = lambda n: [word() for _ in range(n)]
    rows, passages = [], {}
    for k in range(30):
        passage = " ".join(words(rng.randint(50, 60)))
        for _ in range(2):
            passages[len(rows)] = passage
            rows.append((len(rows), f"{' '.join(words(40))} {passage} {' '.join(words(40))}", "en", "s", 1))
    clean = {}
    for _ in range(30):
        clean[len(rows)] = " ".join(words(120))
        rows.append((len(rows), clean[len(rows)], "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = {r.doc_id: r.text for r in corpus_pipeline.repeated_strings(spark, docs, "").collect()}
    assert all(left[k] == t for k, t in clean.items())
    assert sum(len(p) >= corpus_pipeline.STRING for p in passages.values()) == len(passages)
    assert all(p[20:-20] not in left[k] and len(left[k].split()) <= 83 for k, p in passages.items())
