"""From raw documents to tokens, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs.  Nulls in any column, repeated rows and columns of
any further names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, langid, minhash, mixing, queries, suffixes
from tessera.plans.lineage import settle

#: Least calibrated probability of a document's language.
LEAST_SCORE = 0.5
#: Bytes of a string that the string stage removes, and of its first buckets:
#: passages of 50 words of prose are rarely shorter.
STRING, GRAM = 240, 80


def _packed(docs: DataFrame) -> DataFrame:
    """(__rest, text): so that no other column can clash with a result."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__rest"), "text")


def _unpacked(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """docs' columns again; n_chars follows the text."""
    length = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    found = [F.col("text") if c == "text" else length.alias(c) if c == "n_chars" else F.col(f"__rest.`{c}`") for c in docs.columns]
    return rows.select(*found)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised, by a model of the table's own
    labels; if it has none, documents with a letter."""
    model = langid.train(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    judged = langid.with_language(_packed(docs), model)
    sure = (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return judged.where(sure).select(*[F.col("text") if c == "text" else F.col(f"__rest.`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that with the least doc_id, then the
    least hash of the text; texts without a word are in no group and stay."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"))
    grouped = found.where("`group` IS NOT NULL").groupBy("group", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key", "n")
    kept = grouped.groupBy("group").agg(F.min(first).alias("kept")).select("kept.*")
    alone = found.where("`group` IS NULL").select("doc_id", "text_key", F.lit(1).cast("long").alias("n")).distinct()
    kept = kept.select("doc_id", "text_key", "n").unionByName(alone).toDF("__id", "__text_key", "__n")
    rows = _packed(docs).withColumn("__key", F.xxhash64("text"))
    rows = rows.join(kept, F.col("__rest.doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__text_key")))
    several = rows.where("__n > 1").groupBy("__id", "__key").agg(F.first("__rest").alias("__rest"), F.first("text").alias("text"))
    rows = rows.where("__n = 1").select("__rest", "text").unionByName(several.select("__rest", "text"))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"__rest.`{c}`") for c in docs.columns])


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without what lies in strings of STRING bytes that start more
    than once in the stage's input, all copies included; a character that a cut
    goes through goes too.  A null text becomes empty, texts shorter than STRING
    stay, and so do documents of which nothing is left; an empty table is one."""
    cut = suffixes.without_repeats(_packed(docs), length=STRING, gram=GRAM, decode=True, drop_text=True)
    return _unpacked(cut.withColumnRenamed("kept", "text"), docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, documents taken more than once in as many rows, and the
    last time perhaps with their first words only.  Documents with a null text or
    no word have no part in it; null is a source of its own; rows that repeat are
    taken as one, as often as all of them; an empty table gives one."""
    rows = _packed(docs).select("__rest", "text", F.col("__rest.doc_id").alias("__id"), F.col("__rest.source").alias("__from"))
    return _unpacked(mixing.mixed_rows(rows, key="__id", source="__from"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each row, with doc_id and source: ``n_tokens``, ``token_ids``,
    and digests of the ids and of the text that they decode to.  A null or empty
    text has no tokens; repeated rows repeat; an empty table gives one."""
    rows = docs.select("doc_id", "source", "text")
    return bpe.with_tokens(rows, queries.BYTE_PAIRS, outputs=("n_tokens", "token_ids", "ids_sha256", "decoded_sha256"), drop_text=True)


STAGES = [
    ("language_id", language),
    ("minhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_strings),
    ("mixing", mix),
    ("bpe", encode),
]

#: Several stages can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs)
    return docs
