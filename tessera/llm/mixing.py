"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code point order, null last, take the weights in turn and
share a multiple of all words by weight; no target exceeds a multiple of its
source's words, and the excess goes to the others by weight.  Documents fall
into shards by a hash.  In every shard, blocks of equal words go to the sources
by the highest quotients target / (2 k + 1), which makes integer quotas; then
each source's documents of the shard, in seeded order, fill its quota, in full
rounds first.  Shards hold a bounded number of words, so no source gathers in
one task.  Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.copies import numbered
from tessera.plans.lineage import settle

WEIGHTS = (5, 2, 1)
#: Words of the mix for each word of the input, and of a source at most.
TOTAL, REPEATS = 1.5, 2
#: Words in a block, and about in a shard.
BLOCK, SHARD = 16, 65_536
#: A source takes part in so many blocks a shard at least, or in fewer shards.
BLOCKS_A_SHARD = 64
SEED = 7

WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str):
    """Words of a text column; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """From (source, size): source, source_size, target, place.  One row for each
    source; its number, not that of the documents, bounds the single window."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    sources = sources.withColumn("place", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    sources = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")))
    cap = F.lit(float(repeats)) * F.col("source_size")
    before = everything.orderBy(cap / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    sources = sources.select(
        "*",
        cap.alias("cap"),
        (F.lit(float(total)) * F.sum("source_size").over(everything)).alias("all"),
        F.coalesce(F.sum(cap).over(before), zero).alias("cap_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).alias("weight_left"),
    )
    capped = (F.col("all") - F.col("cap_before")) * F.col("weight") >= F.col("cap") * F.col("weight_left")
    sources = sources.withColumn("capped", capped)
    free = F.col("all") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("weight"))).over(everything)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("weight") / open_weight)
    return sources.select("source", "source_size", target.alias("target"), "place")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK, shard: int = SHARD, seed: int = SEED, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, repeats: int = REPEATS) -> DataFrame:
    """One row for each row of docs: key, source, ``text_hash`` (md5 of the text, null
    if that is null), size, source_size, target and ``taken``, the words that the
    mix takes with repeats, at most ``repeats`` times the size.

    A null text has no words and is never taken; null is a source of its own.  A
    document's place hangs on its key, its text and, of rows equal in these, its
    number, so neither null nor repeated keys nor repeated rows gather in a shard.
    Equal rows can't be told apart, so reruns agree.  Further columns of docs are
    not returned; an empty table gives no rows.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), F.md5(text).alias("text_hash"), n_words(text).alias("size"))
    rows = settle(rows.groupBy("key", "source", "text_hash", "size").agg(F.count("*").alias("copies")))
    empty = F.lit("")
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("key").cast("string"), empty), F.coalesce("text_hash", empty), F.col("nth").cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 12), 16, 10).cast("long")
    sizes = settle(numbered(rows, "copies", "nth").drop("copies").select("*", number(1).alias("where"), number(13).alias("order")))
    sources = source_targets(sizes, weights, total, repeats)
    everything = Window.partitionBy(F.lit(0))
    shards = F.greatest(F.lit(1.0), F.ceil(F.sum("source_size").over(everything) / shard))
    own = F.least(shards, F.greatest(F.lit(1.0), F.ceil(F.col("target") / (block * BLOCKS_A_SHARD))))
    sources = settle(sources.select("*", shards.cast("long").alias("shards"), own.cast("long").alias("own_shards")))

    near = sources.withColumnRenamed("source", "of")
    rows = sizes.join(near, sizes["source"].eqNullSafe(near["of"])).drop("of")
    rows = rows.withColumn("shard", F.expr("((`where` % own_shards) * shards) DIV own_shards"))

    # what each source should have of each shard, and the shard's blocks
    parts = rows.groupBy("shard", "place").agg(F.sum("size").alias("part"), F.min("target").alias("target"), F.min("source_size").alias("source_size"))
    in_shard = Window.partitionBy("shard")
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("part") / F.col("source_size")).otherwise(0.0)
    parts = parts.select("shard", "place", "part", F.round(share, 6).alias("want"))
    parts = parts.select("*", F.round(F.sum("want").over(in_shard), 4).alias("all"), F.count("*").over(in_shard).alias("n"))
    parts = parts.withColumn("blocks", F.round(F.col("all") / block).cast("long"))
    exact = F.when(F.col("all") > 0, F.col("want") / F.col("all") * F.col("blocks")).otherwise(0.0)
    # a source's seats differ from its exact share by less than this
    reach = F.ceil(F.when(F.col("all") > 0, F.col("want") / F.col("all") * F.col("n") / 2).otherwise(0.0)) + 2
    parts = parts.withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor(exact) - reach)).withColumn("most", F.floor(exact) + reach)
    seats = parts.where("want > 0").withColumn("open", F.col("blocks") - F.sum("sure").over(in_shard))
    seats = seats.select("shard", "place", "want", "sure", "open", F.explode(F.sequence("sure", "most")).alias("k"))
    ranked = seats.withColumn("rank", F.row_number().over(in_shard.orderBy((F.col("want") / (2 * F.col("k") + 1)).desc(), "place", "k")))
    quota = ranked.groupBy("shard", "place").agg((F.min("sure") + F.sum((F.col("rank") <= F.col("open")).cast("long"))).alias("quota"))

    parts = parts.select("shard", "place", "part").join(quota, ["shard", "place"], "left")
    words = F.least(F.coalesce(F.col("quota"), F.lit(0)) * block, repeats * F.col("part"))
    parts = parts.select("shard", "place", "part", words.alias("words"))
    rows = rows.join(parts, ["shard", "place"])
    earlier = Window.partitionBy("shard", "place").orderBy("order", "key", "size", "text_hash", "nth").rowsBetween(Window.unboundedPreceding, -1)
    rounds = F.expr("words DIV greatest(part, 1)")
    rest = F.col("words") - rounds * F.col("part") - F.coalesce(F.sum("size").over(earlier), F.lit(0))
    taken = rounds * F.col("size") + F.least(F.greatest(rest, F.lit(0)), F.col("size"))
    return rows.select(F.col("key").alias(key), F.col("source").alias(source), "text_hash", "size", "source_size", "target", taken.cast("long").alias("taken"))


def first_words(text: str, n: str):
    """The text up to the end of its n-th word."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    return F.array_join(F.slice(parts, F.lit(1), F.col(n).cast("int")), "")


def mixed_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken in full, and once
    more with its first words for the rest; rows with nothing taken are left out.
    Of rows equal in key, source and text, one stands for all.  All columns of docs
    are kept, whatever their names.
    """
    taken = mix(docs, key, text, source, **parameters).toDF("key", "source", "hash", "size", "of", "target", "taken")
    taken = taken.groupBy("key", "source", "hash").agg(F.sum("taken").alias("taken"), F.min("size").alias("size"), F.count("*").alias("n")).where("taken > 0")
    # docs' own columns travel in a struct without their names
    own = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c != text])
    rows = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"), F.col(f"`{key}`").alias("own_key"), F.col(f"`{source}`").alias("own_source"), F.md5(text).alias("own_hash"))
    same = F.col("own_key").eqNullSafe(F.col("key")) & F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own_hash") == F.col("hash"))
    rows = rows.join(taken, same)
    names = ["own", "text", "taken", "size"]
    several = rows.where("n > 1").groupBy("key", "source", "hash").agg(F.first(F.struct(*names)).alias("row")).select("row.*")
    rows = rows.where("n = 1").select(*names).unionByName(several).withColumn("rest", F.col("taken") % F.col("size"))
    full = F.array_repeat("text", F.expr("taken DIV size").cast("int"))
    last = F.when(F.col("rest") > 0, F.array(first_words("text", "rest"))).otherwise(F.array().cast("array<string>"))
    rows = rows.select("own", F.explode(F.concat(full, last)).alias("text"))
    return rows.select(*[F.col("text").alias(c) if c == text else F.col(f"own.c{i}").alias(c) for i, c in enumerate(docs.columns)])
