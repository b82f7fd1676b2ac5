"""Shards of bounded bytes by extendible hashing.

A shard is a prefix of the bits of a key's hash.  Only the prefixes that hold
more bytes than the limit are split on another bit.  The directory grows by
STEP bits a round: a round sums the bytes of the cells below the prefixes that
are still too large, and takes for each cell the shortest prefix that fits.
Only DataFrame functions are used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.copies import numbered
from tessera.plans.lineage import settle

#: Bits of the hash.
BITS = 60
#: Bits by which a round deepens the directory.
STEP = 8
#: Bytes in a shard at most.
LIMIT = 32 << 20


def _prefix(depth: int):
    return F.shiftright("hash", BITS - depth)


def assign_shards(docs: DataFrame, limit: int = LIMIT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of docs: the key, ``n_bytes`` of its text in UTF-8,
    and its shard: ``depth`` bits, their value ``prefix``, ``page``, and
    ``shard_bytes``, the sum over the prefix.

    The hash covers key and text, so rows of one hot key spread as well.  Rows
    equal in both can't be told apart by any hash; where they alone exceed the
    limit, they fill the pages 0, 1, ... of their prefix, as many in each as
    fit, one at least.  Only a single text above the limit makes a page larger.
    A null text has 0 bytes; a null key hashes as an empty one.  Further columns
    of docs are not returned; texts of any length are read whole, and an empty
    table gives no rows.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col(key).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")))))
    groups = settle(
        docs.select(F.col(key).alias("key"), size.alias("n_bytes"), F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long").alias("hash"))
        .groupBy("key", "n_bytes", "hash")
        .agg(F.count("*").alias("copies"))
    )
    placed, live, depth = [], groups, 0
    while True:
        deeper = min(depth + STEP, BITS)
        cells = live.groupBy(_prefix(deeper).alias("cell")).agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("bytes"), F.count("*").alias("groups"))
        cells = settle(cells)
        levels = cells.select("*", F.explode(F.sequence(F.lit(depth), F.lit(deeper))).alias("depth"))
        levels = levels.withColumn("prefix", F.expr(f"cell DIV CAST(power(2, {deeper} - depth) AS BIGINT)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("groups").alias("groups"))
        sums = sums.where((F.col("shard_bytes") <= limit) | (F.col("groups") == 1) | (F.col("depth") == BITS))
        fits = levels.select("cell", "depth", "prefix").join(sums.drop("groups"), ["depth", "prefix"])
        directory = settle(fits.groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("shard")))
        placed.append(live.withColumn("cell", _prefix(deeper)).join(directory, "cell").select("key", "n_bytes", "copies", "shard.*"))
        if deeper == BITS or cells.join(directory, "cell", "left_anti").isEmpty():
            break
        live = settle(live.withColumn("cell", _prefix(deeper)).join(directory, "cell", "left_anti").drop("cell"))
        depth = deeper
    rows = settle(reduce(DataFrame.unionByName, placed))
    each = F.greatest(F.lit(1), F.expr(f"{limit} DIV greatest(n_bytes, 1)"))
    alone = F.col("copies") * F.col("n_bytes") == F.col("shard_bytes")
    return (
        numbered(rows, "copies", "nth")
        .withColumn("page", F.when(alone & (F.col("shard_bytes") > limit), F.expr("nth") / each).otherwise(0).cast("long"))
        .select(F.col("key").alias(key), "n_bytes", "depth", "prefix", "page", "shard_bytes")
    )
