"""Queues, limits and index maintenance as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import tokens
from tessera.sources.sinks import overwrite_by_key, read_store

#: Attempts of a job, and seconds of its first and longest back-off.
MOST_ATTEMPTS, FIRST_WAIT, LONGEST_WAIT = 4, 60, 3600


def stream(spark, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files in a folder, as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def limited_clients(requests: DataFrame, limit: int, seconds: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Clients above a limit of requests in fixed windows; a window is final once
    the watermark has passed it."""
    windows = requests.withWatermark("ts", lateness).groupBy("client", F.window("ts", f"{seconds} seconds").alias("w"))
    return windows.agg(F.count("*").alias("n")).where(F.col("n") > limit).select("client", F.col("w.start").alias("window_start"), "n")


def latest_states(events: DataFrame) -> DataFrame:
    """(job, state, at, attempts) by each job's latest event; an event that comes
    twice changes nothing."""
    once = events.dropDuplicates(["job", "state", "at"])
    return once.groupBy("job").agg(F.max_by("state", "at").alias("state"), F.max("at").alias("at"), F.count_if(F.col("state") == "failed").alias("attempts"))


def with_retries(states: DataFrame) -> DataFrame:
    """States with ``retry_at``: failed jobs wait twice as long each time, until
    their attempts are used up."""
    wait = F.least(FIRST_WAIT * F.pow(F.lit(2), F.col("attempts") - 1), F.lit(LONGEST_WAIT))
    again = (F.col("state") == "failed") & (F.col("attempts") <= MOST_ATTEMPTS)
    return states.withColumn("retry_at", F.when(again, F.timestamp_seconds(F.unix_timestamp("at") + wait)))


def stale(states: DataFrame, now: str, minutes: int = 10, most: int = 50) -> DataFrame:
    """Queued jobs that nobody took, oldest first, some at a time."""
    before = F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES")
    return states.where((F.col("state") == "queued") & (F.col("at") < before)).orderBy("at", "job").limit(most)


def keep_states(events: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """A job table that follows a stream of events.  A batch is merged with the
    rows it touches.  The times of a job's failures are kept as a set, so events that
    come late, or again in any batch, give the same table; a job has few attempts."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        failed = F.array_sort(F.collect_set(F.when(F.col("state") == "failed", F.col("at"))))
        found = batch.groupBy("job").agg(F.max_by("state", F.struct("at", "state")).alias("state"), F.max("at").alias("at"), failed.alias("failures"))
        old = read_store(spark, store)
        if old is not None:
            rows = found.join(old.select("job", F.col("state").alias("s0"), F.col("at").alias("a0"), F.col("failures").alias("f0")), "job", "left")
            newer = F.col("a0").isNull() | (F.col("at") > F.col("a0"))
            failures = F.array_sort(F.array_union("failures", F.coalesce("f0", F.array().cast("array<timestamp>"))))
            found = rows.select("job", F.when(newer, F.col("state")).otherwise(F.col("s0")).alias("state"), F.greatest("at", "a0").alias("at"), failures.alias("failures"))
        overwrite_by_key(spark, store, found.withColumn("attempts", F.size("failures").cast("bigint")), ["job"])

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_postings(chunks: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """An inverted index that follows a stream of chunks: a chunk's postings
    replace what it had; one without text leaves none."""

    def merge(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.groupBy("chunk_id").agg(F.max_by("chunk_text", "at").alias("chunk_text"))
        new = rows.select("chunk_id", F.explode(tokens(F.coalesce("chunk_text", F.lit("")))).alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("tf"))
        # a chunk without tokens keeps a mark, so that its old postings go
        marks = rows.select("chunk_id", F.lit("").alias("token"), F.lit(0).cast("bigint").alias("tf"))
        overwrite_by_key(spark, store, new.unionByName(marks), ["chunk_id"])

    return chunks.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_versions(changes: DataFrame) -> DataFrame:
    """(doc_id, at, values): the last change of each document; null values delete it.
    Of changes at one time, a deletion counts, else the largest array."""
    change = F.struct("at", F.col("values").isNull().alias("deleted"), "values")
    return changes.groupBy("doc_id").agg(F.max(change).alias("c")).select("doc_id", "c.at", F.array_distinct("c.values").alias("values"))


def merge_items(batch: DataFrame, number: int, store: str) -> None:
    """The documents of a batch in a store, each with what it was before the batch, so
    that the batch can be taken again at any moment."""
    spark = batch.sparkSession
    new, old = latest_versions(batch), read_store(spark, store)
    none = F.lit(None).cast("array<string>")
    if old is None:
        rows = new.select("doc_id", "at", "values", F.lit(None).cast(batch.schema["at"].dataType).alias("at_before"), none.alias("before"))
    else:
        again = F.col("o.batch") == number
        at = F.when(again, F.col("o.at_before")).otherwise(F.col("o.at"))
        held = F.when(again, F.col("o.before")).otherwise(F.col("o.values"))
        joined = new.alias("n").join(old.alias("o"), "doc_id", "left").select("doc_id", F.col("n.at").alias("at"), F.col("n.values").alias("values"), at.alias("at_before"), held.alias("before"))
        one, other = (F.struct(a, v.isNull().alias("deleted"), v.alias("v")) for a, v in ((F.col("at"), F.col("values")), (F.col("at_before").alias("at"), F.col("before"))))
        newer = F.col("at_before").isNull() | (one > other)
        rows = joined.select("doc_id", F.when(newer, F.col("at")).otherwise(F.col("at_before")).alias("at"), F.when(newer, F.col("values")).otherwise(F.col("before")).alias("values"), "at_before", "before")
    overwrite_by_key(spark, store, rows.withColumn("batch", F.lit(number).cast("long")), ["doc_id"])


def merge_deltas(spark, number: int, items: str, store: str) -> None:
    """What a batch changed in the counts of values, under its number: a batch that is
    taken again replaces what it wrote."""
    rows = read_store(spark, items).where(F.col("batch") == number)
    gained = F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"), F.lit(1).alias("d")))
    lost = F.transform(F.coalesce("before", F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"), F.lit(-1).alias("d")))
    found = rows.select(F.explode(F.concat(gained, lost)).alias("c")).groupBy("c.value").agg(F.sum("c.d").alias("delta")).where("delta <> 0")
    mark = spark.createDataFrame([(None, 0)], "value string, delta long")  # a batch without changes replaces too
    overwrite_by_key(spark, store, found.unionByName(mark).withColumn("batch", F.lit(number).cast("long")), ["batch"])


def facet_counts(spark, store: str) -> DataFrame:
    """(value, n): how many documents have each value now."""
    rows = read_store(spark, store)
    return rows.groupBy("value").agg(F.sum("delta").alias("n")).where("value IS NOT NULL AND n <> 0")


def compact_deltas(spark, store: str, before: int) -> None:
    """The counts of all batches before one under one number, in one step."""
    rows = read_store(spark, store).where(F.col("batch") < before)
    totals = rows.groupBy("value").agg(F.sum("delta").alias("delta")).where("delta <> 0 OR value IS NULL").withColumn("batch", F.lit(-1).cast("long"))
    marks = rows.where("batch >= 0").select(F.lit(None).cast("string").alias("value"), F.lit(0).cast("long").alias("delta"), "batch").distinct()
    overwrite_by_key(spark, store, totals.unionByName(marks), ["batch"])


def keep_facets(changes: DataFrame, items: str, store: str, checkpoint: str) -> StreamingQuery:
    """Counts of values that follow a stream of changes (doc_id, at, values): inserts,
    updates and deletions, in any order and batches, some of them more than once.  A
    batch touches the documents that it names only; their former values are
    taken back."""

    def merge(batch: DataFrame, number: int) -> None:
        merge_items(batch, number, items)
        merge_deltas(batch.sparkSession, number, items, store)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
