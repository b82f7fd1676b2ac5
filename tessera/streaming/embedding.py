"""An embedding stage: texts in batches through an embedder, failures as rows, pages that
can be resumed, and diagnostics of what the stage did.

The embedder is a parameter, any function from texts to vectors that tasks can import;
``hashed`` stands in for a model: it needs none, and gives equal texts equal vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans.arrow import prepare_workers
from tessera.sources.sinks import overwrite_by_key, read_store

#: Texts that an embedder takes at a time, and tries of a batch.
BATCH, TRIES = 64, 2
#: Numbers of a stand-in vector.
SIZE = 64
#: Fixed value: what is put before a query, for models that tell queries from passages.
INSTRUCTION = "Represent this sentence for searching relevant passages: "


def hashed(texts: Sequence[str]) -> np.ndarray:
    """Unit vectors of hashed words: each adds 1 or takes it at a place of its own."""
    found = np.zeros((len(texts), SIZE))
    for k, text in enumerate(texts):
        for word in text.lower().split():
            value = int.from_bytes(blake2b(word.encode(), digest_size=8).digest(), "little")
            found[k, value % SIZE] += 1 if value >> 32 & 1 else -1
    norms = np.sqrt((found * found).sum(1, keepdims=True))
    return np.divide(found, norms, out=found, where=norms > 0)


_SCHEMA = pa.schema([("id", pa.int64()), ("vector", pa.list_(pa.float32())), ("error", pa.string()), ("tries", pa.int32())])


def _stage(embed: Callable, batch_size: int, tries: int, prefix: str) -> Callable:
    """Vectors or errors of rows (id, text).  A batch that fails is tried again, and then
    text by text, so that one text costs the others nothing."""

    def attempted(texts: list[str]) -> tuple[list, str | None, int]:
        problem = None
        for k in range(tries):
            try:
                found = np.asarray(embed([prefix + t for t in texts]), np.float32)
                if found.ndim != 2 or len(found) != len(texts) or not np.isfinite(found).all():
                    raise ValueError("the embedder gave no finite vector for each text")
                return list(found), None, k + 1
            except Exception as failure:  # noqa: BLE001 - whatever a model raises becomes a row
                problem = f"{type(failure).__name__}: {failure}"[:300]
        return [], problem, tries

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, batch_size):
                part = batch.slice(start, batch_size)
                ids, texts = part.column(0).to_pylist(), [t or "" for t in part.column(1).to_pylist()]
                vectors, problem, took = attempted(texts)
                rows = [(i, v, None, took) for i, v in zip(ids, vectors)]
                if problem is not None:
                    for i, t in zip(ids, texts):
                        one, why, own = attempted([t])
                        rows.append((i, one[0] if one else None, why, took + own))
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)

    return run


def embedded(rows: DataFrame, key: str, text: str, embed: Callable = hashed, batch_size: int = BATCH, tries: int = TRIES, query: bool = False) -> DataFrame:
    """(id, vector, error, tries) of rows: the vector, or why there is none.  A null text
    is empty; rows that repeat come as often."""
    prepare_workers(rows.sparkSession)
    given = rows.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    return given.mapInArrow(_stage(embed, batch_size, tries, INSTRUCTION if query else ""), "id long, vector array<float>, error string, tries int")


def backfill(spark: SparkSession, rows: DataFrame, key: str, text: str, store: str, page: int, embed: Callable = hashed, retry: bool = False) -> dict[str, int]:
    """Embed the next page of rows that the store lacks, by key, and write them with their
    errors; the counts of the store then.  A page that fails as a whole wrote nothing, so calling
    again goes on from what is there.  ``retry`` takes rows with errors again."""
    done = read_store(spark, store)
    left = rows.where(F.col(f"`{key}`").isNotNull())
    if done is not None:
        left = left.join((done.where("error IS NULL") if retry else done).select(F.col("id").alias(key)), key, "left_anti")
    found = embedded(left.orderBy(key).limit(page), key, text, embed)
    overwrite_by_key(spark, store, found, ["id"])
    return diagnostics(read_store(spark, store))


def diagnostics(stored: DataFrame) -> dict[str, int]:
    """Counts of a store: rows, vectors, errors, those that needed another try, and kinds
    of errors."""
    kind = F.substring_index("error", ":", 1)
    row = stored.agg(F.count("*").alias("rows"), F.count("vector").alias("vectors"), F.count("error").alias("errors"), F.count_if(F.col("tries") > 1).alias("tried_again"), F.count_distinct(kind).alias("kinds_of_errors")).first()
    return row.asDict()
