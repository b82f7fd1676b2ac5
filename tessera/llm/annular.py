"""Vector codes by product quantisation; nearest entries by annular norm pruning.

Vectors become integers, and are cut into parts with a codebook each.  The entries
of a codebook are sorted by norm.  As two vectors are at least as far apart as their
norms, an entry at the current best distance d or nearer has a norm within d of the
part's: a binary search finds that interval, the entries in it are compared exactly,
borders included, from the nearest norm outwards, and it shrinks with d.

A round sums, in each task, the parts of every entry; what is gathered on the driver
is one number for each component of each entry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.arrow import prepare_workers
from tessera.plans.lineage import settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Rows of totals by label that are broadcast at most; more are joined by label.
LABELS_BROADCAST = 100_000
#: Rows compared at a time.
SLICE = 4096


def borders(size: int) -> list[int]:
    """Where the parts of a vector begin and end; equal ones if size divides."""
    return [size * k // PARTS for k in range(PARTS + 1)]


class Codebook:
    """Entries of one part, ready for the search."""

    def __init__(self, entries: np.ndarray):
        self.entries = np.asarray(entries, np.int64)
        norms = np.sqrt((self.entries.astype(np.float64) ** 2).sum(1))
        self._order = np.argsort(norms, kind="stable")
        self._norms = norms[self._order]
        self._sorted = self.entries[self._order]
        self._most = int(np.abs(self.entries).max(initial=0))

    def _annulus(self, norms: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry within, and first beyond; rounding only ever widens it."""
        reach = np.sqrt(best.astype(np.float64))
        slack = (norms + reach) * 1e-12 + 1e-6
        return np.searchsorted(self._norms, norms - reach - slack, "left"), np.searchsorted(self._norms, norms + reach + slack, "right")

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of each row's nearest entry, the lower of equally near ones, their
        squared distance, and how many distances were computed in all."""
        count, width = len(self.entries), parts.shape[1]
        most = max(self._most, int(np.abs(parts).max(initial=0)))
        # whole numbers below 2^53 are exact in double precision, which is faster
        kind = np.float64 if 4 * most * most * max(width, 1) < 1 << 53 else np.int64
        rows, entries = parts.astype(kind), self._sorted.astype(kind)

        def distance(at, candidates: np.ndarray) -> np.ndarray:
            apart = rows[at] - entries[candidates]
            return np.einsum("ij,ij->i", apart, apart)

        norms = np.sqrt((parts.astype(np.float64) ** 2).sum(1))
        right = np.minimum(np.searchsorted(self._norms, norms), count - 1)
        left = np.maximum(right - 1, 0)
        start = np.where(norms - self._norms[left] < self._norms[right] - norms, left, right)
        best, chosen, done = distance(slice(None), start), self._order[start], len(rows)
        low, high = self._annulus(norms, best)
        for step in range(1, count):
            for candidates in (start - step, start + step):
                at = np.flatnonzero((candidates >= low) & (candidates < high))
                if not len(at):
                    continue
                done += len(at)
                found, index = distance(at, candidates[at]), self._order[candidates[at]]
                better = (found < best[at]) | ((found == best[at]) & (index < chosen[at]))
                at = at[better]
                best[at], chosen[at] = found[better], index[better]
                low[at], high[at] = self._annulus(norms[at], best[at])
        return chosen, best.astype(np.int64), done


def _matrices(batches: Iterable[pa.RecordBatch], column: int, size: int) -> Iterable[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows, with their vectors as a matrix."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE):
            rows = batch.slice(k, SLICE)
            yield rows, rows.column(column).flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, size).astype(np.int64)


def _sums(books: Sequence[np.ndarray], size: int) -> Callable:
    """Of a task's vectors: the sum of each component of the parts that each entry
    has, and the number of parts, as (cell, n, total)."""
    cuts = borders(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        totals = np.zeros((ENTRIES, size), np.int64)
        counts = np.zeros((ENTRIES, size), np.int64)
        for _, x in _matrices(batches, 0, size):
            for book, a, b in zip(searched, cuts, cuts[1:]):
                index, _, _ = book.nearest(x[:, a:b])
                own = np.zeros((len(x), ENTRIES))
                own[np.arange(len(x)), index] = 1
                # sums of SLICE components of 31 bits are exact in double precision
                totals[:, a:b] += (own.T @ x[:, a:b].astype(np.float64)).astype(np.int64)
                counts[:, a:b] += own.sum(0).astype(np.int64)[:, None]
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (cells, counts.ravel()[cells], totals.ravel()[cells])], names=["cell", "n", "total"])

    return run


def _coded(books: Sequence[np.ndarray], size: int, at: int) -> Callable:
    """Rows with their code and error in place of the vector."""
    cuts = borders(size)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        searched = [Codebook(b) for b in books]
        digits = np.array([f"{k:02x}" for k in range(256)])
        for rows, x in _matrices(batches, at, size):
            code, error = np.full(len(x), "", "U32"), np.zeros(len(x), np.int64)
            for book, a, b in zip(searched, cuts, cuts[1:]):
                index, apart, _ = book.nearest(x[:, a:b])
                code, error = np.char.add(code, digits[index]), error + apart
            kept = [rows.column(k) for k in range(rows.num_columns) if k != at]
            names = [n for k, n in enumerate(rows.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(code), pa.array(error)], names=[*names, "code", "error"])

    return run


def trained(vectors: DataFrame, key: str, size: int, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The final codebook of each part.  ``vectors`` holds a key and vectors of whole
    numbers, all of that size; repeated keys are ordered by their vectors."""
    first = vectors.orderBy(F.col(key).asc_nulls_last(), "vector").limit(ENTRIES).select("vector").toArrow().column(0).to_pylist()
    seeds = np.array(first, np.int64).reshape(len(first), size)
    cuts = borders(size)
    books = [seeds[:, a:b].copy() for a, b in zip(cuts, cuts[1:])]
    for _ in range(rounds if first else 0):
        cells = vectors.select("vector").mapInArrow(_sums(books, size), "cell long, n long, total long")
        found = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
        cell, n, total = (found.column(c).to_numpy() for c in ("cell", "n", "total"))
        entry, place = np.divmod(cell, size)
        means = np.zeros((ENTRIES, size), np.int64)
        means[entry, place] = total // n
        used = np.zeros((ENTRIES, size), bool)
        used[entry, place] = True
        books = [np.where(used[: len(book), a:b], means[: len(book), a:b], book) for book, a, b in zip(books, cuts, cuts[1:])]
    return books


def digest(books: Sequence[np.ndarray]) -> str:
    """SHA-256 of all entries' components, joined by commas."""
    return sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def whole(vectors: DataFrame, vector: str) -> DataFrame:
    """Rows (key, label, a vector) whose vector has finite numbers only, with it as
    ``vector`` of whole numbers, floor(SCALE * x)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    bound = F.least(F.lit(float((1 << 31) - 1)), F.floor(F.sqrt(F.lit(float(1 << 60)) / F.greatest(F.size(vector), F.lit(1)))).cast("double"))
    rows = vectors.withColumn(vector, F.col(vector).cast("array<double>")).where(F.col(vector).isNotNull() & finite).withColumn("bound", bound)
    floors = F.transform(vector, lambda x: F.greatest(-F.col("bound"), F.least("bound", F.floor(F.greatest(F.lit(-1e15), F.least(F.lit(1e15), x)) * SCALE).cast("double"))).cast("int"))
    return rows.withColumn(vector, floors).withColumnRenamed(vector, "vector").drop("bound")


def with_codes(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", rounds: int = ROUNDS) -> DataFrame:
    """(key, label, code, error, label_error, codebooks_sha256) of each vector.

    A row whose vector is null, or holds null or a number that isn't finite, is
    left out.  The size of vectors is that of the least key; rows of another have
    no part in the codebooks, a null code and null error, and parts differ by one
    component where PARTS doesn't divide the size.  Fewer than ENTRIES rows give as
    many entries; an empty vector has code 0 and error 0.  Repeated rows and keys
    count as any others, a null key comes last, null labels are one label.
    Components so large that squared distances might not fit a long count as the
    largest that fit (over 32,767 at 64 components); sums of labels that don't are
    null.  Further columns are not looked at; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    rows = settle(whole(vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").alias("embedding")), "embedding"))
    first = rows.orderBy(F.col("key").asc_nulls_last(), "vector").limit(1).select(F.size("vector").alias("size")).collect()
    size = first[0].size if first else 0
    fitting = rows.where(F.size("vector") == size)
    books = trained(fitting.select("key", "vector"), "key", size, rounds)
    schema = f"key {rows.schema['key'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    coded = fitting.select("key", "label", "vector").mapInArrow(_coded(books, size, 2), schema)
    other = rows.where(F.size("vector") != size).select("key", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = settle(coded.unionByName(other))
    totals = settle(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of"), narrow=True)
    few = totals.limit(LABELS_BROADCAST + 1).count() <= LABELS_BROADCAST
    found = coded.join(F.broadcast(totals) if few else totals, F.col("label").eqNullSafe(F.col("of")))
    return found.select(F.col("key").alias(key), F.col("label").alias(label), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
