"""The rows that match lists of words best, for very many lists at once.

Lists times rows is the work, so nothing that large is made a table: a task holds a
block of rows as a matrix of words, adds up its lines for each list, and keeps the best
rows of each list so far.  What leaves a task is bounded by lists times ``most``."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.arrow import prepare_workers
from tessera.plans.lineage import settle

#: Cells of a block's matrix, and lists that are added up at once.
_CELLS, _LISTS = 1 << 22, 1 << 10
#: Bits for the weight of a match behind the number of words.
_WEIGHT = 40


def _best(vocabulary: list[str], lists: np.ndarray, most: int):
    """lists: rows of places in the vocabulary, filled up with its size."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        words, size = pa.array(vocabulary, pa.string()), len(vocabulary)
        score, ids = np.zeros((len(lists), most), np.int64), np.zeros((len(lists), most), np.int64)
        wide = max(16, min(512, _CELLS // (size + 1)))
        for batch in batches:
            held, found = batch.column(0).to_numpy(), batch.column(1)
            lengths = np.diff(found.offsets.to_numpy())
            token, weight = found.flatten().flatten()
            at = np.repeat(np.arange(len(held)), lengths)
            place = pc.fill_null(pc.index_in(token, words), size).to_numpy()
            known = place < size
            at, place, value = at[known], place[known], (np.int64(1) << _WEIGHT) + weight.to_numpy()[known]
            for first in range(0, len(held), wide):
                low, high = np.searchsorted(at, (first, first + wide))
                matrix = np.zeros((size + 1, min(wide, len(held) - first)), np.int64)
                matrix[place[low:high], at[low:high] - first] = value[low:high]
                own = held[first : first + wide]
                for k in range(0, len(lists), _LISTS):
                    some = lists[k : k + _LISTS]
                    total = matrix[some[:, 0]]
                    for column in some.T[1:]:
                        total += matrix[column]
                    better = np.flatnonzero((total > score[k : k + _LISTS, -1:]).any(1))
                    # earlier rows have lower ids, and come first among equals
                    both = np.concatenate([score[k + better], total[better]], axis=1)
                    order = np.argsort(-both, axis=1, kind="stable")[:, :most]
                    names = np.concatenate([ids[k + better], np.broadcast_to(own, (len(better), len(own)))], axis=1)
                    score[k + better], ids[k + better] = np.take_along_axis(both, order, 1), np.take_along_axis(names, order, 1)
        x, y = np.nonzero(score)
        n = 0
        while n < len(x):
            some = x[n : n + (1 << 16)], y[n : n + (1 << 16)]
            n += 1 << 16
            yield pa.RecordBatch.from_arrays([pa.array(some[0], pa.int64()), pa.array(ids[some]), pa.array(score[some] >> _WEIGHT), pa.array(score[some] & ((1 << _WEIGHT) - 1))], names=["list", "id", "n", "weight"])

    return run


def best_matches(hits: DataFrame, asked: DataFrame, most: int) -> DataFrame:
    """(columns of asked, id, n, weight, rank): for each row of asked (with ``words``, a
    set that the driver can hold), the ids with most of its words, then with the largest
    sum of weights, then the lowest.  ``hits`` (id, token, weight) has one row for an id
    and a token; the weights of an id sum up to less than 2**40.  Equal lists are answered
    once."""
    spark = asked.sparkSession
    prepare_workers(spark)
    lists = sorted(tuple(r.words) for r in asked.where(F.size("words") > 0).select("words").distinct().collect())
    vocabulary = sorted({w for words in lists for w in words})
    place, longest = {w: k for k, w in enumerate(vocabulary)}, max(map(len, lists), default=1)
    padded = np.array([[*map(place.get, words), *[len(vocabulary)] * (longest - len(words))] for words in lists], np.int64).reshape(-1, longest)
    rows = hits.groupBy("id").agg(F.collect_list(F.struct("token", F.col("weight").cast("long"))).alias("found")).sortWithinPartitions("id")
    found = rows.mapInArrow(_best(vocabulary, padded, most), "list long, id long, n long, weight long")
    rank = F.row_number().over(Window.partitionBy("list").orderBy(F.desc("n"), F.desc("weight"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= most)
    named = spark.createDataFrame([(k, list(words)) for k, words in enumerate(lists)], "list long, words array<string>")
    # few enough to be kept, so that no plan behind this repeats the search
    found = settle(found, narrow=True).join(F.broadcast(named), "list").drop("list")
    return asked.join(found, "words")
