"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import release, settle


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """The links of each batch, or a star for each of its components if that is less."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (up := parent.setdefault(top, top)) != top:
                top = up
            while parent[x] != top:
                parent[x], x = top, parent[x]
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
        tied = [(x, root(x)) for x in parent]
        tied = [(x, y) for x, y in tied if x != y]
        yield pa.RecordBatch.from_arrays([pa.array([t[i] for t in tied], pa.int64()) for i in (0, 1)], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node in links (a, b), both long: component is
    the least node that can be reached.

    A round ties each node's larger neighbours to its least one, then each
    node to the least of its smaller neighbours; the links become stars in a
    number of rounds that grows with the logarithm of the input.  Aggregates are
    combined before shuffling and the joins may be split for skew, so a node may
    have any number of links.  Links to oneself and repeated links do no harm.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    links = settle(links.mapInArrow(_forest, "u long, v long").distinct(), narrow=True)
    before = None
    while True:
        both = links.unionAll(links.select("v", "u"))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = settle(joined.select("e.u", "e.v").where("u <> v").distinct(), narrow=True)
        release(links)
        links = following
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before or state.n == 0:
            break
        before = state
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select(F.col("component").alias("node"), "component").distinct())
