"""Near-duplicate vectors: iterative quantisation and multi-index Hamming tables.

1. Equal vectors are one class.  A rotation of the principal axes that balances
   binary codes is learned from a bounded sample; every class gets a code.
2. A code's bits are dealt to tables, each of about as many bits as the number of
   classes has, so that a bucket holds as many classes by chance at any size; there
   are as many tables as the recall needs.
3. Dense groups: in a bucket of over HOT classes, those linked to one of its hubs
   form a group with them.  All vectors of a group are compared block by block by
   matrix products, which give counts of links and no pairs.
4. All other pairs: a class lies in each table under its own bits and under all
   that differ in one; two classes whose bits in some table differ in at most two
   places meet.  Each pair is taken up once, in its first such table and under one
   agreed key, if the whole codes are near, and reranked by the cosine of the
   original vectors in double precision.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.components import components
from tessera.plans.arrow import prepare_workers
from tessera.plans.lineage import settle

COSINE = 0.9
#: Share of pairs of just the least cosine that may meet in no table; least bits of
#: a table; and standard deviations above the mean distance of the codes of such a
#: pair up to which pairs are reranked.
MISSED, LEAST_WIDTH, DEVIATIONS = 0.025, 12, 3.5
#: Classes beyond which a bucket's groups are looked for, in so many rounds of one
#: hub a bucket; what they leave is compared as pairs.  Vectors in a block.
HOT, HUBS, BLOCK = 64, 3, 2048
#: Vectors in the sample for the rotation, as expected, and rounds of learning.
SAMPLE, ROUNDS = 2048, 40


@dataclass
class Projection:
    """sign((x / |x| - mean) @ axes), for vectors of one length."""

    mean: np.ndarray
    axes: np.ndarray


@dataclass(frozen=True)
class Tables:
    """``count`` tables of ``width`` bits, as many to a 64-bit word as fit."""

    width: int
    count: int
    radius: int

    @property
    def a_word(self) -> int:
        return 64 // self.width

    @property
    def words(self) -> int:
        return -(-self.count // self.a_word)

    @property
    def codes(self) -> list[str]:
        return [f"code{i}" for i in range(self.words)]

    def part(self, table: int, prefix: str = "") -> str:
        """SQL for a table's bits."""
        return f"(shiftrightunsigned({prefix}code{table // self.a_word}, {self.width * (table % self.a_word)}) & {(1 << self.width) - 1}L)"


def planned(n: int, cosine: float) -> Tables:
    """Tables for n classes.  Signs of two vectors on a random axis differ with the
    probability of their angle by 180 degrees."""
    differ = math.acos(max(-1.0, min(1.0, cosine))) / math.pi
    width = min(31, max(LEAST_WIDTH, math.ceil(math.log2(max(n, 2)))))
    meet = sum(math.comb(width, k) * differ**k * (1 - differ) ** (width - k) for k in range(3))
    count = max(1, math.ceil(math.log(MISSED) / math.log(max(1 - meet, 1e-9))))
    bits = width * count
    return Tables(width, count, math.ceil(bits * differ + DEVIATIONS * math.sqrt(bits * differ * (1 - differ))))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def learn(sample: np.ndarray, bits: int, rounds: int = ROUNDS, seed: int = 3) -> Projection:
    """Iterative quantisation of unit vectors; bits beyond the vectors' length or
    the sample's rank come from random directions."""
    rng = np.random.default_rng(seed)
    size = sample.shape[1]
    mean = sample.mean(0) if len(sample) else np.zeros(size)
    centred = sample - mean
    kept = min(bits, size) if len(sample) > 1 else 0
    axes = np.zeros((size, 0))
    if kept:
        _, vectors = np.linalg.eigh(centred.T @ centred)
        main = vectors[:, ::-1][:, :kept]
        v = centred @ main
        r, _ = np.linalg.qr(rng.standard_normal((kept, kept)))
        for _ in range(rounds):
            codes = np.where(v @ r >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(codes.T @ v)
            r = (left @ right).T
        axes = main @ r
    return Projection(mean, np.hstack([axes, rng.standard_normal((size, bits - kept))]))


@dataclass
class Coder:
    """Codes for vectors of any length; unsampled lengths get random directions."""

    tables: Tables
    known: dict[int, Projection] = field(default_factory=dict)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """A row of words for each vector."""
        size, t = x.shape[1], self.tables
        if size not in self.known:
            self.known[size] = learn(np.zeros((0, size)), t.width * t.count)
        p = self.known[size]
        signs = ((unit(x) - p.mean) @ p.axes >= 0).reshape(len(x), t.count, t.width)
        parts = (signs << np.arange(t.width)).sum(2).astype(np.uint64)
        out = np.zeros((len(x), t.words), np.uint64)
        for k in range(t.count):
            out[:, k // t.a_word] |= parts[:, k] << np.uint64(t.width * (k % t.a_word))
        return out.view(np.int64)


def _matrix(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 1))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _encode(coder) -> callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = coder.value
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            codes = np.zeros((len(lengths), own.tables.words), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                codes[at] = own.codes(_matrix(vectors.take(pa.array(at))))
            words = [pa.array(np.ascontiguousarray(codes[:, k])) for k in range(own.tables.words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int32()), *words], names=["node", "size", *own.tables.codes])

    return run


def _rerank(least: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            lengths = np.diff(a.offsets.to_numpy())
            keep = np.zeros(len(lengths), bool)
            for n in np.unique(lengths):
                at = pa.array(np.flatnonzero(lengths == n))
                keep[at] = (unit(_matrix(a.take(at))) * unit(_matrix(b.take(at)))).sum(1) >= least
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    return run


def _block_counts(least: float):
    """Of the vectors of a pair of blocks of one group: how many rows each vector
    has at that cosine or nearer, without its own class."""

    def run(table: pa.Table) -> pa.Table:
        node, block, copies = (table.column(c).to_numpy() for c in ("node", "block", "copies"))
        x = unit(_matrix(table.column("vector").combine_chunks()))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        one, other = np.flatnonzero(block == i), np.flatnonzero(block == j)
        found = np.zeros(len(node), np.int64)
        for k in range(0, len(one), 256):
            own = one[k : k + 256]
            near = x[own] @ x[other].T >= least
            if i == j:
                near[np.arange(len(own)), np.searchsorted(other, own)] = False
            found[own] += near @ copies[other]
            if i != j:
                found[other] += copies[own] @ near
        return pa.table({"node": node, "others": found})

    return run


def learned(classes: DataFrame, n: int, tables: Tables) -> Coder:
    """A coder from about SAMPLE of n classes, chosen by hash."""
    grain = 1_000_000
    share = int(min(1.0, SAMPLE / max(n, 1)) * grain)
    rows = classes.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(grain)) < share).select("node", "vector").toArrow()
    by_size: dict[int, list] = {}
    for _, v in sorted(zip(rows.column("node").to_pylist(), rows.column("vector").to_pylist(), strict=True)):
        by_size.setdefault(len(v), []).append(v)
    return Coder(tables, {size: learn(unit(np.array(v)), tables.width * tables.count) for size, v in by_size.items()})


def _dense_groups(classes: DataFrame, codes: DataFrame, tables: Tables, cosine: float) -> tuple[DataFrame, DataFrame]:
    """(node, group) of classes in dense groups, and the links that tie them.

    In each round, a crowded bucket's hub takes the members linked to it; the next
    round has the rest.  So groups are tied by links, and two of them never become
    one because they share buckets only."""
    parts = F.array(*[F.expr(tables.part(t)) for t in range(tables.count)])
    rows = codes.select("node", "size", F.posexplode(parts).alias("table", "part")).select("node", F.xxhash64("size", "table", "part").alias("bucket"))
    own = classes.select("node", "vector")
    links = None
    for _ in range(HUBS):
        hubs = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("hub")).where(F.col("n") > HOT).drop("n")
        crowded = settle(rows.join(hubs, "bucket"), narrow=True)
        pairs = crowded.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
        pairs = pairs.join(own.toDF("a", "va"), "a").join(own.toDF("b", "vb"), "b").where(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")
        tied = settle(pairs.mapInArrow(_rerank(cosine), "a long, b long"), narrow=True)
        links = tied if links is None else links.unionAll(tied)
        if tied.isEmpty():
            break
        taken = crowded.where("node = hub").select("node", "bucket")
        taken = taken.unionAll(crowded.join(tied, (F.col("node") == F.col("a")) & (F.col("hub") == F.col("b"))).select("node", "bucket"))
        rows = crowded.drop("hub").join(taken, ["node", "bucket"], "left_anti")
    return settle(components(links).toDF("node", "group"), narrow=True), links


def _counted(classes: DataFrame, groups: DataFrame, cosine: float) -> DataFrame:
    """(node, others) in dense groups: rows linked within the group, by blocks."""
    spread = groups.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    rows = groups.join(spread, "group").join(classes, "node").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    rows = rows.select("group", "node", "copies", "vector", "block", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("with"))
    rows = rows.select("group", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "node", "copies", "vector", "block")
    found = rows.groupBy("group", "i", "j").applyInArrow(_block_counts(cosine), "node long, others long")
    return found.groupBy("node").agg(F.sum("others").alias("others"))


def _met(codes: DataFrame, groups: DataFrame, tables: Tables) -> DataFrame:
    """Pairs (a, b) that meet and whose codes are near, but for two of one group."""
    width = tables.width
    rows = codes.join(groups, "node", "left")
    parts = F.array(*[F.expr(tables.part(k)) for k in range(tables.count)])
    placed = rows.select("node", "size", "group", *tables.codes, F.posexplode(parts).alias("table", "part"))
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(width)])
    placed = placed.withColumn("under", F.explode(flips)).withColumn("under", F.col("part").bitwiseXOR(F.col("under")))
    placed = placed.select("node", "group", *tables.codes, "part", "under", "table", F.xxhash64("size", "table", "under").alias("bucket"))
    names = {c: f"b_{c}" for c in placed.columns}
    other = placed.withColumnsRenamed(names)
    differ = F.col("part").bitwiseXOR(F.col("b_part"))
    # the agreed key of two parts: the larger if they differ in one bit, else a's
    # with the lowest differing bit turned
    agreed = F.when(F.bit_count(differ) == 1, F.greatest("part", "b_part")).otherwise(F.col("part").bitwiseXOR(differ.bitwiseAND(-differ)))
    met_before = F.lit(False)
    for t in range(tables.count - 1):
        met_before |= (F.col("table") > t) & (F.bit_count(F.expr(f"{tables.part(t)} ^ {tables.part(t, 'b_')}")) <= 2)
    distance = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"b_{c}"))) for c in tables.codes), F.lit(0))
    near = (F.col("table") == F.col("b_table")) & (F.col("under") == F.col("b_under")) & (F.col("under") == agreed) & (distance <= tables.radius) & ~met_before
    once = F.col("b_group").isNotNull() | (F.col("node") < F.col("b_node"))
    ends = [F.col("node").alias("a"), F.col("b_node").alias("b")]
    loose = placed.where("group IS NULL").join(other, (F.col("bucket") == F.col("b_bucket")) & once & near).select(*ends)
    # members of two groups: only in buckets where both are
    grouped = placed.where("group IS NOT NULL")
    at = grouped.select("bucket", "group").distinct()
    two = at.join(at.toDF("bucket", "b_group"), "bucket").where(F.col("group") < F.col("b_group")).withColumnRenamed("bucket", "b_bucket")
    across = grouped.join(two.withColumn("bucket", F.col("b_bucket")), ["bucket", "group"]).join(other, ["b_bucket", "b_group"]).where(near).select(*ends)
    return loose.unionAll(across)


def near_vectors(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row for each row of vectors: the key, ``n_links``, the number of other
    rows at that cosine or nearer, and ``component_id``, the least key that links
    reach, its own included.

    A vector that is null, empty, zero, or holds null or a non-finite number
    links with nothing, and vectors of different lengths never link.  Rows that
    repeat, key or not, link as any others.  Further columns are not looked at;
    an empty table gives no rows.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    # single precision travels as it is, and is compared in double precision
    single = vectors.schema[vector].dataType == T.ArrayType(T.FloatType(), vectors.schema[vector].dataType.containsNull)
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("vector"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    valid = (F.size("vector") > 0) & F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    rows = settle(rows.select("key", F.when(valid, F.xxhash64(F.col("vector").cast("array<double>"))).alias("node"), F.when(valid, F.col("vector")).alias("vector")))
    classes = settle(rows.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("copies"), F.first("vector").alias("vector")))
    n = classes.count()
    tables = planned(n, cosine)
    coder = spark.sparkContext.broadcast(learned(classes, n, tables))
    codes = settle(classes.select("node", "vector").mapInArrow(_encode(coder), f"node long, size int, {', '.join(f'{c} long' for c in tables.codes)}"))
    groups, ties = _dense_groups(classes, codes, tables, cosine)
    inner = _counted(classes, groups, cosine)
    pairs = _met(codes, groups, tables)
    one, two = classes.select(F.col("node").alias("a"), F.col("vector").alias("va")), classes.select(F.col("node").alias("b"), F.col("vector").alias("vb"))
    pairs = pairs.join(one, "a").join(two, "b").where(F.size("va") == F.size("vb")).select("a", "b", "va", "vb")
    links = settle(pairs.mapInArrow(_rerank(cosine), "a long, b long"), narrow=True)

    copies = classes.select("node", "copies")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("to")), F.struct(F.col("b").alias("node"), F.col("a").alias("to")))).alias("e")).select("e.*")
    counts = ends.join(copies.toDF("to", "weight"), "to").select("node", F.col("weight").alias("others"))
    counts = counts.unionAll(inner).groupBy("node").agg(F.sum("others").alias("others"))
    groups = components(links.unionAll(ties)).toDF("node", "component")
    classes = copies.join(counts, "node", "left").join(groups, "node", "left")
    classes = classes.select("node", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component"))
    found = settle(rows.select("key", "node").join(classes, "node", "left"))
    least = found.where("component IS NOT NULL").groupBy("component").agg(F.min("key").alias("least"))
    found = found.join(least, "component", "left")
    return found.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("least")).alias("component_id"))
