"""Near-duplicates by improved consistent weighted sampling of TF-IDF shingles.

Shingles are runs of words; a shingle's weight is its count in the text times
its inverse document frequency.  The document frequencies of shingles, over all
rows, lie in a table of fixed size, indexed by hash: rare shingles share a slot
with as many others on average, at any size of the corpus in proportion to it, so
they weigh nearly alike, and those in more than about a five hundredth of the
documents weigh less.

1. Texts with equal words are one class.
2. Consistent weighted samples, in bands: classes that agree on all samples of a
   band share a bucket.
3. In each bucket, every member is compared with its hub, the member that shares
   most buckets; the weighted Jaccard similarity decides.
4. Buckets whose members still belong to several components: the members apart
   from the hub's component against all others, block by block.  A pair is taken
   up in the first band that it shares, if its samples leave the similarity open,
   and only links leave a block.  So no link between components that share a
   bucket is lost, and members of one component are never compared with each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.rolling import mix, shingle_hashes, word_hashes
from tessera.plans.arrow import prepare_workers
from tessera.plans.lineage import release, settle

#: Words in a shingle, and the least similarity of a link.
WORDS, SIMILARITY = 5, 0.8
#: At a similarity of 0.8, a pair shares a band with probability 0.9998.
BANDS, ROWS = 16, 4
#: Slots of the table of document frequencies of shingles.
SLOTS = 1 << 18
#: The samples leave a similarity of SIMILARITY open (five standard deviations).
OPEN = 0.55
#: Members in a block, about, and bytes of their texts.
BLOCK, BLOCK_BYTES = 256, 16 << 20
#: Elements sampled at a time, and texts that a worker remembers in comparing.
_CHUNK, _REMEMBERED = 4096, 64


def _slots(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> np.uint64(46)).astype(np.int64)


@cache
def _quantiles() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of Gamma(2, 1), its logarithm, and a uniform variable, at 2**16 levels."""
    p = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.full(1 << 16, 1.0)
    low, high = np.zeros_like(x), np.full_like(x, 60.0)
    for _ in range(60):
        middle = (low + high) / 2
        below = 1 - (1 + middle) * np.exp(-middle) < p
        low, high = np.where(below, middle, low), np.where(below, high, middle)
    return high.astype(np.float32), np.log(high).astype(np.float32), p.astype(np.float32)


@cache
def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(91).integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def weighted_shingles(text: str | None, idf: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a text and their weights."""
    word = word_hashes(text or "")
    return _weigh(word, idf, k)


def _weigh(word: np.ndarray, idf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    shingle, counts = np.unique(shingle_hashes(word, k), return_counts=True)
    return shingle, counts * idf[_slots(shingle)]


def samples(shingle: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """n consistent weighted samples as 32-bit numbers: two texts agree in each
    with the probability of their weighted Jaccard similarity."""
    gamma, log_gamma, uniform = _quantiles()
    seeds = _seeds(n)
    best = np.full(n, np.inf, np.float32)
    out = np.zeros(n, np.uint64)
    log_weight = np.log(weight).astype(np.float32)
    columns = np.arange(n)
    for i in range(0, len(shingle), _CHUNK):
        own = shingle[i : i + _CHUNK]
        z = own[:, None] * seeds
        z ^= z >> np.uint64(31)
        z *= np.uint64(0x9FB21C651E98DF25)
        r = gamma[z >> np.uint64(48)]
        beta = uniform[(z >> np.uint64(32)) & np.uint64(0xFFFF)]
        t = np.floor(log_weight[i : i + _CHUNK, None] / r + beta)
        a = log_gamma[(z >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (t - beta + 1)
        at = a.argmin(0)
        least = a[at, columns]
        better = least < best
        best[better] = least[better]
        chosen = mix(own[at] + t[at, columns].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        out[better] = chosen[better]
    return (out >> np.uint64(32)).astype(np.uint32)


def shingle_idf(docs: DataFrame, text: str = "text", words: int = WORDS) -> np.ndarray:
    """Inverse document frequencies by slot, over all rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), 0
        for batch in batches:
            for t in batch.column(0):
                n += 1
                df[np.unique(_slots(shingle_hashes(word_hashes(t.as_py() or ""), words)))] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n), pa.int64())], names=["slot", "n"])

    found = docs.select(text).mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    n = int(found.loc[found["slot"] == -1, "n"].sum())
    df = np.zeros(SLOTS)
    found = found[found["slot"] >= 0]
    df[found["slot"].to_numpy()] = found["n"].to_numpy()
    return np.log((1 + n) / (1 + df)) + 1


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two results of weighted_shingles."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    least = np.minimum(a[1][i], b[1][j]).sum()
    most = a[1].sum() + b[1].sum() - least
    return float(least / most) if most > 0 else 0.0


def _sketch(idf: np.ndarray, words: int, n: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = idf.value
        for batch in batches:
            kinds, sketches = [], []
            for t in batch.column(2):
                word = word_hashes(t.as_py() or "")
                if len(word):
                    place = np.arange(1, len(word) + 1, dtype=np.uint64)
                    kinds.append(int(mix(np.array([mix(word + mix(place)).sum() + np.uint64(len(word))], np.uint64)).view(np.int64)[0]))
                    sketches.append(samples(*_weigh(word, own, words), n).view(np.int32))
                else:
                    kinds.append(None)
                    sketches.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(kinds, pa.int64()), pa.array(sketches, pa.list_(pa.int32()))], names=["key", "text_key", "n_bytes", "kind", "sketch"])

    return run


def _compare(idf, words: int, similarity: float) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        own = idf.value
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def shingles(key: int, text: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
            if key not in known:
                if len(known) >= _REMEMBERED:
                    known.clear()
                known[key] = weighted_shingles(text.as_py(), own, words)
            return known[key]

        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = [jaccard(shingles(x, t), shingles(y, u)) >= similarity for x, y, t, u in zip(a.to_pylist(), b.to_pylist(), batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def similarities(one: tuple[np.ndarray, np.ndarray], others: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Weighted Jaccard similarities of one text and several, none empty."""
    shingle = np.concatenate([o[0] for o in others])
    weight = np.concatenate([o[1] for o in others])
    first = np.concatenate([[0], np.cumsum([len(o[0]) for o in others])[:-1]])
    at = np.minimum(np.searchsorted(one[0], shingle), len(one[0]) - 1)
    common = np.add.reduceat(np.where(one[0][at] == shingle, np.minimum(one[1][at], weight), 0.0), first)
    return common / (one[1].sum() + np.add.reduceat(weight, first) - common)


def _block_links(idf, words: int, similarity: float, bands: int, rows: int) -> Callable:
    """Links between members of one block (role 0) that are apart from the
    bucket's main component and those of another (role 1); role 2 is both."""

    def run(table: pa.Table) -> pa.Table:
        own = idf.value
        role, kind, component, main, band = (table.column(c).to_numpy() for c in ("role", "kind", "component", "main", "band"))
        text = table.column("text")
        sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(len(role), bands * rows)
        x, y = np.flatnonzero((role != 1) & (component != main)), np.flatnonzero(role != 0)
        group = {c: c for c in component.tolist()}
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def root(c: int) -> int:
            while group[c] != c:
                c = group[c]
            return c

        def shingles(i: int) -> tuple[np.ndarray, np.ndarray]:
            if i not in known:
                known[i] = weighted_shingles(text[i].as_py(), own, words)
            return known[i]

        found: list[tuple[int, int]] = []
        for i in x.tolist():
            same = sketch[y] == sketch[i]
            near = same.sum(1) >= int(OPEN / SIMILARITY * similarity * bands * rows)
            near &= same.reshape(len(y), bands, rows).all(2).argmax(1) == band[i]
            near &= (component[y] == main[i]) | (kind[i] < kind[y])
            own_root = root(component[i])
            others = [j for j in y[near].tolist() if root(component[j]) != own_root]
            if others:
                linked = similarities(shingles(i), [shingles(j) for j in others]) >= similarity
                for j, yes in zip(others, linked.tolist(), strict=True):
                    if yes:
                        found.append((int(kind[i]), int(kind[j])))
                        group[root(component[j])] = root(component[i])
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row for each row of docs: the key, ``text_key`` (xxhash64 of the text),
    ``class_id``, the least key of its group of near-duplicates, and ``group``, a
    number that only rows of the same group have.

    Groups are the components of all links found.  Texts with equal words are
    linked; a text with fewer words than a shingle is one shingle.  A text that
    is null or has no word is in no group: its class_id is its key, its group null.  Null keys
    are never the least unless all are null.
    """
    spark = docs.sparkSession
    prepare_workers(spark)
    idf = spark.sparkContext.broadcast(shingle_idf(docs, text, words))
    texts = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    key_type = texts.schema["key"].dataType.simpleString()
    sketched = settle(texts.mapInArrow(_sketch(idf, words, bands * rows), f"key {key_type}, text_key long, n_bytes long, kind long, sketch array<int>"))
    kinds = sketched.where("kind IS NOT NULL").groupBy("kind").agg(F.min("text_key").alias("text_key"), F.first("sketch").alias("sketch"), F.max("n_bytes").alias("n_bytes"))
    band = F.array(*[F.xxhash64(F.lit(b), F.slice("sketch", b * rows + 1, rows)) for b in range(bands)])
    kinds = settle(kinds)
    members = kinds.select("kind", F.posexplode(band).alias("band", "bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = settle(members.join(shared, "bucket"))
    central = members.groupBy("kind").agg(F.sum("n").alias("rank"))
    hubs = members.join(central, "kind").groupBy("bucket").agg(F.max(F.struct("rank", "kind")).getField("kind").alias("hub"))
    hubs = settle(hubs)
    first = members.join(hubs, "bucket").where("kind <> hub").select(F.least("kind", "hub").alias("a"), F.greatest("kind", "hub").alias("b")).distinct()
    first = settle(first)

    needed = members.select("kind").distinct().join(kinds.select("kind", "text_key"), "kind")
    own = settle(texts.select("text_key", "text").join(needed, "text_key").groupBy("kind").agg(F.first("text").alias("text")))
    pairs = first.join(own.toDF("a", "one"), "a").join(own.toDF("b", "other"), "b").select("a", "b", "one", "other")
    links = settle(pairs.mapInArrow(_compare(idf, words, similarity), "a long, b long"))

    grouped = members.drop("n").join(components(links).toDF("kind", "component"), "kind", "left").withColumn("component", F.coalesce("component", "kind"))
    grouped = grouped.join(kinds.select("kind", "n_bytes"), "kind")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_bytes") / BLOCK_BYTES))  # by members and by bytes
    mixed = grouped.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), blocks.alias("n")).where("low <> high").select("bucket", "n")
    grouped = settle(grouped.join(mixed.join(hubs, "bucket"), "bucket"))
    main = grouped.where("kind = hub").select("bucket", F.col("component").alias("main"))
    grouped = grouped.drop("hub").join(main, "bucket")
    apart = F.col("component") != F.col("main")
    counts = grouped.where(apart).groupBy("bucket").agg(blocks.alias("n_apart"))
    grouped = settle(grouped.join(counts, "bucket"))
    if not grouped.isEmpty():
        # n blocks of all members, n_apart of those apart
        place = lambda n: F.pmod(F.xxhash64("kind"), n)
        all_blocks, zero = F.sequence(F.lit(0).cast("long"), F.col("n") - 1), F.lit(0).cast("long")
        apart_blocks = F.sequence(F.lit(0).cast("long"), F.col("n_apart") - 1)
        small, large = grouped.where("n = 1"), grouped.where("n > 1")
        names = ["bucket", "band", "kind", "component", "main"]
        dealt = small.select(*names, F.lit(2).alias("role"), zero.alias("i"), zero.alias("j"))
        dealt = dealt.unionAll(large.where(apart).select(*names, F.lit(0), place("n_apart"), F.explode(all_blocks)))
        dealt = dealt.unionAll(large.select(*names, F.lit(1).alias("role"), F.explode(apart_blocks).alias("i"), place("n").alias("j")))
        dealt = dealt.join(kinds.select("kind", "sketch"), "kind").join(own, "kind")
        more = dealt.groupBy("bucket", "i", "j").applyInArrow(_block_links(idf, words, similarity, bands, rows), "a long, b long")
        links = links.unionAll(settle(more))
    release(members, own)
    groups = components(links).toDF("kind", "component")
    rows_ = sketched.select("key", "text_key", "kind").join(groups, "kind", "left").withColumn("component", F.coalesce("component", "kind"))
    least = rows_.where("component IS NOT NULL").groupBy("component").agg(F.min("key").alias("least"))
    found = rows_.join(least, "component", "left")
    return found.select(F.col("key").alias(key), "text_key", F.when(F.col("component").isNull(), F.col("key")).otherwise(F.col("least")).alias("class_id"), F.col("component").alias("group"))
