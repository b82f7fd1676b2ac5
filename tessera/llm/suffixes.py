"""Exact removal of long repeated substrings by bucket-pointer refinement.

Sorting all suffixes of a corpus would shuffle several times its size.  Two
equal strings of ``length`` bytes hold the same minimal q-gram at the same
place, so it is enough to sort the suffixes that start at such anchors:

1. Initial buckets: the q-grams at all anchors.  A bucket with one suffix can
   hold no repeat.
2. Refinement: suffixes are sorted on (bucket, finer bucket); neighbours in sorted
   order that agree share the finer bucket.  The identifier of a longer string's
   bucket is made of the identifiers of the q-grams at its later offsets.  First
   come the bytes around the anchor that all strings through it lie in: equal
   ones repeat as a whole.  Where only some strings through the anchor may
   repeat, the same sort runs on blocks of offsets - the core that all strings
   of a block share, then their union - and for blocks that stay open on single
   offsets.  Each step reuses the buckets of the one before, and takes only the
   suffixes that it left open, and of each finer bucket beside them one or two
   as witnesses of its string.

An identifier depends on the string alone, so no step needs a global numbering,
and the sort is by ranges of (bucket, finer bucket, text, offset): buckets of any
size spread over tasks evenly, and only the first and last row of each task meet
on the driver.  Strings count as equal if two 64-bit hashes without anything in
common agree, that of the bucket and that of the finer one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rolling import Substrings, minimizers, mix
from tessera.plans.arrow import add_columns, prepare_workers
from tessera.plans.lineage import release, settle

#: Bytes of a string that counts as repeated.
LENGTH = 400
#: Bytes of an initial bucket's q-gram.
GRAM = 128
#: Offsets in a block of the second refinement.
BLOCK = 48

_KEY = "text_key long, n_bytes int"


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)


def _pointed(grams: np.ndarray, gram: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Identifiers of data[low:high], no shorter than a q-gram, from the q-grams at
    low and every gram bytes behind it, the last one at the end."""
    size = high - low
    out = mix(size.astype(np.uint64))
    for begin in range(0, int(size.max(initial=0)), gram):
        at = np.minimum(low + begin, high - gram)
        out = np.where(size > begin, mix(out * np.uint64(0x9FB21C651E98DF25) + grams[at]), out)
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def shared_buckets(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (bucket, finer, text_key, n_bytes, at) that share their bucket with
    another row, with ``repeats``: whether they share the finer one too, and
    ``witness``: whether a neighbour in the bucket has another finer one.  Each
    finer bucket beside others has a witness; rows that don't repeat all are.

    Rows are sorted over all tasks; a row shares what its neighbour has.  The
    outermost rows of the tasks, two for each, are compared on the driver.  The
    second result is the table to release when the first has been read.
    """
    spark = rows.sparkSession

    def neighbours(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: pa.RecordBatch | None = None
        before = None  # the last row of what came before `held`
        first = True

        def flagged(batch: pa.RecordBatch, before, after, last: bool) -> pa.RecordBatch:
            nonlocal first
            bucket, finer = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = len(bucket)
            same, equal = np.zeros(n + 1, bool), np.zeros(n + 1, bool)  # as the row before
            same[1:n] = bucket[1:] == bucket[:-1]
            equal[1:n] = same[1:n] & (finer[1:] == finer[:-1])
            for at, other, own in ((0, before, 0), (n, after, n - 1)):
                if other is not None:
                    same[at] = other[0] == bucket[own]
                    equal[at] = same[at] and other[1] == finer[own]
            edge = np.zeros(n, np.int8)
            if first:
                edge[0] |= 1
            if last:
                edge[-1] |= 2
            first = False
            differ = same & ~equal
            shares, repeats, witness = (x[:-1] | x[1:] for x in (same, equal, differ))
            keep = shares | (edge > 0)
            out = [*batch.columns, pa.array(shares), pa.array(repeats), pa.array(witness), pa.array(edge), pa.array(np.full(n, part, np.int32))]
            return pa.RecordBatch.from_arrays(out, names=["bucket", "finer", "text_key", "n_bytes", "at", "shares", "repeats", "witness", "edge", "part"]).filter(pa.array(keep))

        ends = lambda b, i: (b.column(0)[i].as_py(), b.column(1)[i].as_py())
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield flagged(held, before, ends(batch, 0), False)
                before = ends(held, held.num_rows - 1)
            held = batch
        if held is not None:
            yield flagged(held, before, None, True)

    order = ["bucket", "finer", "text_key", "n_bytes", "at"]
    rows = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    schema = f"bucket long, finer long, {_KEY}, at int, shares boolean, repeats boolean, witness boolean, edge byte, part int"
    found = settle(rows.mapInArrow(neighbours, schema))
    edges = sorted(found.where("edge > 0").collect(), key=lambda r: (r.part, r.edge))
    line = [[r, r.shares, r.repeats, r.witness] for r in edges]
    for a, b in zip(line, line[1:], strict=False):
        if a[0].part != b[0].part and a[0].bucket == b[0].bucket:
            equal = a[0].finer == b[0].finer
            for x in (a, b):
                x[1:] = True, x[2] or equal, x[3] or not equal
    fixed = [(r.text_key, r.n_bytes, r.at, repeats, witness) for r, shares, repeats, witness in line if shares]
    inner = found.where("edge = 0").select("text_key", "n_bytes", "at", "repeats", "witness")
    if fixed:
        inner = inner.unionAll(spark.createDataFrame(fixed, f"{_KEY}, at int, repeats boolean, witness boolean"))
    return inner, found


def _anchors(length: int, gram: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ats, buckets, finer = [], [], []
            for t in batch.column(2):
                data = _bytes(t.as_py())
                sums = Substrings(data)
                grams = sums.windows(gram)
                at = minimizers(grams, length - gram + 1)
                low, high = np.maximum(0, at + gram - length), np.minimum(len(data), at + length)
                ats.append(at)
                buckets.append(_signed(grams[at]))
                finer.append(_signed(Substrings(data, 1).hashes(low, high) ^ mix((at - low).astype(np.uint64))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(ats, pa.int32()), _lists(buckets, pa.int64()), _lists(finer, pa.int64())], names=["text_key", "n_bytes", "at", "bucket", "finer"])

    return run


def _blocks(length: int, gram: int, block: int) -> Callable:
    """From a text and its anchors in shared buckets, 4 * at + 2 * repeats +
    witness each: the starts of strings known to repeat, as runs; and the blocks
    of offsets of the witnesses, with the bytes that they cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(8)]
            for t, flags in zip(batch.column(2), batch.column(3), strict=True):
                data = _bytes(t.as_py())
                n = len(data)
                flags = np.unique(np.asarray(flags.as_py(), np.int64))
                at, repeats = flags >> 2, (flags & 2).astype(bool)
                known = np.zeros(n + 2, np.int32)
                first, last = np.maximum(0, at + gram - length), np.minimum(at, n - length)
                for sign, k in ((1, first[repeats]), (-1, last[repeats] + 1)):
                    np.add.at(known, k, sign)
                settled = np.cumsum(known)[: n - length + 1] > 0
                edge = np.diff(np.concatenate([[0], settled.astype(np.int8), [0]]))
                columns[0].append(np.flatnonzero(edge == 1))
                columns[1].append(np.flatnonzero(edge == -1))
                count = -(-(length - gram + 1) // block)
                open_at = at[(flags & 1).astype(bool)]
                high = (open_at[:, None] - np.arange(count)[None, :] * block).ravel()
                low = np.maximum(high - block + 1, np.repeat(open_at + gram - length, count))
                inside = (high >= 0) & (low + length <= n)
                # anchors a multiple of a block apart name the same block twice
                high, low = np.unique(np.stack([high[inside], low[inside]]), axis=1) if inside.any() else (high[inside], low[inside])
                core = mix(_pointed(Substrings(data).windows(gram), gram, high, low + length) + (high - low).astype(np.uint64))
                sums = Substrings(data, 1)
                union = np.empty(len(high), np.uint64)
                whole = (low >= 0) & (high + length <= n)
                union[whole] = sums.hashes(low[whole], high[whole] + length)
                # cut off by an end of the text: equal to no other
                own = sums.hashes(np.zeros(1, np.int64), np.full(1, n))
                union[~whole] = mix(mix(high[~whole].astype(np.uint64)) + low[~whole].astype(np.uint64) + own)
                columns[2].append(high)
                columns[3].append(low)
                columns[4].append(_signed(core))
                columns[5].append(_signed(union))
                need = np.zeros(n + 1, np.int32)
                np.add.at(need, np.maximum(low, 0), 1)
                np.add.at(need, np.minimum(high + length, n), -1)
                edge = np.diff(np.concatenate([[0], (np.cumsum(need) > 0).astype(np.int8), [0]]))
                starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                columns[6].append(starts)
                columns[7].append([data[i:j].tobytes() for i, j in zip(starts, ends, strict=True)])
            ints = [_lists(c, pa.int32()) for c in columns[:4]] + [_lists(c, pa.int64()) for c in columns[4:6]] + [_lists(columns[6], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *ints, pa.array(columns[7], pa.list_(pa.binary()))], names=["text_key", "n_bytes", "from", "to", "high", "low", "core", "whole", "start", "piece"])

    return run


def _offsets(length: int, gram: int) -> Callable:
    """From the open blocks of a text, as (low, high), and its pieces: the bucket
    and the finer bucket of the string at every start in a block."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            names = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            ats, buckets, finer = [], [], []
            for n, high, low, start, piece in zip(names["n_bytes"], names["high"], names["low"], names["start"], names["piece"], strict=True):
                n, high, low = n.as_py(), np.array(high.as_py()), np.array(low.as_py())
                want = np.zeros(n + 2, np.int32)
                np.add.at(want, np.maximum(low, 0), 1)
                np.add.at(want, np.minimum(high, n - length) + 1, -1)
                at = np.flatnonzero(np.cumsum(want) > 0)
                found, second = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
                for s, p in zip(start.as_py(), piece.as_py(), strict=True):
                    here = slice(*np.searchsorted(at, [s, s + len(p) - length + 1]))
                    own = at[here] - s
                    if len(own):
                        data = np.frombuffer(p, np.uint8)
                        found[here] = _pointed(Substrings(data).windows(gram), gram, own, own + length)
                        second[here] = Substrings(data, 1).hashes(own, own + length)
                ats.append(at)
                buckets.append(_signed(found))
                finer.append(_signed(second))
            yield pa.RecordBatch.from_arrays([names["text_key"], names["n_bytes"], _lists(ats, pa.int32()), _lists(buckets, pa.int64()), _lists(finer, pa.int64())], names=["text_key", "n_bytes", "at", "bucket", "finer"])

    return run


def repeated_runs(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """(text_key, n_bytes, spans): for each text, by xxhash64 and length, the
    starts of its strings of ``length`` bytes that also start elsewhere in docs,
    the same row included: runs of starts, ``from`` to before ``to``."""
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    prepare_workers(docs.sparkSession)
    texts = docs.select(F.xxhash64(text).alias("text_key"), F.octet_length(text).alias("n_bytes"), F.col(text).alias("text")).where(F.col("n_bytes") >= length)
    anchors = settle(texts.mapInArrow(_anchors(length, gram), f"{_KEY}, at array<int>, bucket array<long>, finer array<long>"))
    rows = anchors.select("text_key", "n_bytes", F.inline(F.arrays_zip("at", "bucket", "finer")))
    shared, table = shared_buckets(rows)
    # of a text with copies, one goes on: all of it repeats, but its strings are witnesses
    copies = anchors.groupBy("text_key", "n_bytes").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    flags = shared.groupBy("text_key", "n_bytes").agg(F.collect_set(F.col("at").cast("long") * 4 + F.col("repeats").cast("long") * 2 + F.col("witness").cast("long")).alias("flags"))
    flags, key = settle(flags.join(copies.withColumn("copied", F.lit(True)), ["text_key", "n_bytes"], "left")), ["text_key", "n_bytes"]
    release(anchors, table)
    single = texts.join(flags.where("copied IS NULL"), key).select(*key, "text", "flags")
    several = texts.join(flags.where("copied"), key).groupBy(*key).agg(F.first("text").alias("text"), F.first("flags").alias("flags"))
    opened = single.unionByName(several)
    schema = f"{_KEY}, `from` array<int>, `to` array<int>, high array<int>, low array<int>, core array<long>, whole array<long>, start array<int>, piece array<binary>"
    opened = settle(opened.mapInArrow(_blocks(length, gram, block), schema))
    release(flags)
    # a block's name: its number among the blocks of its text
    blocks = opened.select("text_key", "n_bytes", F.posexplode(F.arrays_zip("core", "whole"))).select("text_key", "n_bytes", F.col("pos").alias("at"), F.col("col.core").alias("bucket"), F.col("col.whole").alias("finer"))
    shared, table = shared_buckets(blocks)
    verdict = shared.groupBy("text_key", "n_bytes").agg(F.collect_set(F.when(F.col("repeats"), F.col("at"))).alias("yes"), F.collect_set(F.when(F.col("witness"), F.col("at"))).alias("open"))
    pick = lambda column, which: F.transform(which, lambda i: F.get(column, i))
    judged = opened.join(verdict, ["text_key", "n_bytes"], "left")
    judged = settle(
        judged.select(
            "text_key",
            "n_bytes",
            "from",
            "to",
            *[F.coalesce(pick(c, "yes"), F.array().cast("array<int>")).alias(f"yes_{c}") for c in ("low", "high")],
            *[F.coalesce(pick(c, "open"), F.array().cast("array<int>")).alias(c) for c in ("low", "high")],
            *[F.when(F.size("open") > 0, F.col(c)).alias(c) for c in ("start", "piece")],
        )
    )
    release(opened, table)
    still = judged.where(F.size("low") > 0).select("text_key", "n_bytes", "high", "low", "start", "piece")
    single = settle(still.mapInArrow(_offsets(length, gram), f"{_KEY}, at array<int>, bucket array<long>, finer array<long>"))
    shared, _ = shared_buckets(single.select("text_key", "n_bytes", F.inline(F.arrays_zip("at", "bucket", "finer"))))
    release(single)
    last = shared.where("repeats").groupBy("text_key", "n_bytes").agg(F.collect_set("at").alias("singles"))
    return judged.select("text_key", "n_bytes", "from", "to", "yes_low", "yes_high").join(last, ["text_key", "n_bytes"], "left")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH, gram: int = GRAM, block: int = BLOCK, drop_text: bool = False, decode: bool = False) -> DataFrame:
    """docs with the bytes of every text that lie in a repeated string of
    ``length`` bytes removed: ``n_bytes``, ``n_removed``, ``n_spans`` long (the
    maximal removed runs) and ``kept`` binary, or with ``decode`` string, without
    the bytes of characters that a cut went through.

    All copies of a string go, the first one too; strings are judged on the
    input.  A null text counts as empty: 0 bytes, nothing removed.  Texts shorter
    than ``length`` are kept whole.  Rows that repeat in full are texts that
    repeat.  Columns of docs with these names are replaced, all others kept,
    whatever their names.  A text of any length is read whole, by one task; an
    empty table gives no rows.
    """
    marks = repeated_runs(docs, text, length, gram, block).select("text_key", "n_bytes", F.struct("from", "to", "yes_low", "yes_high", "singles").alias("marks"))
    fields = [T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")] + [T.StructField("kept", T.StringType() if decode else T.BinaryType())]
    names = [c for c in docs.columns if c == text or c.lower() not in {f.name for f in fields}]
    # docs' own columns travel in a struct without their names
    own = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names) if c != text])
    rows = docs.select(own.alias("own"), F.col(f"`{text}`").alias("text"), F.xxhash64(text).alias("text_key"), F.octet_length(text).alias("n_bytes"))
    joined = rows.join(marks, ["text_key", "n_bytes"], "left").select("own", "text", "marks")

    def start() -> Callable:
        def compute(texts: pa.Array, marks: pa.Array) -> list:
            out: list[list] = [[], [], [], []]
            for t, m in zip(texts, marks, strict=True):
                data = _bytes(t.as_py())
                n, m = len(data), m.as_py()
                gone = np.zeros(n, bool)
                if m is not None:
                    change = np.zeros(n + 2, np.int32)
                    for lows, highs in ((m["from"], m["to"]), (m["yes_low"], [h + 1 for h in m["yes_high"]]), (m["singles"] or [], [s + 1 for s in m["singles"] or []])):
                        np.add.at(change, np.maximum(np.array(lows, np.int64), 0), 1)
                        np.add.at(change, np.minimum(np.array(highs, np.int64) - 1 + length, n), -1)
                    gone = np.cumsum(change)[:n] > 0
                out[0].append(n)
                out[1].append(int(gone.sum()))
                out[2].append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                left = data[~gone].tobytes()
                out[3].append(left.decode("utf-8", "ignore") if decode else left)
            return out

        return compute

    found = add_columns(joined, ["text", "marks"], fields, start, drop=["marks", *(["text"] if drop_text else [])])
    kept = [F.col("text").alias(c) if c == text else F.col(f"own.c{i}").alias(c) for i, c in enumerate(names) if c != text or not drop_text]
    return found.select(*kept, *[f.name for f in fields])
