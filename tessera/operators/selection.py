"""Choice down a ranking, where a row's fate hangs on the rows kept before it: each anchor
once, so many rows of a document, and no neighbour of a row that is kept.

A query's rows are streamed in order; what is remembered of it are the rows that are
kept, a page at most.  As a page is mostly full after few rows, a pool of the first ones
is tried first, and whole rankings only for queries that it doesn't fill."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators.sequential import anchor_number
from tessera.plans.arrow import prepare_workers
from tessera.plans.lineage import settle
from tessera.sources.tables import CHUNKS, chunks, decisions

#: Rows of a ranking that are tried first, for each row of a page.
POOL = 20

#: Rows of a document by the type of a query.
CAPS = {"rules_ordinance": 1, "index_code": 1, "citation_lookup": 1, "keyword": 1, "exact_phrase": 1}


def cap_of(kind: str, limit: int, one_document: bool = False) -> int:
    return max(3, limit) if one_document else CAPS.get(kind, 2)


class _Page:
    def __init__(self, limit: int, cap: int, apart: int):
        self.limit, self.cap, self.apart = limit, cap, apart
        self.anchors: set[str] = set()
        self.kept: dict[int, int] = {}
        self.numbers: dict[int, list[int]] = {}
        self.size = self.seen = 0

    def takes(self, document: int, anchor: str) -> bool:
        self.seen += 1
        if self.size >= self.limit or anchor in self.anchors or self.kept.get(document, 0) >= self.cap:
            return False
        number = anchor_number(anchor)
        if self.apart and number is not None and any(abs(number - k) <= self.apart for k in self.numbers.get(document, ())):
            return False
        self.anchors.add(anchor)
        self.kept[document] = self.kept.get(document, 0) + 1
        if number is not None:
            self.numbers.setdefault(document, []).append(number)
        self.size += 1
        return True


def _down(limit: int, cap: int, apart: int) -> Callable:
    """Kept rows with their places; a row with place 0 ends a query whose page isn't
    full, with the number of rows that were seen."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, page, schema = None, None, None

        def batch_of(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([batch.schema.field(0), batch.schema.field(1), ("id", pa.int64()), ("place", pa.int32()), ("seen", pa.int64())])
            out = []
            for own, document, anchor, row in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if page is None or own != query:
                    if page is not None and page.size < limit:
                        out.append((query, None, None, 0, page.seen))
                    query, page = own, _Page(limit, cap, apart)
                if page.takes(document, anchor):
                    out.append((own, document, row, page.size, page.seen))
            yield from batch_of(out)
        if page is not None and page.size < limit:
            yield from batch_of([(query, None, None, 0, page.seen)])

    return run


def selected(rows: DataFrame, limit: int, cap: int, apart: int = 0, pool: int | None = None) -> DataFrame:
    """(query_id, document_id, id, place) of rows (query_id, document_id, anchor, id,
    score): down each query's ranking, by score and then id, the rows that the page
    takes.  ``apart`` is how near the numbers of two anchors of a document may not be;
    a null anchor is an anchor, and one without a number has no neighbours."""
    prepare_workers(rows.sparkSession)
    kind = f"query_id {rows.schema['query_id'].dataType.simpleString()}, document_id long, id long, place int, seen long"
    rows = rows.select("query_id", F.col("document_id").cast("long").alias("document_id"), F.coalesce("anchor", F.lit("")).alias("anchor"), F.col("id").cast("long").alias("id"), "score")

    def walked(found: DataFrame) -> DataFrame:
        ordered = found.repartition("query_id").sortWithinPartitions("query_id", F.desc("score"), "id")
        return settle(ordered.select("query_id", "document_id", "anchor", "id").mapInArrow(_down(limit, cap, apart), kind), narrow=True)

    most = pool or POOL * limit
    first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    begun = walked(rows.withColumn("rn", first).where(F.col("rn") <= most))
    columns = ["query_id", "document_id", "id", "place"]
    short = begun.where((F.col("place") == 0) & (F.col("seen") >= most)).select(F.col("query_id").alias("of"))
    if short.isEmpty():
        return begun.where("place > 0").select(*columns)
    whole = walked(rows.join(short, F.col("query_id").eqNullSafe(F.col("of")), "left_semi"))
    done = begun.join(short, F.col("query_id").eqNullSafe(F.col("of")), "left_anti")
    return done.unionByName(whole).where("place > 0").select(*columns)


_LIMIT, _CAP, _APART = 12, 2, 1


def neighbour_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in each language as queries, their longest chunks first: a page of
    twelve, two of a document, none beside another.  Two chunks share an anchor."""
    anchor = F.concat(F.col("document_id").cast("string"), F.lit("-p"), F.floor(F.col("order_rank") / 2).cast("string"))
    rows = chunks(decisions(spark, sf_dir)).select(F.concat_ws("-", "jurisdiction", "author").alias("query_id"), "document_id", anchor.alias("anchor"), F.col("chunk_id").alias("id"), F.length("chunk_text").alias("score"))
    return selected(rows, _LIMIT, _CAP, _APART).select("query_id", "document_id", F.col("id").alias("chunk_id"), "place")


QUERIES = {"neighbour_guard": neighbour_guard}
SQL = {
    "neighbour_guard": f"""WITH RECURSIVE {CHUNKS}, c AS (SELECT concat_ws('-', jurisdiction, author) AS q, document_id AS d, chunk_id AS id, CAST(order_rank // 2 AS INTEGER) AS n, length(chunk_text) AS score FROM chunks),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS i, count(*) OVER (PARTITION BY q) AS m FROM c),
w AS (SELECT q, CAST(0 AS BIGINT) AS i, max(m) AS m, CAST(NULL AS BIGINT) AS id, CAST(NULL AS BIGINT) AS doc, CAST([] AS STRUCT(d BIGINT, n INTEGER)[]) AS kept, false AS took FROM o GROUP BY q
  UNION ALL SELECT q, i, m, id, d, CASE WHEN took THEN list_append(kept, {{'d': d, 'n': n}}) ELSE kept END, took FROM (
    SELECT w.q, o.i, w.m, o.id, o.d, o.n, w.kept, len(list_filter(w.kept, lambda x: x.d = o.d)) < {_CAP} AND len(list_filter(w.kept, lambda x: x.d = o.d AND abs(x.n - o.n) <= {_APART})) = 0 AS took
    FROM w JOIN o ON o.q = w.q AND o.i = w.i + 1 WHERE len(w.kept) < {_LIMIT}))
SELECT q AS query_id, doc AS document_id, id AS chunk_id, CAST(len(kept) AS INTEGER) AS place FROM w WHERE took""",
}
