"""Two chunk plans of a document side by side: the plain one, windows that overlap, and
the repaired one, split where its text shifts.  Both are measured alike, and the
repaired one is kept only if it splits for a reason and is better by some measure."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import extract as ex
from tessera.operators.sequential import _REPAIR, repaired
from tessera.operators.structure import _HEADING_SQL, _LEGAL_PARAGRAPHS, _REFS, CHUNK_LEAST, CHUNK_MOST, OVERLAP, TARGET, _legal_paragraphs, _q, overlapping
from tessera.plans.arrow import add_columns
from tessera.sources.tables import table

#: Characters of a heading at most; a document with more typed headings
#: than this has sections to go by; topics of a mixed chunk; and what makes a
#: document one of little structure: chunks, types and sections at most, paragraphs at
#: least, and the share of chunks with a reference below which it lacks them.
HEADING_MOST, TYPED_MOST, MIXED = 30, 1, 3
FEW_CHUNKS, FEW_TYPES, FEW_SECTIONS, SOME_PARAGRAPHS, ALIGNED_SHARE = 3, 2, 2, 4, 0.25
_BIT = {name: 1 << k for k, name in enumerate(ex.SIGNALS)}
_TOPICS = ("findings", "procedural", "authority", "disposition")


def _type(bits: Column, head: Column, density: Column) -> Column:
    """The type of a chunk, by its heading, its signals or its density."""
    has = lambda n: bits.bitwiseAND(F.lit(_BIT[n])) != 0
    found = F.when(head.isNotNull(), head)
    for name, kind, _, _ in ex.BY_SIGNAL:
        found = found.when(has(name) & ~has("authority") if name == "facts" else has(name), kind)
    return found.when(has("authority") | (density >= 2.0), "authority_discussion").when(has("caption"), "caption_title").otherwise("general_body")


def measured(paragraphs: Column, windows: Column) -> Column:
    """struct(n, spread, mixed, weak, aligned) of a plan's windows (first, last) over
    paragraphs (length, refs, bits, head): chunks, types, and chunks with several topics,
    without a heading and with a reference."""

    def chunk(w: Column) -> Column:
        own = F.slice(paragraphs, w["first"] + 1, w["last"] - w["first"] + 1)
        bits = F.aggregate(own, F.lit(0), lambda s, p: s.bitwiseOR(p["bits"]))
        total = lambda name: F.aggregate(own, F.lit(0), lambda s, p: s + p[name])
        length, refs = total("length"), total("refs")
        return F.struct(bits.alias("bits"), length.alias("length"), refs.alias("refs"), F.get(own, F.lit(0))["head"].alias("head"))

    def judged(c: Column) -> Column:
        topics = reduce(lambda a, b: a + b, [(c["bits"].bitwiseAND(F.lit(_BIT[n])) != 0).cast("int") for n in _TOPICS])
        kind = _type(c["bits"], c["head"], c["refs"] * 1000.0 / c["length"])
        return F.struct(kind.alias("type"), (topics >= MIXED).alias("mixed"), c["head"].isNull().alias("weak"), (c["refs"] > 0).alias("aligned"))

    chunks = F.transform(F.transform(windows, chunk), judged)
    count = lambda name: F.size(F.filter(chunks, lambda c: c[name]))
    return F.struct(F.size(chunks).alias("n"), F.size(F.array_distinct(F.transform(chunks, lambda c: c["type"]))).alias("spread"), *[count(n).alias(n) for n in ("mixed", "weak", "aligned")])


#: The tests, of plans a (plain) and b (repaired), as SQL that both engines read.
CANDIDATE = (
    f"typed <= {TYPED_MOST} AND (a.n <= {FEW_CHUNKS} OR a.spread <= {FEW_TYPES} OR a.mixed > 0 OR a.weak > 0 OR sections <= {FEW_SECTIONS} OR paragraphs >= {SOME_PARAGRAPHS}"
    f" OR (a.n > 0 AND a.aligned < {ALIGNED_SHARE} * a.n))"
)
BETTER = (
    ("boundaries", "moved"),
    ("chunks", "b.n > a.n"),
    ("types", "b.spread > a.spread"),
    ("mixed", "b.mixed < a.mixed"),
    ("headings", "b.weak < a.weak"),
    ("references", "a.n > 0 AND b.n > 0 AND b.aligned * a.n > a.aligned * b.n"),
)


def compared(documents: DataFrame) -> DataFrame:
    """documents (key columns; ``all``, an array of paragraphs (n, length, kind, density,
    refs, bits, head) in order) with both plans, their measures ``a`` and ``b``,
    whether the repaired one was tried (``candidate``), the tests in which it is better,
    and ``accepted``.  A document's paragraphs bound its row; one without any has
    two empty plans and no repair."""

    def start() -> Callable:
        def compute(listed: pa.Array) -> list:
            before, after = [], []
            flat, ends = listed.flatten(), listed.offsets.to_pylist()
            held = dict(zip((f.name for f in flat.type), flat.flatten(), strict=True))
            length, kind, density = (held[n].to_pylist() for n in ("length", "kind", "density"))
            for low, high in zip(ends, ends[1:]):
                low, high = low - ends[0], high - ends[0]
                before.append([{"first": f, "last": l} for f, l in overlapping(length[low:high])])
                after.append([{"first": f, "last": e - 1, "reason": r} for f, e, r in repaired(list(zip(length[low:high], kind[low:high], density[low:high])))])
            return [before, after]

        return compute

    ints = [T.StructField(n, T.IntegerType()) for n in ("first", "last")]
    plans = [T.StructField("plain", T.ArrayType(T.StructType(ints))), T.StructField("repaired", T.ArrayType(T.StructType([*ints, T.StructField("reason", T.StringType())])))]
    rows = add_columns(documents, ["all"], plans, start)
    rows = rows.withColumns({
        "a": measured(F.col("all"), F.col("plain")),
        "b": measured(F.col("all"), F.col("repaired")),
        "typed": F.size(F.filter("all", lambda p: p["head"].isNotNull())),
        "sections": 1 + F.size(F.filter("all", lambda p: p["kind"] == "heading")),
        "paragraphs": F.size("all"),
        "moved": F.transform("plain", lambda w: F.concat_ws("-", w["first"], w["last"])) != F.transform("repaired", lambda w: F.concat_ws("-", w["first"], w["last"])),
        "reasoned": F.exists("repaired", lambda w: w["reason"] != "none"),
    })
    better = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in BETTER]))
    rows = rows.withColumn("candidate", F.expr(CANDIDATE)).withColumn("better", F.array_join(better, ","))
    return rows.withColumn("accepted", F.col("candidate") & F.col("reasoned") & (F.col("better") != ""))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    named = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(_REFS), F.lit(1))))
    refs = F.when(F.contains(F.lower(t), F.lit("ordinance")), named).otherwise(0)
    bits = reduce(lambda a, b: a + b, [F.when(ex.signal(F.lower(t), n), bit).otherwise(0) for n, bit in _BIT.items()])
    plain = table(spark, sf_dir, "documents", "doc_id", "text").select((-F.col("doc_id") - 1).alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "t")).where(F.trim("t") != "")
    # both are found once, though used several times
    rows = _legal_paragraphs(spark, sf_dir).unionByName(plain).withColumns({"refs": refs, "bits": bits})
    density, short = F.col("refs") * 1000.0 / F.length(t), F.length(t) < HEADING_MOST
    kind = F.when(short, "heading").otherwise(_type(F.col("bits"), F.lit(None).cast("string"), density))
    rows = rows.select("doc_id", F.struct("n", F.length(t).alias("length"), kind.alias("kind"), density.alias("density"), "refs", "bits", F.when(short, ex.heading_type(t)).alias("head")).alias("p"))
    return rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("all"))


_MEASURES = ("n", "spread", "mixed", "weak", "aligned")


def plan_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both plans of every document, measured, and whether the repair is accepted;
    with closing paragraphs as decisions have them, and without, under -1 - doc_id."""
    found = compared(_listed(spark, sf_dir))
    kept = F.size(F.when(F.col("accepted"), F.transform("repaired", lambda w: w["first"])).otherwise(F.transform("plain", lambda w: w["first"])))
    return found.select("doc_id", *[F.col(f"{p}.{m}").cast("bigint").alias(f"{name}_{m}") for p, name in (("a", "plain"), ("b", "repaired")) for m in _MEASURES], "candidate", "better", "accepted", kept.cast("bigint").alias("n_kept"))


_HAS = lambda n: f"(bits & {_BIT[n]}) <> 0"
_TYPE_SQL = (
    "CASE WHEN head IS NOT NULL THEN head "
    + " ".join(f"WHEN {_HAS(n)}{' AND NOT ' + _HAS('authority') if n == 'facts' else ''} THEN '{k}'" for n, k, _, _ in ex.BY_SIGNAL)
    + f" WHEN {_HAS('authority')} OR refs * 1000.0::DOUBLE / length >= 2.0 THEN 'authority_discussion' WHEN {_HAS('caption')} THEN 'caption_title' ELSE 'general_body' END"
)
_TOPICS_SQL = " + ".join(f"CAST({_HAS(n)} AS INTEGER)" for n in _TOPICS)



def _both(sql: str) -> str:
    return sql.replace("FROM documents)", "FROM documents UNION ALL SELECT -doc_id - 1, text FROM documents)", 1)


QUERIES = {"plan_comparison": plan_comparison}
SQL = {
    "plan_comparison": _both(_LEGAL_PARAGRAPHS.replace("WITH ", "WITH RECURSIVE ", 1))
    + f""", h AS (SELECT doc_id, n, t, length(t) AS length, len(list_distinct(regexp_extract_all(t, {_q(_REFS)}, 1))) AS refs, {' + '.join(f"CASE WHEN regexp_matches(lower(t), {_q(p)}) THEN {_BIT[n]} ELSE 0 END" for n, p in ex.SIGNALS.items())} AS bits, t AS h FROM p),
o AS MATERIALIZED (SELECT *, CASE WHEN length < {HEADING_MOST} THEN {_HEADING_SQL} END AS head, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS m, sum(length) OVER w AS c FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
r AS (SELECT a.doc_id, a.i, a.m, a.c - a.length AS base, min(b.i) AS j FROM o AS a LEFT JOIN o AS b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.c >= a.c - a.length + {TARGET} GROUP BY a.doc_id, a.i, a.m, base),
e AS (SELECT r.doc_id, r.i, r.m, greatest(r.i, CASE WHEN j IS NULL THEN r.m - 1 WHEN o.c - base > {CHUNK_MOST} AND o.c - o.length - base >= {CHUNK_LEAST} THEN j - 1 ELSE j END) AS last FROM r LEFT JOIN o ON o.doc_id = r.doc_id AND o.i = r.j),
w AS (SELECT doc_id, i, last, m FROM e WHERE i = 0 UNION ALL SELECT e.doc_id, e.i, e.last, e.m FROM w JOIN e ON e.doc_id = w.doc_id AND e.i = CASE WHEN w.last > w.i THEN w.last ELSE w.last + {OVERLAP} END),
rep AS MATERIALIZED ({_both(_REPAIR)}),
plans AS (SELECT 'a' AS plan, doc_id, i AS first, last, 'none' AS reason FROM w UNION ALL SELECT 'b', doc_id, first, "end" - 1, reason FROM rep),
x AS (SELECT plan, p.doc_id, first, p.last, min(reason) AS reason, bit_or(bits) AS bits, sum(length) AS length, sum(refs) AS refs, any_value(head) FILTER (o.i = first) AS head FROM plans p JOIN o ON o.doc_id = p.doc_id AND o.i BETWEEN first AND p.last GROUP BY plan, p.doc_id, first, p.last),
y AS (SELECT plan, doc_id, count(*) AS n, count(DISTINCT {_TYPE_SQL}) AS spread, count(*) FILTER ({_TOPICS_SQL} >= {MIXED}) AS mixed, count(*) FILTER (head IS NULL) AS weak, count(*) FILTER (refs > 0) AS aligned,
  bool_or(reason <> 'none') AS reasoned, string_agg(first || '-' || last, ',' ORDER BY first, last) AS bounds FROM x GROUP BY plan, doc_id),
d AS (SELECT doc_id, count(head) AS typed, 1 + count(*) FILTER (length < {HEADING_MOST}) AS sections, count(*) AS paragraphs FROM o GROUP BY doc_id),
z AS (SELECT a.doc_id, {', '.join(f'{p}.{m} AS {name}_{m}' for p, name in (('a', 'plain'), ('b', 'repaired')) for m in _MEASURES)}, {CANDIDATE} AS candidate, b.reasoned,
  concat_ws(',', {', '.join(f"CASE WHEN {test.replace('moved', '(a.bounds <> b.bounds)')} THEN '{name}' END" for name, test in BETTER)}) AS better
  FROM y a JOIN y b ON a.doc_id = b.doc_id AND a.plan = 'a' AND b.plan = 'b' JOIN d ON d.doc_id = a.doc_id)
SELECT * EXCLUDE (reasoned), candidate AND reasoned AND better <> '' AS accepted, CASE WHEN candidate AND reasoned AND better <> '' THEN repaired_n ELSE plain_n END AS n_kept FROM z"""
}
