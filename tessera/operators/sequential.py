"""Operators that choose row after row: each works on a bounded list, a page of
candidates or a document's paragraphs, in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import extract as ex
from tessera.operators.structure import _HEADING_SQL, _KIND_SQL, _LEGAL_PARAGRAPHS, _REFS, _legal_paragraphs, _q
from tessera.plans.arrow import add_columns
from tessera.sources.tables import CHUNKS, chunks, decisions

#: What novelty adds and redundancy takes, in the order document,
#: section, anchor, neighbour and kind; the number of a paragraph in an anchor; the
#: kinds that an intent asks for; and for citations, rows of a document and how near
#: two anchors of one may be.
NEW_DOCUMENT, NEW_KIND = 0.45, 0.2
SAME_DOCUMENT, SAME_SECTION, SAME_ANCHOR, NEIGHBOUR, SAME_KIND = 0.65, 0.85, 0.75, 0.5, 0.35
ANCHOR_NUMBER = r"(?i)(?:^|[#:_-])p(\d+)\b"
INTENT_KINDS = {"authority": "authority_discussion", "findings": "findings", "disposition": "holding_disposition", "procedural": "procedural_history", "analysis": "analysis_reasoning"}
CITATION_CAP, CITATION_WINDOW = 1, 1


class Candidate(NamedTuple):
    document: object
    section: str
    anchor: str
    place: int
    kind: str
    score: float


class _Chosen:
    """What was chosen, counted by all that a candidate may repeat."""

    def __init__(self, intent: str):
        self.wanted, self.cite = INTENT_KINDS.get(intent), intent == "citation"
        self.documents, self.sections, self.anchors, self.kinds = Counter(), Counter(), Counter(), Counter()
        self.places: dict = defaultdict(set)
        self.numbers: dict = defaultdict(list)

    def score(self, c: Candidate) -> float:
        n, alike = self.documents[c.document], self.kinds[c.kind]
        value = c.score + (0 if n else NEW_DOCUMENT) + (0 if alike else NEW_KIND)
        value -= SAME_DOCUMENT * n + SAME_SECTION * self.sections[c.document, c.section] + SAME_ANCHOR * self.anchors[c.document, c.anchor]
        value -= NEIGHBOUR * bool(self.places[c.document] & {c.place - 1, c.place, c.place + 1})
        return round(value - (SAME_KIND * (alike - 1) if alike >= 2 and c.kind != self.wanted else 0), 4)

    def allows(self, c: Candidate) -> bool:
        if not self.cite:
            return True
        number = anchor_number(c.anchor)
        near = number is not None and any(abs(number - k) <= CITATION_WINDOW for k in self.numbers[c.document])
        return self.documents[c.document] < CITATION_CAP and not near

    def add(self, c: Candidate) -> None:
        self.documents[c.document] += 1
        self.sections[c.document, c.section] += 1
        self.anchors[c.document, c.anchor] += 1
        self.kinds[c.kind] += 1
        self.places[c.document].add(c.place)
        if (number := anchor_number(c.anchor)) is not None:
            self.numbers[c.document].append(number)


def anchor_number(anchor: str) -> int | None:
    found = re.search(ANCHOR_NUMBER, anchor or "")
    return int(found[1]) if found else None


def diversified(candidates: Sequence[Candidate], limit: int, intent: str = "") -> list[tuple[int, float]]:
    """(index, score) of candidates, best first: every choice counts against what is
    like it, but for the kind that the intent asks for.  Ties go to the lower
    document and place.  A citation takes few rows of a document, none next to
    another, and ends where no candidate is left that it may take."""
    chosen = _Chosen(intent)
    left, out = list(range(len(candidates))), []
    while len(out) < limit:
        allowed = [i for i in left if chosen.allows(candidates[i])]
        if not allowed:
            break
        best = min(allowed, key=lambda i: (-chosen.score(candidates[i]), candidates[i].document, candidates[i].place))
        out.append((best, chosen.score(candidates[best])))
        chosen.add(candidates[best])
        left.remove(best)
    return out


#: Fixed values of the repair: characters that open a split by its reason, as parts
#: of the least with a floor; paragraphs at the end that may be a disposition; how
#: much denser, and by how much, a shift is.
SPLIT_LEAST = {"heading": (0.55, 120), "disposition_tail": (0.4, 90), "density_shift": (0.55, 120), "kind_shift": (0.55, 120)}
TAIL_PARAGRAPHS, DENSITY_FLOOR, DENSITY_RATIO, DENSITY_STEP = 2, 1e-4, 1.8, 0.25


def _reasons(before: tuple[int, str, float], own: tuple[int, str, float], remaining: int) -> Iterable[str]:
    """Why a window may begin with a paragraph, in the order of precedence."""
    (_, kind_before, d0), (_, kind, d1) = before, own
    low, high = sorted((max(d0, DENSITY_FLOOR), max(d1, DENSITY_FLOOR)))
    holds = {
        "heading": kind == "heading",
        "disposition_tail": kind == "holding_disposition" and remaining <= TAIL_PARAGRAPHS,
        "density_shift": high >= DENSITY_RATIO * low and abs(d0 - d1) >= DENSITY_STEP,
        "kind_shift": kind != kind_before and "general_body" not in (kind, kind_before),
    }
    return (reason for reason, held in holds.items() if held)


def repaired(paragraphs: Sequence[tuple[int, str, float]], least: int = 250, most: int = 980) -> list[tuple[int, int, str]]:
    """(first, end, reason) of windows over paragraphs (length, kind, density) of a
    document with little structure: split at short headings, a closing
    disposition, shifts of density or kind, and where a window grows too long."""
    opens = {reason: max(floor, int(least * part)) for reason, (part, floor) in SPLIT_LEAST.items()}
    total = np.concatenate([[0], np.cumsum([n for n, _, _ in paragraphs], dtype=np.int64)])
    out, start, reason = [], 0, "none"
    for i in range(1, len(paragraphs)):
        length = int(total[i] - total[start])
        why = next((r for r in _reasons(paragraphs[i - 1], paragraphs[i], len(paragraphs) - i) if length >= opens[r]), None)
        if why or total[i + 1] - total[start] > most and length >= least:
            out.append((start, i, reason))
            start, reason = i, why or "none"
    return [*out, (start, len(paragraphs), reason)] if paragraphs else []


#: Jurisdictions ask in turn for these.
INTENTS = ("findings", "citation", "", "disposition")
_PAGE, _TAKEN = 60, 20
_MMR = f"""WITH RECURSIVE {CHUNKS}, q AS (SELECT j, ['findings', 'citation', '', 'disposition'][(row_number() OVER (ORDER BY j) - 1) % 4 + 1] AS intent FROM (SELECT DISTINCT jurisdiction AS j FROM chunks)),
h AS (SELECT jurisdiction AS j, document_id AS d, order_rank AS p, section_label AS s, chunk_text AS t, section_label AS h, round(length(chunk_text) / 1000.0, 4)::DOUBLE AS base, len(list_distinct(regexp_extract_all(chunk_text, {_q(_REFS)}, 1))) * 1000.0::DOUBLE / length(chunk_text) AS density FROM chunks
  QUALIFY row_number() OVER (PARTITION BY jurisdiction ORDER BY round(length(chunk_text) / 1000.0, 4) DESC, document_id, order_rank) <= {_PAGE}),
k AS (SELECT *, {_HEADING_SQL} AS ht FROM h),
c AS (SELECT j, intent, d, s, 'b-p' || (p // 2) AS a, p // 2 AS n, p, ({_KIND_SQL})[1] AS k, base FROM k JOIN q USING (j)),
r AS (SELECT j, intent, 0 AS place, CAST(NULL AS BIGINT) AS d, CAST(NULL AS INTEGER) AS p, CAST(NULL AS DOUBLE) AS score, CAST([] AS STRUCT(d BIGINT, s VARCHAR, a VARCHAR, n BIGINT, p INTEGER, k VARCHAR)[]) AS got FROM q
  UNION ALL SELECT j, intent, next, d, p, value, got FROM (
    SELECT r.j, r.intent, r.place + 1 AS next, c.d, c.p, list_append(r.got, {{'d': c.d, 's': c.s, 'a': c.a, 'n': CAST(c.n AS BIGINT), 'p': c.p, 'k': c.k}}) AS got,
      round(c.base + CASE WHEN len(list_filter(r.got, lambda x: x.d = c.d)) = 0 THEN {NEW_DOCUMENT}::DOUBLE ELSE 0 END + CASE WHEN len(list_filter(r.got, lambda x: x.k = c.k)) = 0 THEN {NEW_KIND}::DOUBLE ELSE 0 END
        - ({SAME_DOCUMENT}::DOUBLE * len(list_filter(r.got, lambda x: x.d = c.d)) + {SAME_SECTION}::DOUBLE * len(list_filter(r.got, lambda x: x.d = c.d AND x.s = c.s)) + {SAME_ANCHOR}::DOUBLE * len(list_filter(r.got, lambda x: x.d = c.d AND x.a = c.a)))
        - CASE WHEN len(list_filter(r.got, lambda x: x.d = c.d AND abs(x.p - c.p) <= 1)) > 0 THEN {NEIGHBOUR}::DOUBLE ELSE 0 END
        - CASE WHEN len(list_filter(r.got, lambda x: x.k = c.k)) >= 2 AND c.k IS DISTINCT FROM CASE r.intent WHEN 'findings' THEN 'findings' WHEN 'disposition' THEN 'holding_disposition' END THEN {SAME_KIND}::DOUBLE * (len(list_filter(r.got, lambda x: x.k = c.k)) - 1) ELSE 0 END, 4) AS value
    FROM r JOIN c USING (j) WHERE r.place < {_TAKEN} AND len(list_filter(r.got, lambda x: x.d = c.d AND x.p = c.p)) = 0
      AND (r.intent <> 'citation' OR len(list_filter(r.got, lambda x: x.d = c.d)) < {CITATION_CAP} AND len(list_filter(r.got, lambda x: x.d = c.d AND abs(x.n - c.n) <= {CITATION_WINDOW})) = 0)
    QUALIFY row_number() OVER (PARTITION BY r.j ORDER BY value DESC, c.d, c.p) = 1))
SELECT j AS jurisdiction, CAST(place AS INTEGER) AS place, d AS document_id, p AS order_rank, score FROM r WHERE place > 0"""


def mmr_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each jurisdiction as a query with an intent, its sixty longest chunks,
    twenty of them chosen for diversity.  Both numbers are the page and the limit
    of the operator."""
    t = F.col("chunk_text")
    density = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(_REFS), F.lit(1)))) * 1000.0 / F.length(t)
    anchor = F.concat(F.lit("b-p"), F.floor(F.col("order_rank") / 2).cast("string"))
    rows = chunks(decisions(spark, sf_dir)).select("jurisdiction", "document_id", "section_label", anchor.alias("anchor"), "order_rank", t, density.alias("density"), F.round(F.length(t) / 1000.0, 4).alias("base"))
    w = Window.partitionBy("jurisdiction").orderBy(F.desc("base"), "document_id", "order_rank")
    page = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= _PAGE).withColumn("kind", ex.chunk_class(F.col("section_label"), t, F.col("density"))["type"])
    item = F.struct("document_id", "section_label", "anchor", "order_rank", "kind", "base")
    pages = page.groupBy("jurisdiction").agg(F.array_sort(F.collect_list(item)).alias("page"))
    # a row for each query
    pages = pages.withColumn("n", F.row_number().over(Window.orderBy("jurisdiction")) - 1).withColumn("intent", F.element_at(F.array(*map(F.lit, INTENTS)), F.col("n") % len(INTENTS) + 1)).drop("n")

    def start() -> Callable:
        def compute(pages: pa.Array, intents: pa.Array) -> list:
            out = []
            for found, intent in zip(pages.to_pylist(), intents.to_pylist(), strict=True):
                listed = [Candidate(*c.values()) for c in found]
                out.append([{"place": k + 1, "document_id": listed[i].document, "order_rank": listed[i].place, "score": s} for k, (i, s) in enumerate(diversified(listed, _TAKEN, intent))])
            return [out]

        return compute

    chosen = T.ArrayType(T.StructType([T.StructField("place", T.IntegerType()), T.StructField("document_id", T.LongType()), T.StructField("order_rank", T.IntegerType()), T.StructField("score", T.DoubleType())]))
    return add_columns(pages, ["page", "intent"], [T.StructField("chosen", chosen)], start, drop=["page", "intent"]).select("jurisdiction", F.inline("chosen"))


_REPAIR = _LEGAL_PARAGRAPHS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", d AS (SELECT doc_id, n, t, '' AS h, length(t) AS len, len(list_distinct(regexp_extract_all(t, {_q(_REFS)}, 1))) * 1000.0::DOUBLE / length(t) AS density FROM p),
k AS (SELECT *, {_HEADING_SQL} AS ht FROM d),
o AS (SELECT doc_id, len, density, CASE WHEN len < 30 THEN 'heading' ELSE ({_KIND_SQL})[1] END AS kind, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS m FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
b AS (SELECT *, lag(kind) OVER w AS k0, greatest(density, 1e-4) AS x, greatest(lag(density) OVER w, 1e-4) AS y, abs(density - lag(density) OVER w) AS step FROM o WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT doc_id, i, len, 0 AS start, 'none' AS reason FROM b WHERE i = 0
  UNION ALL SELECT doc_id, i, CASE WHEN opens THEN own ELSE len + own END, CASE WHEN opens THEN i ELSE start END, CASE WHEN opens THEN coalesce(why, 'none') ELSE reason END FROM (
    SELECT *, why IS NOT NULL OR len + own > 980 AND len >= 250 AS opens FROM (
      SELECT b.doc_id, b.i, g.len, b.len AS own, g.start, g.reason, CASE WHEN kind = 'heading' AND g.len >= 137 THEN 'heading' WHEN kind = 'holding_disposition' AND m - b.i <= 2 AND g.len >= 100 THEN 'disposition_tail'
        WHEN greatest(x, y) >= 1.8 * least(x, y) AND step >= 0.25 AND g.len >= 137 THEN 'density_shift' WHEN kind <> k0 AND kind <> 'general_body' AND k0 <> 'general_body' AND g.len >= 137 THEN 'kind_shift' END AS why
      FROM g JOIN b ON b.doc_id = g.doc_id AND b.i = g.i + 1)))
SELECT doc_id, CAST(start AS INTEGER) AS first, CAST(max(i) + 1 AS INTEGER) AS "end", min(reason) AS reason FROM g GROUP BY doc_id, start"""


def repair_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over the paragraphs of every document, with the reasons of their
    beginnings."""
    t = F.col("t")
    density = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(_REFS), F.lit(1)))) * 1000.0 / F.length(t)
    kind = F.when(F.length(t) < 30, "heading").otherwise(ex.chunk_class(F.lit(""), t, density)["type"])
    rows = _legal_paragraphs(spark, sf_dir).select("doc_id", F.struct("n", F.length(t).alias("length"), kind.alias("kind"), density.alias("density")).alias("p"))
    listed = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("p")).alias("all"))

    def start() -> Callable:
        def compute(documents: pa.Array) -> list:
            found = [repaired([(p["length"], p["kind"], p["density"]) for p in d]) for d in documents.to_pylist()]
            return [[[{"first": a, "end": b, "reason": r} for a, b, r in f] for f in found]]

        return compute

    windows = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("reason", T.StringType())]))
    return add_columns(listed, ["all"], [T.StructField("windows", windows)], start, drop=["all"]).select("doc_id", F.inline("windows"))


QUERIES = {f.__name__: f for f in (mmr_rerank, repair_split)}
SQL = {"mmr_rerank": _MMR, "repair_split": _REPAIR}
