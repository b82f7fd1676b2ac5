"""The filters that candidates of a query must pass, with a looser way for queries
that are left with nothing.

Every candidate is judged once: each strict filter that drops it is a bit of its mask,
and two flags say whether its topic's fallback and the relaxed filters would take it.
A query's branch then hangs on what its candidates have: strict ones; else those of its
topic; else, if it combines structured filters, the relaxed ones.  Conditions are SQL
over the columns of ``evidence``, so that filters are data.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.lexical import fold_sql
from tessera.operators.retrieval import _SIMILAR, best_similarity, calibrated, query_vectors, section_boost
from tessera.plans.lineage import settle
from tessera.sources.tables import CHUNKS, LINES, blank, decisions, table


class Asked(NamedTuple):
    """A query: its folded text, the terms of its issue and procedure, the judge it
    names, its kind of topic with the patterns of the topic's context (``topic``,
    ``second``, ``third``), the drift of wrong contexts, and what else is known of it."""

    name: str
    text: str
    issue: Sequence[str] = ()
    procedure: Sequence[str] = ()
    judge: str = ""
    kind: str = ""
    topic: str = ""
    second: str = ""
    third: str = ""
    drift: str = ""
    cooling: bool = False
    strong: bool = False
    structural: bool = False
    citation: bool = False
    vectors: bool = True
    filters: int = 0


#: Contexts of the topics that have filters of their own.
MOVE_IN = r"\b(omi|recover possession|owner occupancy|occupy the unit|occupied the unit|(owner|relative) move(-|\s)?in)\b"
NOT_MOVED_IN = r"\b(never occupied|did not occupy|failed to occupy|never resided|did not reside|never moved in|did not move in|not occupy|not reside)\b"
OCCUPANCY = r"principal place of residence|tenant in occupancy|actually resides? in a rental unit|a landlord who seeks a determination|definition of tenant"
VOUCHER = r"\bsection 8\b([^.]|\.[^0-9]|\.?$)|\bhud\b|housing choice voucher|\bvoucher\b|subsidized tenant|subsidized tenancy|housing assistance payment|federally subsidized housing"
DETAINER = r"\bunlawful detainer\b|notice to quit|three day notice|detainer action|eviction lawsuit|summons and complaint|filed an unlawful detainer|eviction action"
BUYOUT = r"buyout|buy out|settlement|rescission|disclosure|payments? to vacate|offers? to vacate|offers? of payment to vacate"
PRESSURE = r"pressure|pressured|pressuring|harass|coerc|threat|intimidation|fraud|cease and desist"

#: Kinds of sections, by their slugs.
KINDS = {
    "disfavored": r"^(minute_order|allowable_rent_increase_s|cap_imp_pass_through|base|monthly|total|cost|introduction|body)$",
    "low_signal": r"^(base|monthly|total|cost|allowable_rent_increase_s|cap_imp_pass_through|introduction|body|minute_order)$",
    "low_value": r"^(minute_order|allowable_rent_increase_s|cap_imp_pass_through|base|monthly|total|cost|introduction|body|landlord_petitioner|tenant_petitioner|total_all_capital_improvements|caption_title|[a-z]?[0-9]+[a-z]?)$"
    r"|(^|_)(caption|caption_title|issue_statement|appearances|questions_presented|parties|appearance)(_|$)",
    "conclusions": r"conclusions?_of_law|^(authority_discussion|analysis_reasoning)$",
    "findings": r"findings?_of_fact|^(findings|factual_findings|credibility_findings)$",
    "facts_or_order": r"findings?_of_fact|order",
}
#: Remains of office markup in a text.
MALFORMED, SEVERE = r"<w:[^>]+>", r"<w:[^>]+>|w:(rPr|tabs|spacing|ind|rFonts|sz|lang|tab)\b|</w:[^>]+>"

_PROXY = "(conclusions AND third AND section_boost >= 0.14)"
_QUALIFIES = "(supported AND (topic OR second OR conclusions) AND CASE WHEN conclusions THEN section_boost >= 0.1 OR lexical >= 0.05 OR similarity >= 0.3 ELSE findings OR section_boost >= 0.12 OR lexical >= 0.1 OR similarity >= 0.45 END)"
_PLAIN = "NOT structural AND NOT citation"
_STRONG = "(issue_hits >= 2 OR procedure_hits >= 2 OR whole OR CASE WHEN kind = 'detainer' THEN topic AND second ELSE topic END)"
_SIGNAL = "(lexical > 0 OR similarity > 0 OR exact > 0 OR metadata > 0 OR judge_boost > 0)"

#: The strict filters in order, each with what it drops.
STRICT = (
    ("judge", "judge_driven AND NOT judge_named"),
    ("disfavored_section", "issue_asked AND disfavored AND issue_hits = 0 AND lexical < 0.2"),
    ("low_value_section", "(issue_asked OR procedure_asked) AND low_value AND issue_hits = 0 AND procedure_hits = 0 AND lexical < 0.24"),
    ("cooling_proxy", "cooling AND issue_hits = 0 AND ((lexical = 0 AND similarity > 0) OR lexical < 0.3) AND NOT facts_or_order"),
    ("cooling_weak", "cooling AND issue_hits = 0 AND lexical < 0.35"),
    ("wrong_context", "strong AND drifted"),
    ("evidence", f"strong AND NOT {_STRONG} AND NOT (kind = 'detainer' AND {_QUALIFIES}) AND lexical < CASE WHEN vectors THEN 0.7 ELSE 0.35 END AND similarity < 0.72"),
    ("follow_through", f"kind = 'move_in' AND NOT {_PROXY} AND (NOT topic OR NOT second) AND lexical < 0.88 AND similarity < 0.82"),
    ("detainer", f"kind = 'detainer' AND (NOT topic OR NOT second) AND NOT {_QUALIFIES} AND lexical < 0.92 AND similarity < 0.84"),
    ("artifact", f"{_PLAIN} AND severe AND lexical < 0.6"),
    ("vector_only", f"{_PLAIN} AND lexical = 0 AND similarity > 0 AND (low_signal OR malformed)"),
    ("no_signal", f"NOT {_SIGNAL}"),
)
_SOME = "(lexical >= {} OR similarity >= {})"
#: What a topic's own candidates are, where no strict one is left; the strict filters
#: named must hold for them too.
KEPT_FILTERS = ("judge", "wrong_context", "artifact", "vector_only")
FALLBACK = (
    f"CASE kind WHEN 'move_in' THEN (topic OR {_PROXY}) AND (second AND {_SOME.format(0.2, 0.55)} OR {_PROXY})"
    f" WHEN 'detainer' THEN (topic AND second AND {_SOME.format(0.25, 0.55)}) OR ({_QUALIFIES} AND {_SOME.format(0.1, 0.45)})"
    f" WHEN 'buyout' THEN topic AND second AND {_SOME.format(0.25, 0.55)} ELSE false END"
)
#: What the relaxed filters take, and what they add to its score.
RELAXED = (
    f"NOT ({_PLAIN} AND severe AND lexical < 0.4 AND section_boost < 0.1) AND NOT ({_PLAIN} AND lexical = 0 AND similarity > 0 AND malformed AND NOT conclusions AND NOT findings)"
    f" AND ({_SIGNAL} OR ((conclusions OR findings) AND (score >= 0.22 OR issue_hits > 0 OR procedure_hits > 0 OR metadata > 0 OR judge_boost > 0 OR section_boost >= 0.14)))"
)
RECOVERED = "CASE WHEN conclusions THEN 0.08 WHEN findings THEN 0.04 ELSE 0 END + CASE WHEN metadata > 0 THEN 0.04 ELSE 0 END + CASE WHEN judge_boost > 0 THEN 0.03 ELSE 0 END + CASE WHEN exact > 0 OR lexical >= 0.2 THEN 0.03 ELSE 0 END"
FALLBACK_BOOST, LEAST_FILTERS = 0.02, 2


def _like(text: Column, pattern: str) -> Column:
    return tx.like(text, pattern) if pattern else F.lit(False)


def _lexical(folded: Column, spaced: Column, words: Sequence[str]) -> tuple[Column, Column]:
    """A query's lexical score, and whether its words stand side by side."""
    hits = reduce(lambda a, b: a + b, [tx.has_spaced(spaced, folded, w).cast("int") for w in words])
    times = reduce(lambda a, b: a + b, [tx.count_spaced(spaced, folded, w) for w in words])
    whole = tx.has_spaced(spaced, folded, " ".join(words))
    score = hits / len(words) * 0.75 + F.least(F.lit(1.0), times / (len(words) * 2)) * 0.25 + F.when(whole & F.lit(len(words) > 1), 0.18).otherwise(0.0)
    return F.round(F.least(F.lit(1.2), score), 6), whole


def shared(folded: Column, raw: Column, label: Column) -> dict[str, Column]:
    """What the conditions name of a chunk, whatever the query."""
    slug = tx.slug(F.trim(label))
    return {**{k: _like(slug, p) for k, p in KINDS.items()}, "malformed": _like(raw, MALFORMED), "severe": _like(raw, SEVERE), "section_boost": section_boost(label)}


def supports(document: Column, asked: Sequence[Asked]) -> Column:
    """The queries whose topic a folded document supports, be it in several chunks."""
    return F.array_compact(F.array(*[F.when(_like(document, a.topic) & _like(document, a.second), F.lit(a.name)) for a in asked if a.kind == "detainer"]).cast("array<string>"))


def evidence(asked: Asked, folded: Column, spaced: Column, label: Column, author: Column, supported: Column) -> Column:
    """What they name of a chunk for a query, but for its similarity: ``folded`` is the
    chunk's text, ``spaced`` the same between spaces, ``supported`` the queries that its
    document supports."""
    lexical, whole = _lexical(folded, spaced, asked.text.split())
    count = lambda terms: reduce(lambda a, b: a + b, [F.contains(folded, F.lit(t)).cast("int") for t in terms], F.lit(0))
    found = {
        "issue_hits": count(asked.issue),
        "procedure_hits": count(asked.procedure),
        "judge_named": F.lower(author) == asked.judge if asked.judge else F.lit(False),
        **{k: _like(folded, getattr(asked, k)) for k in ("topic", "second", "third")},
        "supported": F.array_contains(supported, asked.name) if asked.kind == "detainer" else F.lit(False),
        "drifted": _like(folded, asked.drift),
        "whole": whole,
        "lexical": lexical,
        "named": F.contains(F.lower(label), F.lit(asked.text)),
    }
    return F.struct(F.lit(asked.name).alias("query"), *[v.alias(k) for k, v in found.items()])


def candidates(rows: DataFrame, similar: DataFrame, asked: Sequence[Asked]) -> DataFrame:
    """(chunk_id, document_id, query, what the conditions name) of every chunk for
    every query: a stated set of queries, so each chunk is read once.  ``rows`` has
    chunk_id, document_id, chunk_text, section_label, author and ``supports``; ``similar``
    has document_id and similarity.  Nulls are empty texts and no similarity."""
    spark = rows.sparkSession
    filled = rows.select("chunk_id", "document_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("chunk_text", "section_label", "author")], "supports").withColumn("folded", tx.fold(F.col("chunk_text"))).withColumn("spaced", tx.spaced(F.col("folded")))
    own = shared(F.col("folded"), F.col("chunk_text"), F.col("section_label"))
    columns = [F.col(c) for c in ("folded", "spaced", "section_label", "author", "supports")]
    found = filled.select("chunk_id", "document_id", *[v.alias(k) for k, v in own.items()], F.explode(F.array(*[evidence(a, *columns) for a in asked])).alias("e"))
    found = found.select(*[c for c in found.columns if c != "e"], "e.*").join(similar.select("document_id", "similarity"), "document_id", "left")
    about = [(a.name, bool(a.issue), bool(a.procedure), bool(a.judge) and not a.issue and not a.procedure, len(a.text.split()) > 1, a.kind, a.cooling, a.strong, a.structural, a.citation, a.vectors, a.filters) for a in asked]
    flags = spark.createDataFrame(about, "query string, issue_asked boolean, procedure_asked boolean, judge_driven boolean, several boolean, kind string, cooling boolean, strong boolean, structural boolean, citation boolean, vectors boolean, filters int")
    found = found.join(F.broadcast(flags), "query").withColumns({
        "similarity": F.when(F.col("vectors"), F.coalesce("similarity", F.lit(0.0))).otherwise(0.0),
        "exact": F.when(F.col("whole") & F.col("several"), 0.22).otherwise(0.0),
        "metadata": F.when(F.col("named"), 0.08).otherwise(0.0),
        "judge_boost": F.when(F.col("judge_named"), 0.1).otherwise(0.0),
    })
    boosts = F.col("exact") + F.col("section_boost") + F.col("metadata") + F.col("judge_boost")
    return found.withColumn("score", F.round(F.pow(F.col("lexical") * 0.42 + calibrated(F.col("similarity")) * 0.23 + boosts, F.lit(0.6)), 6))


def judged(found: DataFrame) -> DataFrame:
    """Candidates with ``mask``, a bit for each strict filter that drops them, and
    whether the fallback of their topic (``fallback``) and the relaxed filters
    (``relaxed``) take them, with their scores then."""
    mask = reduce(lambda a, b: a + b, [F.when(F.expr(condition), 1 << k).otherwise(0) for k, (_, condition) in enumerate(STRICT)])
    must = sum(1 << k for k, (name, _) in enumerate(STRICT) if name in KEPT_FILTERS)
    rows = found.withColumn("mask", mask)
    return rows.select(
        "query", "chunk_id", "document_id", "filters", "score", "mask",
        ((F.col("mask").bitwiseAND(F.lit(must)) == 0) & F.expr(FALLBACK)).alias("fallback"),
        F.expr(RELAXED).alias("relaxed"),
        F.round(F.col("score") + F.expr(RECOVERED), 6).alias("recovered_score"),
    )


def survivors(rows: DataFrame) -> DataFrame:
    """(query, chunk_id, document_id, branch, score): what the branch of each query
    keeps of judged().  Queries are few; their branches are joined to rows that any
    branch keeps."""
    kept = settle(rows.where(f"mask = 0 OR fallback OR (relaxed AND filters >= {LEAST_FILTERS})"), narrow=True)
    branch = F.when(F.max((F.col("mask") == 0).cast("int")) == 1, "strict").when(F.max(F.col("fallback").cast("int")) == 1, "fallback").otherwise("relaxed")
    branches = kept.groupBy("query").agg(branch.alias("branch"))
    found = kept.join(F.broadcast(branches), "query")
    found = found.where((F.col("branch") == "strict") & (F.col("mask") == 0) | (F.col("branch") == "fallback") & F.col("fallback") | (F.col("branch") == "relaxed") & F.col("relaxed"))
    score = F.when(F.col("branch") == "strict", F.col("score")).when(F.col("branch") == "fallback", F.round(F.col("score") + FALLBACK_BOOST, 6)).otherwise(F.col("recovered_score"))
    return found.select("query", "chunk_id", "document_id", "branch", score.alias("score"))


def report(rows: DataFrame) -> DataFrame:
    """(query, filter, dropped, also): how many candidates each strict filter is the
    first to drop, how many it drops at all, and how many none does."""
    names = F.array(*[F.struct(F.lit(k).alias("at"), F.lit(name).alias("filter")) for k, (name, _) in enumerate(STRICT)])
    bits = F.filter(names, lambda n: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), n["at"])) != 0)
    each = rows.select("query", F.explode(F.when(F.col("mask") == 0, F.array(F.struct(F.lit(-1).alias("at"), F.lit("kept").alias("filter")))).otherwise(bits)).alias("n"), F.get(bits, F.lit(0))["at"].alias("first"))
    return each.groupBy("query", F.col("n.filter").alias("filter")).agg(F.count_if((F.col("n.at") == F.col("first")) | (F.col("n.at") < 0)).alias("first"), F.count("*").alias("all"))


#: Queries over the given tables, which hold no legal prose: their contexts are words
#: of the tables.
ASKED = (
    Asked("condition", "ertion onthe", issue=("ertion", "onthe"), strong=True, drift=r"\bles\b|\bund\b"),
    Asked("cooling", "that thention", issue=("heat", "cooling"), cooling=True),
    Asked("judge", "src1", judge="src1"),
    Asked("notice", "hearing of notice", procedure=("notice", "thing"), strong=True, vectors=False),
    Asked("moved", "owner the moved", kind="move_in", topic=r"\bthe\b", second=r"\bnot\b|\bis\b", third=r"\bthat\b"),
    Asked("detained", "notice of the voucher", kind="detainer", topic=r"\bis\b", second=r"\bat\b", strong=True),
    Asked("bought", "for nosuchword unseen another", kind="buyout", topic=r"\bfor\b", second=r"\bwith\b", cooling=True, vectors=False),
    Asked("combined", "nosuchword unseen", issue=("th",), vectors=False, filters=2),
    Asked("nothing", "nosuchword unseen", vectors=False),
)
#: Sections that stand for a decision's, by a chunk's place.
LABELS = ("Findings of Fact", "Conclusions of Law", "Order", "Background", "Introduction", "Caption Title", "Base", "3b")


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decisions(spark, sf_dir)
    # beside posexplode() what a document supports would be found again for every line
    docs = docs.select("id", "author", "text", supports(tx.fold(F.coalesce("text", F.lit(""))), ASKED).alias("supports"))
    lines = docs.select("id", "author", "supports", F.posexplode(F.split("text", "\n")).alias("place", "chunk_text")).where(~blank("chunk_text"))
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.col("place") % len(LABELS) + 1)
    rows = lines.select((F.col("id") * LINES + F.col("place")).alias("chunk_id"), F.col("id").alias("document_id"), "chunk_text", label.alias("section_label"), "author", "supports")
    vectors = table(spark, sf_dir, "embeddings")
    return judged(candidates(rows, best_similarity(vectors, query_vectors(vectors)).withColumnRenamed("vec_id", "document_id"), ASKED))


def filter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of all chunks for each query, by which branch, and how it scores."""
    return survivors(_judged(spark, sf_dir))


def cascade_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all chunks each filter drops for each query."""
    return report(_judged(spark, sf_dir))


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _like_sql(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {_quoted(pattern)})" if pattern else "false"


def _asked_sql(a: Asked) -> str:
    words = a.text.split()
    hit = lambda w: f"regexp_matches(folded, '{tx.word_pattern(w)}')"
    times = " + ".join(f"len(regexp_extract_all(folded, '{tx.word_pattern(w)}'))" for w in words)
    hits = " + ".join(f"CAST({hit(w)} AS INTEGER)" for w in words)
    count = lambda terms: " + ".join(["0", *[f"CAST(contains(folded, '{t}') AS INTEGER)" for t in terms]])
    many = str(len(words) > 1).lower()
    judge = f"lower(author) = {_quoted(a.judge)}" if a.judge else "false"
    flags = ", ".join(f"{str(getattr(a, k)).lower()} AS {k}" for k in ("cooling", "strong", "structural", "citation", "vectors", "filters"))
    kinds = ", ".join(f"{_like_sql('slug', p)} AS {k}" for k, p in KINDS.items())
    return f"""SELECT chunk_id, document_id, '{a.name}' AS query, {str(bool(a.issue)).lower()} AS issue_asked, {str(bool(a.procedure)).lower()} AS procedure_asked,
  {str(bool(a.judge) and not a.issue and not a.procedure).lower()} AS judge_driven, {judge} AS judge_named, {count(a.issue)} AS issue_hits, {count(a.procedure)} AS procedure_hits, '{a.kind}' AS kind,
  {_like_sql('folded', a.topic)} AS topic, {_like_sql('folded', a.second)} AS second, {_like_sql('folded', a.third)} AS third,
  {f"list_contains(supports, '{a.name}')" if a.kind == 'detainer' else 'false'} AS supported, {_like_sql('folded', a.drift)} AS drifted, {flags}, {kinds},
  {_like_sql('raw', MALFORMED)} AS malformed, {_like_sql('raw', SEVERE)} AS severe, {hit(a.text)} AS whole,
  round(least(1.2::DOUBLE, ({hits}) / {len(words)}.0::DOUBLE * 0.75::DOUBLE + least(1.0::DOUBLE, ({times}) / {2 * len(words)}.0::DOUBLE) * 0.25::DOUBLE + CASE WHEN {many} AND {hit(a.text)} THEN 0.18::DOUBLE ELSE 0 END), 6) AS lexical,
  CASE WHEN {many} AND {hit(a.text)} THEN 0.22::DOUBLE ELSE 0.0::DOUBLE END AS exact, CASE WHEN section_label = 'Conclusions of Law' THEN 0.24::DOUBLE WHEN section_label = 'Findings of Fact' THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END AS section_boost,
  CASE WHEN contains(lower(section_label), '{a.text}') THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS metadata, CASE WHEN {judge} THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS judge_boost FROM c"""


_MUST = sum(1 << k for k, (name, _) in enumerate(STRICT) if name in KEPT_FILTERS)
_JUDGED = f"""WITH {CHUNKS}, {_SIMILAR},
docs AS (SELECT document_id, list_filter([{', '.join(f"CASE WHEN {_like_sql('t', a.topic)} AND {_like_sql('t', a.second)} THEN '{a.name}' END" for a in ASKED if a.kind == 'detainer')}], lambda n: n IS NOT NULL) AS supports
         FROM (SELECT doc_id AS document_id, {fold_sql("coalesce(text, '')")} AS t FROM documents)),
c0 AS (SELECT chunk_id, document_id, author, chunk_text AS raw, {fold_sql('chunk_text')} AS folded, supports, [{', '.join(map(_quoted, LABELS))}][order_rank % {len(LABELS)} + 1] AS section_label FROM chunks JOIN docs USING (document_id)),
c AS (SELECT *, regexp_replace(regexp_replace(lower(section_label), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS slug FROM c0),
e AS ({' UNION ALL '.join(map(_asked_sql, ASKED))}),
f AS (SELECT e.*, CASE WHEN vectors THEN coalesce(v.similarity, 0.0::DOUBLE) ELSE 0.0::DOUBLE END AS similarity FROM e LEFT JOIN v ON vec_id = document_id),
g AS (SELECT *, round(pow(0.42::DOUBLE * lexical + 0.23::DOUBLE * CASE WHEN similarity <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, (similarity - 0.55::DOUBLE) / 0.35::DOUBLE)) END + exact + section_boost + metadata + judge_boost, 0.6::DOUBLE), 6) AS score FROM f),
m AS (SELECT *, {' + '.join(f"CASE WHEN {condition} THEN {1 << k} ELSE 0 END" for k, (_, condition) in enumerate(STRICT))} AS mask FROM g),
j AS (SELECT *, (mask & {_MUST}) = 0 AND {FALLBACK} AS fallback, {RELAXED} AS relaxed, round(score + CAST({RECOVERED} AS DOUBLE), 6) AS recovered_score FROM m)"""

QUERIES = {"filter_cascade": filter_cascade, "cascade_report": cascade_report}
SQL = {
    "filter_cascade": f"""{_JUDGED},
k AS (SELECT * FROM j WHERE mask = 0 OR fallback OR (relaxed AND filters >= {LEAST_FILTERS})),
b AS (SELECT query, CASE WHEN bool_or(mask = 0) THEN 'strict' WHEN bool_or(fallback) THEN 'fallback' ELSE 'relaxed' END AS branch FROM k GROUP BY query)
SELECT query, chunk_id, document_id, branch, CASE branch WHEN 'strict' THEN score WHEN 'fallback' THEN round(score + {FALLBACK_BOOST}::DOUBLE, 6) ELSE recovered_score END AS score
FROM k JOIN b USING (query) WHERE CASE branch WHEN 'strict' THEN mask = 0 WHEN 'fallback' THEN fallback ELSE relaxed END""",
    "cascade_report": f"""{_JUDGED},
n AS (SELECT query, mask, unnest([{', '.join(f"{{'k': {k}, 'name': '{name}'}}" for k, (name, _) in enumerate(STRICT))}]) AS s FROM j WHERE mask > 0)
SELECT query, s.name AS filter, count(*) FILTER ((mask & ((1 << s.k) - 1)) = 0) AS "first", count(*) AS "all" FROM n WHERE (mask & (1 << s.k)) <> 0 GROUP BY query, s.name
UNION ALL SELECT query, 'kept', count(*), count(*) FROM j WHERE mask = 0 GROUP BY query""",
}
