"""Quality of live results: seven measures of a query's first ten rows, weighed to a score
of 100, and the weaknesses that they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.cascade import _lexical
from tessera.operators.lexical import fold_sql
from tessera.operators.retrieval import section_boost
from tessera.sources.tables import CHUNKS, TRUSTED, chunks, decisions, trusted

#: Fixed values (a billionth keeps halves from rounding by chance): rows that are looked at; weights of the measures; a streak that counts
#: as full pressure; and where a measure is weak.
TOP, STREAK = 10, 5
WEIGHTS = {"expected": 30, "rerank": 15, "provenance": 15, "anchored": 10, "documents": 10, "types": 10, "unpressed": 10}
WEAK = (
    ("no_trusted_corpus_results", "n = 0"),
    ("weak_chunk_type_targeting", "expected < 0.35"),
    ("provenance_incomplete_results", "provenance < 1"),
    ("low_citation_anchor_coverage", "anchored < 0.8"),
    ("duplicate_flooding_pressure", "pressure > 0.7"),
    ("low_document_diversity", "documents < 0.2"),
    ("out_of_corpus_hits_present", "outside > 0"),
)


def measured(rows: DataFrame) -> DataFrame:
    """(query_id, the measures, pressure, outside, score, weak) of ranked rows (query_id,
    place, document_id, label, expected, rerank, provenance, anchored, trusted).  The
    first rows of the trusted corpus count; ``outside`` is the share of others among
    all.  A query whose rows are all outside scores what no row does."""
    own = Window.partitionBy("query_id").orderBy("place")
    ranked = rows.where("trusted").withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= TOP)
    streak = ranked.withColumn("run", F.col("nth") - F.row_number().over(Window.partitionBy("query_id", "document_id").orderBy("nth")))
    runs = streak.groupBy("query_id", "document_id", "run").agg(F.count("*").alias("length"))
    spread = runs.groupBy("query_id", "document_id").agg(F.sum("length").alias("n"), F.max("length").alias("streak")).groupBy("query_id").agg(F.max("n").alias("most"), F.max("streak").alias("streak"), F.count("*").alias("n_documents"))
    share = lambda c: F.round(F.avg(F.col(c).cast("int")), 4)
    top = ranked.groupBy("query_id").agg(
        F.count("*").alias("n"), share("expected").alias("expected"), F.round(F.avg("rerank") + 1e-9, 4).alias("mean"), F.max("rerank").alias("best"),
        share("provenance").alias("provenance"), share("anchored").alias("anchored"), F.count_distinct(F.coalesce("label", F.lit(""))).alias("n_types"),
    ).join(spread, "query_id")
    everything = rows.groupBy("query_id").agg(F.round(F.avg((~F.col("trusted")).cast("int")), 4).alias("outside"))
    found = everything.join(top, "query_id", "left").fillna(0)
    ratio = lambda a, b: F.round(F.when(b > 0, a / b).otherwise(0.0), 4)
    n = F.col("n")
    pressure = F.round((ratio(F.col("most"), n) + F.least(F.lit(1.0), F.col("streak") / STREAK)) / 2, 4)
    found = found.withColumns({
        "rerank": F.when(F.col("best") > 0, F.round(F.least(F.lit(1.0), F.col("mean") / F.col("best") + 1e-9), 4)).otherwise(0.0),
        "documents": ratio(F.col("n_documents"), n),
        "types": ratio(F.col("n_types"), n),
        "pressure": pressure,
        "unpressed": 1 - pressure,
    })
    score = sum((F.col(m) * w for m, w in WEIGHTS.items()), F.lit(0.0))
    weak = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in WEAK]))
    return found.select("query_id", "expected", "rerank", "provenance", "anchored", "documents", "types", "pressure", "outside", F.round(score + 1e-9, 2).alias("score"), F.array_join(weak, ",").alias("weak"))


_WORDS = ("the", "und", "les", "ertion")
_EXPECTED = ("Findings of Fact", "Conclusions of Law")


def _rerank(folded: Column, label: Column) -> Column:
    lexical, _ = _lexical(folded, tx.spaced(folded), _WORDS)
    return F.round(F.pow(lexical * 0.42 + section_boost(label), F.lit(0.6)), 6)


def live_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources in each language as queries of four words, with their best forty chunks.
    Every seventh chunk has no anchor."""
    rows = chunks(decisions(spark, sf_dir)).withColumn("rerank", _rerank(tx.fold(F.col("chunk_text")), F.col("section_label")))
    query = F.concat_ws("-", "jurisdiction", "author")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rerank"), "chunk_id"))
    best = rows.select(query.alias("query_id"), "chunk_id", "document_id", "order_rank", "title", "citation", F.col("section_label").alias("label"), "rerank").withColumn("place", place).where("place <= 40")
    best = best.join(trusted(spark, sf_dir).withColumn("known", F.lit(True)), "document_id", "left")
    anchored = F.col("order_rank") % 7 != 0
    found = best.select("query_id", "place", "document_id", "label", F.col("label").isin(*_EXPECTED).alias("expected"), "rerank", ((F.coalesce("title", F.lit("")) != "") & F.col("citation").isNotNull() & anchored).alias("provenance"), anchored.alias("anchored"), F.coalesce("known", F.lit(False)).alias("trusted"))
    return measured(found)


_LEXICAL_SQL = (
    "round(least(1.2::DOUBLE, (" + " + ".join(f"CAST(regexp_matches(f, '{tx.word_pattern(w)}') AS INTEGER)" for w in _WORDS) + f") / {len(_WORDS)}.0::DOUBLE * 0.75::DOUBLE + least(1.0::DOUBLE, ("
    + " + ".join(f"len(regexp_extract_all(f, '{tx.word_pattern(w)}'))" for w in _WORDS) + f") / {2 * len(_WORDS)}.0::DOUBLE) * 0.25::DOUBLE + CASE WHEN regexp_matches(f, '{tx.word_pattern(' '.join(_WORDS))}') THEN 0.18::DOUBLE ELSE 0 END), 6)"
)
QUERIES = {"live_quality": live_quality}
SQL = {
    "live_quality": f"""WITH {CHUNKS}, {TRUSTED}, c AS (SELECT *, concat_ws('-', jurisdiction, author) AS query_id, {fold_sql('chunk_text')} AS f FROM chunks),
s AS (SELECT *, round(pow(0.42::DOUBLE * {_LEXICAL_SQL} + CASE section_label WHEN 'Conclusions of Law' THEN 0.24::DOUBLE WHEN 'Findings of Fact' THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END, 0.6::DOUBLE), 6) AS rerank FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS place, document_id IN (SELECT document_id FROM trusted) AS trusted, order_rank % 7 <> 0 AS anchored FROM s QUALIFY place <= 40),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS nth FROM p WHERE trusted QUALIFY nth <= {TOP}),
u AS (SELECT query_id, document_id, nth - row_number() OVER (PARTITION BY query_id, document_id ORDER BY nth) AS run FROM t),
v AS (SELECT query_id, document_id, sum(length) AS n, max(length) AS streak FROM (SELECT query_id, document_id, run, count(*) AS length FROM u GROUP BY ALL) GROUP BY query_id, document_id),
w AS (SELECT query_id, max(n) AS most, max(streak) AS streak, count(*) AS n_documents FROM v GROUP BY query_id),
a AS (SELECT query_id, count(*) AS n, round(avg(CAST(section_label IN ('Findings of Fact', 'Conclusions of Law') AS INTEGER)), 4) AS expected, round(avg(rerank) + 1e-9, 4) AS mean, max(rerank) AS best,
  round(avg(CAST(coalesce(title, '') <> '' AND citation IS NOT NULL AND anchored AS INTEGER)), 4) AS provenance, round(avg(CAST(anchored AS INTEGER)), 4) AS anchored, count(DISTINCT coalesce(section_label, '')) AS n_types FROM t GROUP BY query_id),
e AS (SELECT query_id, round(avg(CAST(NOT trusted AS INTEGER)), 4) AS outside FROM p GROUP BY query_id),
j AS (SELECT query_id, outside, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(mean, 0) AS mean, coalesce(best, 0) AS best, coalesce(provenance, 0) AS provenance, coalesce(anchored, 0) AS anchored, coalesce(n_types, 0) AS n_types, coalesce(most, 0) AS most, coalesce(streak, 0) AS streak, coalesce(n_documents, 0) AS n_documents
  FROM e LEFT JOIN a USING (query_id) LEFT JOIN w USING (query_id)),
k AS (SELECT *, CASE WHEN best > 0 THEN round(least(1.0::DOUBLE, mean / best + 1e-9), 4) ELSE 0.0::DOUBLE END AS rerank, CASE WHEN n > 0 THEN round(n_documents / CAST(n AS DOUBLE), 4) ELSE 0.0::DOUBLE END AS documents, CASE WHEN n > 0 THEN round(n_types / CAST(n AS DOUBLE), 4) ELSE 0.0::DOUBLE END AS types,
  round((CASE WHEN n > 0 THEN round(most / CAST(n AS DOUBLE), 4) ELSE 0.0::DOUBLE END + least(1.0::DOUBLE, streak / {STREAK}.0::DOUBLE)) / 2, 4) AS pressure FROM j)
SELECT query_id, expected, rerank, provenance, anchored, documents, types, pressure, outside, round({' + '.join(f"{m if m != 'unpressed' else '(1 - pressure)'} * {w}" for m, w in WEIGHTS.items())} + 1e-9, 2) AS score,
  array_to_string(list_filter([{', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, test in WEAK)}], lambda x: x IS NOT NULL), ',') AS weak FROM k"""
}
