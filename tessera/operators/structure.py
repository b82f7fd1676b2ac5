"""Structure of documents: metadata, sections, packing, classes, signals."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import extract as ex
from tessera.functions import text as tx
from tessera.plans.arrow import add_columns
from tessera.sources.tables import PARAGRAPHS, decisions, paragraphs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def legal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, each with a closing paragraph of the kind that decisions have."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return docs.select("doc_id", F.expr(_LEGAL.format(cr="'\\n'")).alias("text"))


_LEGAL = (
    "concat(text, {cr}, 'Case No. T', doc_id, '. Rules and Regulations Section 6.', doc_id % 20, '(a). Rent Ordinance 37.', doc_id % 12, '(b)(', doc_id % 4, '). See section 37.', doc_id % 9, ' of the ordinance.', {cr}, "
    "'Index Codes: G', doc_id % 90 + 10, ', 13, 2021, B-', doc_id % 7, {cr}, 'Dated March ', doc_id % 28 + 1, ', 2021. Judge: Mara Ellwood', {cr}, "
    "CASE doc_id % 4 WHEN 0 THEN 'The petition is approved and the claim allowed.' WHEN 1 THEN 'The petition is denied and dismissed.' WHEN 2 THEN 'It is partially granted, limited grant.' ELSE 'No outcome.' END)"
)
LEGAL = "legal AS (SELECT doc_id, " + _LEGAL.format(cr="chr(10)") + " AS text FROM documents)"

_q = lambda p: "'" + p.replace("'", "''") + "'"
_CLEAN = "upper(regexp_replace(regexp_replace(regexp_replace(c, '\\s+', '', 'g'), '^[^A-Z0-9]+', ''), '[^A-Z0-9-]+$', ''))"
_DISTINCT = "list_filter({l}, lambda t, i: list_position({l}, t) = i)"
_METADATA = f"""
WITH {LEGAL},
c AS (SELECT doc_id, text, list_filter(list_transform(regexp_extract_all(array_to_string(regexp_extract_all(text, {_q(ex.INDEX_LINE)}, 1), chr(10)), {_q(ex.INDEX_CODE)}), lambda c: {_CLEAN}),
        lambda c: c <> '' AND NOT regexp_matches(replace(c, '-', ''), {_q(ex.NOISE)}) AND NOT regexp_matches(c, {_q(ex.NOISE)})) AS codes,
      list_transform(regexp_extract_all(text, {_q(ex.RULE)}, 1) || {ex.sections_near_sql(ex.SECTION, ex.RULE_CONTEXT)}, lambda c: 'Rule ' || regexp_replace(c, '\\s+', '', 'g')) AS rules,
      list_transform(regexp_extract_all(text, {_q(ex.ORDINANCE)}, 1) || {ex.sections_near_sql(ex.SECTION_37, ex.ORDINANCE_CONTEXT)}, lambda c: 'Ordinance ' || regexp_replace(c, '\\s+', '', 'g')) AS ordinances,
      regexp_extract(text, {_q(ex.CASE_NUMBER)}, 1) AS case_number, trim(regexp_replace(regexp_extract(text, {_q(ex.AUTHOR)}, 1), '[ \\t]+', ' ', 'g')) AS author,
      concat_ws('-', regexp_extract(text, {_q(ex.ISO_DATE)}, 1), regexp_extract(text, {_q(ex.ISO_DATE)}, 2), regexp_extract(text, {_q(ex.ISO_DATE)}, 3)) AS iso, lower(regexp_extract(text, {_q(ex.LONG_DATE)}, 1)) AS month,
      regexp_extract(text, {_q(ex.LONG_DATE)}, 2) AS day, regexp_extract(text, {_q(ex.LONG_DATE)}, 3) AS year,
      len(regexp_extract_all(lower(text), {_q(ex.GRANT)})) AS g, len(regexp_extract_all(lower(text), {_q(ex.DENY)})) AS d, len(regexp_extract_all(lower(text), {_q(ex.PARTIAL)})) AS p FROM legal),
m AS (SELECT *, {_DISTINCT.format(l='codes')}[1:20] AS ic, {_DISTINCT.format(l='rules')}[1:30] AS rs, {_DISTINCT.format(l='ordinances')}[1:30] AS os,
      CASE WHEN iso <> '--' THEN iso WHEN month <> '' THEN year || '-' || lpad(CAST(list_position([{', '.join(_q(m.lower()) for m in ex.MONTHS)}], month) AS VARCHAR), 2, '0') || '-' || lpad(day, 2, '0') ELSE '' END AS decision_date FROM c)
"""


@query(_METADATA + """SELECT doc_id, array_to_string(ic, ',') AS index_codes, array_to_string(rs, ',') AS rule_sections, array_to_string(os, ',') AS ordinance_sections, case_number, author, decision_date,
CASE WHEN p >= greatest(g, d) AND p > 0 THEN 'partial' WHEN g > d THEN 'grant' WHEN d > g THEN 'deny' ELSE 'unclear' END AS outcome,
round(least(0.98::DOUBLE, 0.3::DOUBLE + CASE WHEN len(ic) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(rs) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN len(os) > 0 THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN case_number <> '' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN decision_date <> '' THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN author <> '' THEN 0.05::DOUBLE ELSE 0 END), 2) AS confidence FROM m""")
def metadata_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes, sections, case, author, date, outcome and confidence of a decision."""
    t = F.col("text")
    rows = legal(spark, sf_dir).select(
        "doc_id", ex.index_codes(t).alias("ic"), ex.rule_sections(t).alias("rs"), ex.ordinance_sections(t).alias("os"), ex.case_number(t).alias("case_number"), ex.author(t).alias("author"), ex.decision_date(t).alias("decision_date"), ex.outcome(t).alias("outcome")
    )
    sure = ex.confidence(F.col("ic"), F.col("rs"), F.col("os"), F.col("case_number"), F.col("decision_date"), F.col("author"))
    return rows.select("doc_id", F.array_join("ic", ",").alias("index_codes"), F.array_join("rs", ",").alias("rule_sections"), F.array_join("os", ",").alias("ordinance_sections"), "case_number", "author", "decision_date", "outcome", sure.alias("confidence"))


#: Citations that always need a reviewer; a parameter of a deployment.
CRITICAL = ("37.3(b)(3)", "37.7(b)(3)", "6.11(a)")


@query(_METADATA + f"""SELECT doc_id, len(ic) > 0 AS has_index_codes, len(rs) > 0 AS has_rules, len(os) > 0 AS has_ordinance,
CAST(len(list_filter([{', '.join(_q(c) for c in CRITICAL)}], lambda c: list_contains(list_transform(rs || os, lambda v: regexp_replace(regexp_replace(lower(v), '^(?:rule|ordinance)\\s*', ''), '[^a-z0-9.()\\-]', '', 'g')), c))) AS BIGINT) AS critical FROM m""")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether required metadata is there, and how many critical citations."""
    t = F.col("text")
    rows = legal(spark, sf_dir).select("doc_id", ex.index_codes(t).alias("ic"), ex.rule_sections(t).alias("rs"), ex.ordinance_sections(t).alias("os"))
    plain = F.transform(F.concat("rs", "os"), lambda v: F.regexp_replace(F.regexp_replace(F.lower(v), r"^(?:rule|ordinance)\s*", ""), r"[^a-z0-9.()\-]", ""))
    hits = F.array_intersect(F.array(*map(F.lit, CRITICAL)), plain)
    return rows.select("doc_id", (F.size("ic") > 0).alias("has_index_codes"), (F.size("rs") > 0).alias("has_rules"), (F.size("os") > 0).alias("has_ordinance"), F.size(hits).cast("bigint").alias("critical"))


#: Canonical names and what stands for them in texts; a parameter of a deployment.
JUDGES = {"Mara Ellwood": ("ellwood",), "Jon Tarrin": ("tarrin", "tarran"), "Ida Quell": ("quell",)}


@query(f"""WITH {LEGAL}, m AS (SELECT doc_id, list_filter(['Mara Ellwood', 'Jon Tarrin', 'Ida Quell'], lambda n: CASE n WHEN 'Mara Ellwood' THEN contains(lower(text), 'ellwood') WHEN 'Jon Tarrin' THEN contains(lower(text), 'tarrin') OR contains(lower(text), 'tarran') ELSE contains(lower(text), 'quell') END) AS names FROM legal)
SELECT doc_id, array_to_string(names, ';') AS names, CASE WHEN len(names) = 1 THEN names[1] END AS judge FROM m""")
def judge_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical names whose aliases occur; the judge only if there is one."""
    lowered = F.lower("text")
    hit = lambda aliases: " OR ".join(f"contains(t, '{a}')" for a in aliases)
    names = F.array_compact(F.array(*[F.when(F.expr(hit(a)), F.lit(n)) for n, a in JUDGES.items()]))
    rows = legal(spark, sf_dir).select("doc_id", lowered.alias("t")).select("doc_id", names.alias("n"))
    return rows.select("doc_id", F.array_join("n", ";").alias("names"), F.when(F.size("n") == 1, F.get("n", F.lit(0))).alias("judge"))


#: Case types and their words with weights; a parameter of a deployment.
CASE_TYPES = {"noise": {"thshon": 1.0, "ertion": 0.6}, "repair": {"thention": 1.0, "onthe": 0.5, "ment": 0.25}, "rent": {"rent": 1.0, "the": 0.2}}


@query("""WITH t AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, unnest([{'k': 'noise', 's': CASE WHEN contains(t, 'thshon') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'ertion') THEN 0.6::DOUBLE ELSE 0 END},
 {'k': 'rent', 's': CASE WHEN contains(t, 'rent') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'the') THEN 0.2::DOUBLE ELSE 0 END},
 {'k': 'repair', 's': CASE WHEN contains(t, 'thention') THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'onthe') THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN contains(t, 'ment') THEN 0.25::DOUBLE ELSE 0 END}], recursive := true) FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, k) AS rn FROM s)
SELECT doc_id, CASE WHEN s < 0.45 THEN 'general' ELSE k END AS case_type, round(s, 4) AS score FROM r WHERE rn = 1""")
def taxonomy_suggestion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The case type with most weight of words found, or the general one."""
    t = F.lower("text")
    scored = [F.struct((-sum((F.when(F.contains(t, F.lit(w)), v).otherwise(0.0) for w, v in words.items()), F.lit(0.0))).alias("less"), F.lit(k).alias("k")) for k, words in sorted(CASE_TYPES.items())]
    best = F.array_min(F.array(*scored))
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", best.alias("best"))
    score = -F.col("best.less")
    return rows.select("doc_id", F.when(score < 0.45, "general").otherwise(F.col("best.k")).alias("case_type"), F.round(score, 4).alias("score"))


_LEGAL_PARAGRAPHS = f"""WITH {LEGAL}, l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM legal),
p AS (SELECT * FROM (SELECT doc_id, CAST(unnest(range(0, len(l))) AS INTEGER) AS n, unnest(l) AS t FROM l) WHERE trim(t) <> '')"""


def _legal_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = legal(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t"))
    return rows.where(F.trim("t") != "")


_REFS = r"(?i)\bordinance\s+([0-9]+(?:\.[0-9]+)*(?:\([a-z0-9]+\))*)"
_CODES = r"\b(?:IC-\d{1,4}[A-Z]?|[A-Z]{1,3}\d{1,4}(?:\.\d+)*(?:[A-Z])?|[A-Z]{1,4}-\d{1,4}[A-Z]?)\b"
_SIGNAL_SQL = ", ".join(f"regexp_matches(lower(t), {_q(p)}) AS {n}" for n, p in ex.SIGNALS.items())


@query(_LEGAL_PARAGRAPHS + f""", r AS (SELECT doc_id, n, t, len(list_distinct(regexp_extract_all(t, {_q(_REFS)}, 1))) + len(list_distinct(regexp_extract_all(t, {_q(_CODES)}))) AS refs, {_SIGNAL_SQL} FROM p)
SELECT doc_id, n, CAST(refs AS BIGINT) AS refs, round(refs * 1000.0::DOUBLE / length(t), 4) AS density, CAST(disposition AS INTEGER) + CAST(findings AS INTEGER) + CAST(procedural AS INTEGER) + CAST(authority AS INTEGER) AS topics FROM r WHERE refs > 0 OR disposition OR findings""")
def citation_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References, their density and the topics that a paragraph signals."""
    t, lowered = F.col("t"), F.lower("t")
    refs = F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(_REFS), F.lit(1)))) + F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(_CODES), F.lit(0))))
    topics = sum((ex.signal(lowered, n).cast("int") for n in ("findings", "procedural", "authority")), ex.signal(lowered, "disposition").cast("int"))
    rows = _legal_paragraphs(spark, sf_dir).select("doc_id", "n", refs.cast("bigint").alias("refs"), F.length(t).alias("len"), topics.alias("topics"), (ex.signal(lowered, "disposition") | ex.signal(lowered, "findings")).alias("keep"))
    return rows.where("refs > 0 OR keep").select("doc_id", "n", "refs", F.round(F.col("refs") * 1000.0 / F.col("len"), 4).alias("density"), "topics")


_HEADING_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(h), {_q(p)}) THEN '{k}'" for k, p in ex.HEADING_TYPES) + " END"
_S = {n: f"regexp_matches(lower(t), {_q(p)})" for n, p in ex.SIGNALS.items()}


#: [type, confidence] of a paragraph t with a heading type ht and a density.
_KIND_SQL = f"""CASE WHEN ht IS NOT NULL THEN [ht, CASE WHEN ht = 'findings' THEN '0.93' ELSE '0.9' END] WHEN {_S['disposition']} THEN ['holding_disposition', '0.78'] WHEN {_S['findings']} THEN ['findings', '0.76'] WHEN {_S['procedural']} THEN ['procedural_history', '0.7']
  WHEN {_S['facts']} AND NOT {_S['authority']} THEN ['facts_background', '0.68'] WHEN {_S['issue']} THEN ['issue_statement', '0.66'] WHEN {_S['analysis']} THEN ['analysis_reasoning', '0.64'] WHEN {_S['authority']} OR density >= 2.0 THEN ['authority_discussion', CASE WHEN density >= 2.6 THEN '0.72' ELSE '0.66' END]
  WHEN {_S['caption']} THEN ['caption_title', '0.62'] ELSE ['general_body', '0.53'] END"""


@query(_LEGAL_PARAGRAPHS + f""", h AS (SELECT doc_id, n, t, ['Body', 'Findings of Fact', 'Body', 'Order', 'Body'][n % 5 + 1] AS h, len(list_distinct(regexp_extract_all(t, {_q(_REFS)}, 1))) * 1000.0::DOUBLE / length(t) AS density FROM p),
k AS (SELECT *, {_HEADING_SQL} AS ht FROM h),
c AS (SELECT doc_id, n, t, density, {_KIND_SQL} AS k FROM k)
SELECT doc_id, n, k[1] AS chunk_type, CAST(k[2] AS DOUBLE) AS confidence, CASE WHEN k[1] IN ('holding_disposition', 'findings') OR k[1] = 'analysis_reasoning' AND CAST(k[2] AS DOUBLE) >= 0.66 OR k[1] = 'authority_discussion' AND density > 0 THEN 'high'
  WHEN k[1] IN ('procedural_history', 'facts_background', 'issue_statement') OR {_S['authority']} OR {_S['findings']} OR {_S['disposition']} THEN 'medium' ELSE 'low' END AS priority FROM c""")
def chunk_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type, confidence and retrieval priority of each paragraph."""
    heading = F.element_at(F.array(*map(F.lit, ("Body", "Findings of Fact", "Body", "Order", "Body"))), F.col("n") % 5 + 1)
    density = F.size(F.array_distinct(F.regexp_extract_all("t", F.lit(_REFS), F.lit(1)))) * 1000.0 / F.length("t")
    rows = _legal_paragraphs(spark, sf_dir).select("doc_id", "n", "t", density.alias("density"), ex.chunk_class(heading, F.col("t"), density).alias("k"))
    priority = ex.retrieval_priority(F.col("k.type"), F.col("k.confidence"), F.col("density") > 0, F.lower("t"))
    return rows.select("doc_id", "n", F.col("k.type").alias("chunk_type"), F.col("k.confidence").alias("confidence"), priority.alias("priority"))


@query(f"""WITH {PARAGRAPHS}, h AS (SELECT id, paragraph_order, paragraph_text, length(paragraph_text) BETWEEN 3 AND 120 AND (regexp_matches(paragraph_text, '^[A-Z0-9\\s()\\-.,'']+$') AND regexp_matches(paragraph_text, '[A-Z]') AND length(paragraph_text) <= 80
  OR regexp_matches(paragraph_text, '^(?:[0-9]+(?:\\.[0-9]+)*|[IVXLCM]+)\\.?\\s+[A-Za-z].{{0,80}}$') OR regexp_matches(paragraph_text, '^[A-Za-z][A-Za-z\\s]{{2,80}}:$') OR length(paragraph_text) < 30) AS is_heading FROM paragraphs),
s AS (SELECT *, sum(CAST(is_heading AS INTEGER)) OVER (PARTITION BY id ORDER BY paragraph_order) AS section FROM h),
k AS (SELECT *, coalesce(max(CASE WHEN is_heading THEN regexp_replace(regexp_replace(lower(paragraph_text), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g') END) OVER (PARTITION BY id, section), 'body') AS key FROM s)
SELECT id, paragraph_order, CAST(section AS BIGINT) AS section, key || '-p' || row_number() OVER (PARTITION BY id, section ORDER BY paragraph_order) AS anchor FROM k WHERE NOT is_heading""")
def sectioniser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs in the sections that headings open, with their anchors."""
    p = F.col("paragraph_text")
    capitals = F.regexp_like(p, F.lit(r"^[A-Z0-9\s()\-.,']+$")) & F.regexp_like(p, F.lit("[A-Z]")) & (F.length(p) <= 80)
    numbered = F.regexp_like(p, F.lit(r"^(?:[0-9]+(?:\.[0-9]+)*|[IVXLCM]+)\.?\s+[A-Za-z].{0,80}$"))
    colon = F.regexp_like(p, F.lit(r"^[A-Za-z][A-Za-z\s]{2,80}:$"))
    heading = F.length(p).between(3, 120) & (capitals | numbered | colon | (F.length(p) < 30))
    w = Window.partitionBy("id").orderBy("paragraph_order")
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", p, heading.alias("is_heading")).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    own = Window.partitionBy("id", "section")
    rows = rows.withColumn("key", F.coalesce(F.max(F.when(F.col("is_heading"), tx.slug(p))).over(own), F.lit("body"))).where("NOT is_heading")
    return rows.select("id", "paragraph_order", "section", F.concat("key", F.lit("-p"), F.row_number().over(own.orderBy("paragraph_order")).cast("string")).alias("anchor"))


def pack(lengths: list[int], target: int = 640, least: int = 200, most: int = 900) -> list[int]:
    """The chunk of each paragraph: a chunk closes when it reaches the target, or
    before a paragraph that would take it over the most, if it has the least."""
    out, chunk, length, filled = [], 0, 0, False
    for n in lengths:
        if filled and length + n > most and length >= least:
            chunk, length = chunk + 1, 0
        out.append(chunk)
        length, filled = length + n, True
        if length >= target:
            chunk, length, filled = chunk + 1, 0, False
    return out


#: Characters of a retrieval chunk, and its overlap in paragraphs.
TARGET, CHUNK_LEAST, CHUNK_MOST, OVERLAP = 650, 250, 980, 1


def overlapping(lengths: Sequence[int], target: int = TARGET, least: int = CHUNK_LEAST, most: int = CHUNK_MOST) -> list[tuple[int, int]]:
    """(first, last) paragraphs of chunks that share one with the next.

    A chunk ends with the paragraph that reaches the target, or before it, if that
    one would take a chunk of the least length over the most.  The next begins
    with its last paragraph, or behind it if that is the whole chunk; so the last
    paragraph comes once more alone, where its chunk has others."""
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    out, first = [], 0
    while first < len(lengths):
        last = int(np.searchsorted(total, total[first] + target)) - 1
        if last >= len(lengths):
            last = len(lengths) - 1
        elif total[last + 1] - total[first] > most and total[last] - total[first] >= least:
            last -= 1
        last = max(first, last)
        out.append((first, last))
        first = last if last > first else last + OVERLAP
    return out


#: Characters from which a paragraph is split, and of a part at most.
LONG_PARAGRAPH, PART_MOST = 900, 520


def split_long(text: Column) -> Column:
    """The parts of a paragraph: whole if it is not long, else runs of sentences."""
    sentences = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: s != "")

    def take(parts: Column, sentence: Column) -> Column:
        last = F.get(parts, F.size(parts) - 1)
        fits = F.length(last) + 1 + F.length(sentence) <= PART_MOST
        longer = F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat_ws(" ", last, sentence)))
        return F.when(fits, longer).otherwise(F.concat(parts, F.array(sentence)))

    return F.when(F.length(text) < LONG_PARAGRAPH, F.array(text)).otherwise(F.aggregate(sentences, F.array().cast("array<string>"), take))


@query(f"""WITH {PARAGRAPHS}, j AS (SELECT id, string_agg(trim(paragraph_text), ' ' ORDER BY paragraph_order) AS t FROM paragraphs GROUP BY id),
s AS (SELECT id, t, list_filter(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM j),
r AS (SELECT id, CASE WHEN length(t) < {LONG_PARAGRAPH} THEN [t] ELSE list_reduce(list_transform(s, lambda x: [x]), lambda a, x: CASE WHEN length(a[-1]) + 1 + length(x[1]) <= {PART_MOST} THEN list_concat(a[:-2], [a[-1] || ' ' || x[1]]) ELSE list_concat(a, x) END) END AS p FROM s)
SELECT id, CAST(len(p) AS BIGINT) AS n_parts, CAST(list_max(list_transform(p, lambda x: length(x))) AS BIGINT) AS longest, md5(array_to_string(p, chr(10))) AS digest FROM r""")
def long_paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents merged to one paragraph each, split at sentences again."""
    rows = paragraphs(decisions(spark, sf_dir)).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("paragraph_order", F.trim("paragraph_text").alias("t")))).alias("all"))
    parts = rows.select("id", split_long(F.array_join(F.col("all.t"), " ")).alias("p"))
    return parts.select("id", F.size("p").cast("bigint").alias("n_parts"), F.array_max(F.transform("p", F.length)).cast("bigint").alias("longest"), F.md5(F.array_join("p", "\n")).alias("digest"))


@query(f"""WITH RECURSIVE {PARAGRAPHS}, o AS (SELECT id, paragraph_order, length(paragraph_text) AS n, row_number() OVER (PARTITION BY id ORDER BY paragraph_order) AS i FROM paragraphs),
g AS (SELECT id, i, n AS len, 0 AS chunk, n >= 640 AS closed FROM o WHERE i = 1
  UNION ALL SELECT o.id, o.i, CASE WHEN closed OR len + n > 900 AND len >= 200 THEN n ELSE len + n END, CASE WHEN closed OR len + n > 900 AND len >= 200 THEN chunk + 1 ELSE chunk END, CASE WHEN closed OR len + n > 900 AND len >= 200 THEN n ELSE len + n END >= 640 FROM g JOIN o ON o.id = g.id AND o.i = g.i + 1),
c AS (SELECT id, chunk, min(i) AS a, max(i) AS b, CAST(sum(n) + 2 * (count(*) - 1) AS BIGINT) AS n_chars FROM g JOIN o USING (id, i) GROUP BY id, chunk)
SELECT id, chunk, CAST(b - a + 1 AS BIGINT) AS n_paragraphs, n_chars, CAST(greatest(1, ceil(n_chars / 4.0)) AS BIGINT) AS token_estimate, CASE WHEN n_chars < 200 THEN 'small_chunk' WHEN n_chars > 900 THEN 'large_chunk' ELSE '' END AS warning FROM c""")
def greedy_chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed to chunks: sequential within a document, so in Arrow
    batches of documents; each document's paragraphs bound its row."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", F.length("paragraph_text").alias("n"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("paragraph_order", "n"))).alias("all"))
    listed = listed.select("id", F.transform("all", lambda p: p["n"]).alias("lengths"))

    def start() -> Callable:
        def compute(lengths: pa.Array) -> list:
            return [[pack(x.as_py()) for x in lengths]]

        return compute

    packed = add_columns(listed, ["lengths"], [T.StructField("chunks", T.ArrayType(T.IntegerType()))], start)
    each = packed.select("id", F.inline(F.arrays_zip("lengths", "chunks"))).groupBy("id", F.col("chunks").alias("chunk")).agg(F.count("*").alias("n_paragraphs"), (F.sum("lengths") + 2 * (F.count("*") - 1)).alias("n_chars"))
    warning = F.when(F.col("n_chars") < 200, "small_chunk").when(F.col("n_chars") > 900, "large_chunk").otherwise("")
    return each.select("id", "chunk", "n_paragraphs", "n_chars", F.greatest(F.lit(1), F.ceil(F.col("n_chars") / 4.0)).cast("bigint").alias("token_estimate"), warning.alias("warning"))


@query(f"""WITH RECURSIVE {PARAGRAPHS}, o AS (SELECT id, length(paragraph_text) AS n, row_number() OVER (PARTITION BY id ORDER BY paragraph_order) - 1 AS i, count(*) OVER (PARTITION BY id) AS m, sum(length(paragraph_text)) OVER (PARTITION BY id ORDER BY paragraph_order) AS c FROM paragraphs),
r AS (SELECT a.id, a.i, a.m, a.c - a.n AS base, min(b.i) AS j FROM o AS a LEFT JOIN o AS b ON a.id = b.id AND b.i >= a.i AND b.c >= a.c - a.n + {TARGET} GROUP BY a.id, a.i, a.m, base),
e AS (SELECT r.id, r.i, r.m, greatest(r.i, CASE WHEN j IS NULL THEN r.m - 1 WHEN o.c - base > {CHUNK_MOST} AND o.c - o.n - base >= {CHUNK_LEAST} THEN j - 1 ELSE j END) AS last FROM r LEFT JOIN o ON o.id = r.id AND o.i = r.j),
w AS (SELECT id, i, last, m FROM e WHERE i = 0 UNION ALL SELECT e.id, e.i, e.last, e.m FROM w JOIN e ON e.id = w.id AND e.i = CASE WHEN w.last > w.i THEN w.last ELSE w.last + {OVERLAP} END)
SELECT id, CAST(i AS INTEGER) AS first, CAST(last AS INTEGER) AS last FROM w""")
def overlap_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval chunks that share a paragraph with the next, and stable ids."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", F.length("paragraph_text").alias("n"))
    listed = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("paragraph_order", "n"))).alias("all")).select("id", F.transform("all", lambda p: p["n"]).alias("lengths"))

    def start() -> Callable:
        def compute(lengths: pa.Array) -> list:
            found = [overlapping(x.as_py()) for x in lengths]
            return [[[a for a, _ in f] for f in found], [[b for _, b in f] for f in found]]

        return compute

    ints = T.ArrayType(T.IntegerType())
    found = add_columns(listed, ["lengths"], [T.StructField("first", ints), T.StructField("last", ints)], start, drop=["lengths"])
    return found.select("id", F.inline(F.arrays_zip("first", "last")))


@query(f"""WITH {PARAGRAPHS}, k AS (SELECT id, paragraph_order, id || ':' || paragraph_order AS k FROM paragraphs)
SELECT id, paragraph_order, lpad(lower(to_hex(list_reduce(list_transform(string_split(k, ''), lambda c: CAST(ord(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) & 4294967295, 2166136261::BIGINT))), 8, '0') AS stable_id FROM k""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of paragraphs that depend on their document and place only."""
    rows = paragraphs(decisions(spark, sf_dir))
    return rows.select("id", "paragraph_order", ex.fnv1a(F.concat_ws(":", F.col("id").cast("string"), F.col("paragraph_order").cast("string"))).alias("stable_id"))


@query("""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '(?i)</(?:p|div|li|h[1-6]|tr)>|<br[^>]*>', chr(10), 'g') AS t FROM pages),
s AS (SELECT page_id, replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&amp;', '&'), '&quot;', '"'), '&#39;', '''') AS t FROM t),
p AS (SELECT page_id, unnest(string_split(t, chr(10))) AS line FROM s), c AS (SELECT page_id, trim(regexp_replace(line, '[ \\t\\r]+', ' ', 'g')) AS line FROM p)
SELECT page_id, count(*) AS n_paragraphs, CAST(sum(length(line)) AS BIGINT) AS n_chars, min(md5(line)) AS least_digest FROM c WHERE line <> '' GROUP BY page_id""")
def html_strip_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of markup: scripts go, block ends break lines, tags and
    entities are resolved."""
    t = F.regexp_replace("html", r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"(?i)</(?:p|div|li|h[1-6]|tr)>|<br[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]+>", " ")
    for entity, plain in (("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    lines = table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.explode(F.split(t, "\n")).alias("line")).select("page_id", F.trim(F.regexp_replace("line", r"[ \t\r]+", " ")).alias("line")).where("line <> ''")
    return lines.groupBy("page_id").agg(F.count("*").alias("n_paragraphs"), F.sum(F.length("line")).alias("n_chars"), F.min(F.md5("line")).alias("least_digest"))
