"""What assistants need before any model is asked: query lists, templates by case
type, drafts of their sections, and the inventory of rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.lexical import tokens_sql
from tessera.sources.tables import DECISIONS, decisions, table

#: Queries of a case at most, scoped ones among them, and tokens of its
#: findings and its law that the first query takes.
MOST_QUERIES, MOST_SCOPED, FINDINGS_TOKENS, LAW_TOKENS = 8, 8, 10, 8


def case_queries(findings: Column, law: Column, tags: Column, scoped: Column) -> Column:
    """Queries for one case: words of its texts and its tags, then each code,
    section and tag on its own; distinct, in that order."""
    first = lambda text, n: F.array_join(F.slice(F.coalesce(tx.tokens(text), F.array().cast("array<string>")), 1, n), " ")
    base = F.trim(F.array_join(F.filter(F.array(first(findings, FINDINGS_TOKENS), first(law, LAW_TOKENS), F.array_join(tags, " ")), lambda x: x != ""), " "))
    own = F.slice(F.filter(F.transform(F.concat(scoped, tags), lambda x: F.trim(x)), lambda x: x != ""), 1, MOST_SCOPED)
    return F.slice(F.array_distinct(F.filter(F.concat(F.array(base), own), lambda x: x != "")), 1, MOST_QUERIES)


_TAGS, _SCOPED = "array(author, jurisdiction)", "array(concat('G', id % 90 + 10), concat(' Rule ', id % 12), '', concat('37.', id % 15))"


def query_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries of decisions as cases: their first line as findings, the second
    as law."""
    line = lambda n: F.coalesce(F.get(F.split("text", "\n"), F.lit(n)), F.lit(""))
    rows = decisions(spark, sf_dir).where("text IS NOT NULL AND author IS NOT NULL AND jurisdiction IS NOT NULL")
    found = rows.select("id", case_queries(line(0), line(1), F.expr(_TAGS), F.expr(_SCOPED)).alias("q"))
    return found.select("id", F.size("q").alias("n"), F.array_join("q", "|").alias("queries"))


# ---- templates ---------------------------------------------------------------

#: Case types: label, aliases, and hints for sections; a parameter of a deployment.
TEMPLATES = {
    "noise": ("Noise", ("quiet", "sound"), {"Findings of Fact": ("When was it heard?", "Who heard it?")}),
    "repair": ("Repair", ("maintenance", "leak"), {"Findings of Fact": ("What was reported?",), "Order": ("Name the date of repair.",)}),
    "general": ("General", (), {}),
}
DEFAULT = "general"
#: Sections of a draft: placeholder and prompts; a parameter of a deployment.
SECTIONS = {
    "Findings of Fact": ("State the facts.", ("List the witnesses.",)),
    "Conclusions of Law": ("Apply the law.", ("Cite the sections.", "Weigh the evidence.")),
    "Order": ("State the outcome.", ()),
}
#: Modes of a draft: without prompts or authorities, with them, and with a mark of context.
BLANK, GUIDED, CONTEXT = "blank_scaffold", "guided_scaffold", "lightly_contextualized"
#: Sections whose passages a conclusion may cite, and citations of a section.
AUTHORITY, CITED = r"(?i)conclusions? of law|reasoning|analysis", 2


def templates(spark: SparkSession) -> DataFrame:
    """(name, kind, case_type): each id as itself, and each alias."""
    rows = [(k, "id", k) for k in TEMPLATES] + [(a, "alias", k) for k, (_, aliases, _) in TEMPLATES.items() for a in aliases]
    return spark.createDataFrame(rows, "name string, kind string, case_type string")


def resolved(requests: DataFrame, names: DataFrame, asked: str) -> DataFrame:
    """requests with ``case_type`` and ``match_type``: by id, else by alias, else the
    default."""
    by = lambda kind: names.where(F.col("kind") == kind).select(F.col("name").alias(f"{kind}_name"), F.col("case_type").alias(f"{kind}_type"))
    folded = tx.fold(F.col(asked))
    found = requests.join(F.broadcast(by("id")), folded == F.col("id_name"), "left").join(F.broadcast(by("alias")), folded == F.col("alias_name"), "left")
    kind = F.when(F.col("id_type").isNotNull(), "id").when(F.col("alias_type").isNotNull(), "alias").otherwise("fallback")
    return found.select(*requests.columns, F.coalesce("id_type", "alias_type", F.lit(DEFAULT)).alias("case_type"), kind.alias("match_type"))


def sections_of(mode: Column, case_type: Column, authorities: Column) -> Column:
    """A draft's sections: name, text, prompts, and of (section_label, citation) in
    order the citations; a blank one has neither."""
    blank, out = mode == BLANK, []
    none = F.array().cast("array<string>")
    for name, (placeholder, prompts) in SECTIONS.items():
        hints = F.lit(None).cast("array<string>")
        for k, (_, _, own) in TEMPLATES.items():
            if name in own:
                hints = F.coalesce(hints, F.when(case_type == k, F.array(*map(F.lit, own[name]))))
        every = F.concat(F.array(*map(F.lit, prompts)).cast("array<string>"), F.coalesce(hints, none))
        fit = F.filter(authorities, lambda a: F.regexp_like(a["section_label"], F.lit(AUTHORITY))) if name == "Conclusions of Law" else authorities
        cited = F.transform(F.slice(fit, 1, CITED), lambda a: a["citation"])
        text = F.concat(F.lit(placeholder), F.when(mode == CONTEXT, " (context applied)").otherwise(""))
        out.append(F.struct(F.lit(name).alias("section"), text.alias("text"), F.when(blank, none).otherwise(every).alias("prompts"), F.when(blank, none).otherwise(cited).alias("cited")))
    return F.array(*out)


_REQUESTED = "CASE CAST(id % 6 AS INTEGER) WHEN 0 THEN 'noise' WHEN 1 THEN 'Quiet' WHEN 2 THEN 'leak' WHEN 3 THEN 'repair' WHEN 4 THEN 'general' ELSE 'unknown' END"
_MODE = f"CASE CAST(id % 3 AS INTEGER) WHEN 0 THEN '{BLANK}' WHEN 1 THEN '{GUIDED}' ELSE '{CONTEXT}' END"


def template_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts for decisions as requests, each with two authorities at hand."""
    pair = "array(named_struct('section_label', 'Findings', 'citation', concat('a', id)), named_struct('section_label', 'Reasoning', 'citation', concat('b', id)), named_struct('section_label', 'Analysis', 'citation', concat('c', id)))"
    rows = table(spark, sf_dir, "documents", "doc_id").withColumnRenamed("doc_id", "id").select("id", F.expr(_REQUESTED).alias("asked"), F.expr(_MODE).alias("mode"))
    found = resolved(rows, templates(spark), "asked").select("id", "case_type", "match_type", F.inline(sections_of(F.col("mode"), F.col("case_type"), F.expr(pair))))
    return found.select("id", "case_type", "match_type", "section", "text", F.array_join("prompts", "|").alias("prompts"), F.array_join("cited", ",").alias("cited"))


# ---- inventory ---------------------------------------------------------------

#: Rows of an inventory without a limit, and at most.
LISTED, MOST_LISTED = 100, 500


def inventory(rules: DataFrame, prefix: str = "", citation: str = "", limit: int = LISTED) -> DataFrame:
    """Active rules (citation, normalized, bare, active), by a prefix or a whole
    citation of either form, in order."""
    rows = rules.where("active = 1")
    if citation:
        rows = rows.where((F.col("normalized") == citation) | (F.col("bare") == citation))
    if prefix:
        rows = rows.where(F.startswith("normalized", F.lit(prefix)) | F.startswith("bare", F.lit(prefix)))
    return rows.orderBy("citation").limit(max(1, min(limit, MOST_LISTED)))


_RULES = "SELECT concat('Rule ', p_size, '.', p_partkey) AS citation, lower(concat('rule', p_size, '.', p_partkey)) AS normalized, concat(p_size, '.', p_partkey) AS bare, CAST(p_partkey % 4 > 0 AS INTEGER) AS active FROM {}"


def rules_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules whose bare citation begins with a chapter; parts stand for rules."""
    rules = spark.sql(_RULES.format("{part}"), part=table(spark, sf_dir, "part", "p_partkey", "p_size"))
    return inventory(rules, prefix="1").select("citation", "normalized", "bare")


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_NAMES = ", ".join([f"('{k}', 1, '{k}')" for k in TEMPLATES] + [f"('{a}', 2, '{k}')" for k, (_, aliases, _) in TEMPLATES.items() for a in aliases])
_HINTS = ", ".join(f"('{s}', {i}, '{t}', {_text(p)})" for k, (i, t, s, p) in enumerate([*[(n, None, s, p) for s, (_, prompts) in SECTIONS.items() for n, p in enumerate(prompts)], *[(100 + n, k, s, p) for k, (_, _, own) in TEMPLATES.items() for s, hints in own.items() for n, p in enumerate(hints)]])).replace("'None'", "NULL")
_PLACES = ", ".join(f"('{s}', {_text(p)})" for s, (p, _) in SECTIONS.items())

QUERIES = {f.__name__: f for f in (query_lists, template_drafts, rules_inventory)}
SQL = {
    "query_lists": f"""WITH {DECISIONS}, c AS (SELECT id, array_to_string({tokens_sql("coalesce(string_split(text, chr(10))[1], '')")}[1:{FINDINGS_TOKENS}], ' ') AS f, array_to_string({tokens_sql("coalesce(string_split(text, chr(10))[2], '')")}[1:{LAW_TOKENS}], ' ') AS l, author || ' ' || jurisdiction AS t,
  list_filter(list_transform(['G' || (id % 90 + 10), ' Rule ' || id % 12, '', '37.' || id % 15, author, jurisdiction], lambda x: trim(x)), lambda x: x <> '')[1:{MOST_SCOPED}] AS s FROM decisions WHERE text IS NOT NULL AND author IS NOT NULL AND jurisdiction IS NOT NULL),
a AS (SELECT id, list_filter(list_concat([trim(concat_ws(' ', nullif(f, ''), nullif(l, ''), nullif(t, '')))], s), lambda x: x <> '') AS q FROM c),
d AS (SELECT id, list_filter(q, lambda x, i: list_position(q, x) = i)[1:{MOST_QUERIES}] AS q FROM a)
SELECT id, CAST(len(q) AS INTEGER) AS n, array_to_string(q, '|') AS queries FROM d""",
    "template_drafts": f"""WITH n(name, kind, case_type) AS (VALUES {_NAMES}), r AS (SELECT doc_id AS id, lower(CASE CAST(doc_id % 6 AS INTEGER) WHEN 0 THEN 'noise' WHEN 1 THEN 'Quiet' WHEN 2 THEN 'leak' WHEN 3 THEN 'repair' WHEN 4 THEN 'general' ELSE 'unknown' END) AS asked, doc_id % 3 AS mode FROM documents),
t AS (SELECT r.*, coalesce(case_type, '{DEFAULT}') AS case_type, CASE kind WHEN 1 THEN 'id' WHEN 2 THEN 'alias' ELSE 'fallback' END AS match_type FROM r LEFT JOIN n ON name = asked),
p(section, place, of, prompt) AS (VALUES {_HINTS}), s(section, placeholder) AS (VALUES {_PLACES})
SELECT id, case_type, match_type, section, placeholder || CASE WHEN mode = 2 THEN ' (context applied)' ELSE '' END AS text,
  CASE WHEN mode = 0 THEN '' ELSE coalesce((SELECT string_agg(prompt, '|' ORDER BY place) FROM p WHERE p.section = s.section AND (p.of IS NULL OR p.of = t.case_type)), '') END AS prompts,
  CASE WHEN mode = 0 THEN '' WHEN section = 'Conclusions of Law' THEN 'b' || id || ',c' || id ELSE 'a' || id || ',b' || id END AS cited FROM t CROSS JOIN s""",
    "rules_inventory": f"SELECT citation, normalized, bare FROM ({_RULES.format('part')}) WHERE active = 1 AND (starts_with(normalized, '1') OR starts_with(bare, '1')) ORDER BY citation LIMIT {LISTED}",
}
