"""Dry run of a reviewers' sheet: what each row would do, and why not.

A row is checked against its document by a table of states in order: the first whose
condition holds is the row's.  Conditions are SQL over a few named columns, so that
both the shape checks and the states are data."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import table


class State(NamedTuple):
    condition: str
    state: str
    outcome: str
    reason: str = ""
    safe: bool = False


#: What reviewers may decide and do, words for yes and no, bases of
#: citations that may and may not be replaced, and unresolved kinds that block.
DECISIONS = ("", "no_action", "confirm_metadata", "citation_fix", "escalate", "do_not_approve")
ACTIONS = ("", "replace_citation", "normalize_format", "drop_reference", "relabel_context")
REPLACING = ("replace_citation", "normalize_format", "relabel_context")
YES, NO = ("1", "true", "yes", "y"), ("0", "false", "no", "n")
SAFE_BASES, UNSAFE_BASES = ("37.1", "37.2", "37.8"), ("37.3", "37.7", "37.9")
BLOCKING = ("unsafe_37x_structural_block", "cross_context_ambiguous", "structurally_blocked_not_found")

_IN = lambda c, values: f"{c} IN ({', '.join(repr(v) for v in values)})"
_NO_REPLACEMENT = f"fix AND {_IN('action', REPLACING)} AND replacement = ''"
_UNDECIDED = "decision = '' AND NOT confirm AND NOT escalate AND NOT reject"
_BLANK = f"{_UNDECIDED} AND action = '' AND original = '' AND replacement = ''"

#: What is wrong with a row's shape, in order.
SHAPE = (
    ("missing_documentId", "document = ''"),
    ("invalid_reviewerDecision", f"NOT {_IN('decision', DECISIONS)}"),
    ("invalid_citationActionType", f"NOT {_IN('action', ACTIONS)}"),
    ("citation_fields_without_action", "(original <> '' OR replacement <> '') AND action = ''"),
    ("missing_citationOriginal", "action <> '' AND action <> 'drop_reference' AND original = ''"),
    ("missing_citationReplacement", f"{_IN('action', REPLACING)} AND replacement = ''"),
    ("invalid_boolean", "strict AND bad_flag"),
    ("conflicting_escalate_and_doNotApprove", "escalate AND reject"),
    ("conflicting_confirm_and_doNotApprove", "decision = 'confirm_metadata' AND reject"),
)
#: The states in order.
STATES = (
    State(f"NOT {_IN('decision', DECISIONS)}", "invalid_unknown_decision", "invalid_row"),
    State(f"NOT {_IN('action', ACTIONS)}", "invalid_unknown_action_type", "unsupported_action"),
    State(f"fix AND {_UNDECIDED}", "invalid_missing_required_fields", "invalid_row", "missing_reviewerDecision"),
    State(f"document = '' OR ({_NO_REPLACEMENT})", "invalid_missing_required_fields", "invalid_row"),
    State("NOT found", "invalid_missing_required_fields", "document_not_found", "document_not_found"),
    State("title <> '' AND NOT same_title", "invalid_title_mismatch", "title_mismatch", "title_mismatch"),
    State("(escalate AND reject) OR (decision = 'confirm_metadata' AND reject)", "invalid_conflicting_flags", "conflicting_flags"),
    State(f"{_BLANK} AND batch = ''", "blank_template_row", "incomplete_row", "missing_batchKey_on_blank_template_row,no_adjudication_fields_set"),
    State(_BLANK, "blank_template_row", "incomplete_row", "no_adjudication_fields_set"),
    State("batch = ''", "invalid_missing_required_fields", "invalid_row", "missing_batchKey_on_reviewed_row"),
    State("action = 'relabel_context'", "reviewed_citation_fix_blocked", "unsupported_action", "relabel_context_not_simulated"),
    State("decision = 'escalate' OR escalate", "reviewed_escalate", "no_action"),
    State("decision = 'do_not_approve' OR reject", "reviewed_do_not_approve", "no_action"),
    State("decision = 'no_action'", "reviewed_no_action", "no_action"),
    State("(decision = 'confirm_metadata' OR confirm) AND unlocks AND NOT blocked", "reviewed_confirm_metadata", "metadata_confirmation_candidate", "", True),
    State("decision = 'confirm_metadata' OR confirm", "reviewed_confirm_metadata", "blocked_structural", "metadata_confirmation_not_safe_for_structural_block"),
    State("fix AND blocked", "reviewed_citation_fix_blocked", "blocked_structural", "structural_unresolved_blockers_present"),
    State("fix AND safe_fix", "reviewed_citation_fix_supported", "one_safe_manual_fix_candidate", "", True),
    State("fix", "reviewed_citation_fix_blocked", "blocked_structural", "no_safe_simulated_path"),
    State("true", "invalid_missing_required_fields", "invalid_row", "missing_reviewerDecision"),
)
_SAFE_FIX = (
    f"{_IN('action', ('replace_citation', 'normalize_format'))} AND NOT {_IN('replacement_base', UNSAFE_BASES)} AND replacement <> ''"
    f" AND (known OR ({_IN('replacement_base', SAFE_BASES)} AND original_key LIKE 'ordinance37.%'))"
)


def citation_key(text: Column) -> Column:
    found = F.regexp_replace(F.lower(text), r"[\s_]+", "")
    for word in ("^section", r"^sec\.?", "^ordinance", "^rule", r"[^a-z0-9.()\-]"):
        found = F.regexp_replace(found, word, "")
    return found


def simulated(sheet: DataFrame, documents: DataFrame, strict: bool = False) -> DataFrame:
    """(sheet's row, state, outcome, reasons, safe) of rows (row, document, title, batch,
    decision, action, original, replacement, confirm, escalate, reject, all strings) and
    documents (document, title, unlocks, buckets, references).  Nulls are empty; a
    document has one row in documents, a missing one null in each column."""
    trimmed = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    flags = ("confirm", "escalate", "reject")
    rows = sheet.select("row", F.coalesce("title", F.lit("")).alias("title"), *[trimmed(c).alias(c) for c in ("document", "batch", "decision", "action", "original", "replacement")], *[F.lower(trimmed(c)).alias(f"raw_{c}") for c in flags])
    docs = documents.select(F.col("document").alias("of"), F.coalesce("title", F.lit("")).alias("own_title"), "unlocks", "buckets", "references")
    rows = rows.join(docs, F.col("document") == F.col("of"), "left")
    raw = [F.col(f"raw_{c}") for c in flags]
    replaced = citation_key(F.col("replacement"))
    base = F.regexp_replace(replaced, r"\([a-z0-9]+\)", "")
    original = F.regexp_replace(F.regexp_replace(F.lower("original"), r"[\s_]+", ""), r"^(section|sec\.?)", "")
    rows = rows.withColumns({
        **{c: r.isin(*YES) for c, r in zip(flags, raw, strict=True)},
        "bad_flag": reduce(lambda a, b: a | b, [~r.isin("", *YES, *NO) for r in raw]),
        "strict": F.lit(strict),
        "fix": (F.col("decision") == "citation_fix") | (F.col("action") != ""),
        "found": F.col("of").isNotNull(),
        "same_title": (F.trim("title") == "") | (F.col("title") == F.col("own_title")),
        "unlocks": F.coalesce("unlocks", F.lit(False)),
        "blocked": F.arrays_overlap(F.coalesce("buckets", F.array().cast("array<string>")), F.array(*map(F.lit, BLOCKING))),
        "replacement_base": base,
        "original_key": original,
        "known": F.exists(F.coalesce("references", F.array().cast("array<string>")), lambda r: citation_key(r) == replaced),
    })
    rows = rows.withColumn("safe_fix", F.expr(_SAFE_FIX))
    shape = F.array_compact(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in SHAPE]))
    entry = lambda s: F.struct(F.lit(s.state).alias("state"), F.lit(s.outcome).alias("outcome"), F.lit(s.reason).alias("reason"), F.lit(s.safe).alias("safe"))
    found = reduce(lambda c, s: c.when(F.expr(s.condition), entry(s)), STATES[1:], F.when(F.expr(STATES[0].condition), entry(STATES[0])))
    rows = rows.withColumn("s", found)
    return rows.select("row", "s.state", "s.outcome", F.array_join(F.filter(F.concat(shape, F.array("s.reason")), lambda r: r != ""), ",").alias("reasons"), "s.safe")


_PICK = {
    "document": "CASE WHEN doc_id % 23 = 0 THEN '' WHEN doc_id % 29 = 0 THEN 'gone' ELSE CAST(doc_id AS {string}) END",
    "title": "CASE doc_id % 5 WHEN 0 THEN title WHEN 1 THEN '' WHEN 2 THEN concat(title, '.') ELSE title END",
    "batch": "CASE WHEN doc_id % 11 = 0 THEN '' ELSE concat('batch-', doc_id % 4) END",
    "decision": "CASE doc_id % 9 WHEN 0 THEN 'confirm_metadata' WHEN 1 THEN 'citation_fix' WHEN 2 THEN 'no_action' WHEN 3 THEN 'escalate' WHEN 4 THEN 'do_not_approve' WHEN 5 THEN 'approve' WHEN 6 THEN 'citation_fix' ELSE '' END",
    "action": "CASE doc_id % 9 WHEN 1 THEN CASE doc_id % 4 WHEN 0 THEN 'replace_citation' WHEN 1 THEN 'normalize_format' WHEN 2 THEN 'relabel_context' ELSE 'delete' END WHEN 6 THEN 'replace_citation' WHEN 7 THEN 'drop_reference' ELSE '' END",
    "original": "CASE WHEN doc_id % 9 IN (1, 6) AND doc_id % 13 > 0 THEN concat('Ordinance 37.', doc_id % 10, '(a)') ELSE '' END",
    "replacement": "CASE WHEN doc_id % 9 IN (1, 6) AND doc_id % 17 > 0 THEN concat('Section 37.', doc_id % 10, '(b)') ELSE '' END",
    "confirm": "CASE doc_id % 19 WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN 'maybe' ELSE '' END",
    "escalate": "CASE doc_id % 31 WHEN 0 THEN 'TRUE' WHEN 1 THEN '0' ELSE '' END",
    "reject": "CASE doc_id % 7 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN '1' ELSE '' END ELSE '' END",
}


def adjudication_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with a row for each document, against documents whose kinds of unresolved
    references follow their labels."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.coalesce(F.element_at(F.split("text", "\n"), 1), F.lit("")).alias("title"))
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sheet = docs.select(F.col("doc_id").alias("row"), *[F.expr(v.replace("{string}", "STRING")).alias(k) for k, v in _PICK.items()])
    bucket = F.when(F.col("quality") == 0, F.array(F.element_at(F.array(*map(F.lit, BLOCKING)), (F.col("doc_id") % 3 + 1).cast("int")))).otherwise(F.array(F.lit("unknown")))
    reference = F.array(F.concat(F.lit("Section 37."), (F.col("doc_id") % 5).cast("string"), F.lit(" (b)")))
    known = docs.join(labels, "doc_id", "left").select(F.col("doc_id").cast("string").alias("document"), "title", (F.col("doc_id") % 2 == 0).alias("unlocks"), bucket.alias("buckets"), reference.alias("references"))
    return simulated(sheet, known, strict=True)


_KEY = lambda c: "regexp_replace(" * 6 + f"lower({c}), '[\\s_]+', '', 'g'), '^section', ''), '^sec\\.?', ''), '^ordinance', ''), '^rule', ''), '[^a-z0-9.()\\-]', '', 'g')"
_FLAG = lambda c: f"lower(trim({c})) IN ({', '.join(repr(v) for v in YES)})"
_ODD = lambda c: f"lower(trim({c})) NOT IN ('', {', '.join(repr(v) for v in YES + NO)})"
QUERIES = {"adjudication_dry_run": adjudication_dry_run}
SQL = {
    "adjudication_dry_run": f"""WITH d AS (SELECT doc_id, coalesce(string_split(text, chr(10))[1], '') AS title FROM documents),
l AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
s AS (SELECT doc_id AS row, {', '.join(f"{v.replace('{string}', 'VARCHAR')} AS {k}" if k not in ('confirm', 'escalate', 'reject') else f"{v} AS raw_{k}" for k, v in _PICK.items())} FROM d),
k AS (SELECT CAST(d.doc_id AS VARCHAR) AS of, d.title AS own_title, d.doc_id % 2 = 0 AS unlocks, CASE WHEN quality = 0 THEN [[{', '.join(repr(b) for b in BLOCKING)}][d.doc_id % 3 + 1]] ELSE ['unknown'] END AS buckets, 'Section 37.' || d.doc_id % 5 || ' (b)' AS reference FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
j AS (SELECT s.* EXCLUDE (raw_confirm, raw_escalate, raw_reject), {_FLAG('raw_confirm')} AS confirm, {_FLAG('raw_escalate')} AS escalate, {_FLAG('raw_reject')} AS reject, {_ODD('raw_confirm')} OR {_ODD('raw_escalate')} OR {_ODD('raw_reject')} AS bad_flag, true AS strict,
  decision = 'citation_fix' OR action <> '' AS fix, of IS NOT NULL AS found, trim(title) = '' OR title = own_title AS same_title, coalesce(unlocks, false) AS unlocks, coalesce(list_has_any(buckets, [{', '.join(repr(b) for b in BLOCKING)}]), false) AS blocked,
  regexp_replace({_KEY('replacement')}, '\\([a-z0-9]+\\)', '', 'g') AS replacement_base, regexp_replace(regexp_replace(lower(original), '[\\s_]+', '', 'g'), '^(section|sec\\.?)', '') AS original_key, coalesce({_KEY('reference')} = {_KEY('replacement')}, false) AS known FROM s LEFT JOIN k ON document = of),
f AS (SELECT *, {_SAFE_FIX} AS safe_fix FROM j),
r AS (SELECT row, CASE {' '.join(f"WHEN {s.condition} THEN {k}" for k, s in enumerate(STATES))} END AS n, list_filter([{', '.join(f"CASE WHEN {test} THEN '{name}' END" for name, test in SHAPE)}], lambda x: x IS NOT NULL) AS shape FROM f),
t AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{s.state}', '{s.outcome}', '{s.reason}', {str(s.safe).lower()})" for k, s in enumerate(STATES))}) v(n, state, outcome, reason, safe))
SELECT row, state, outcome, array_to_string(list_filter(list_append(shape, reason), lambda x: x <> ''), ',') AS reasons, safe FROM r JOIN t USING (n)"""
}
