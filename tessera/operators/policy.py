"""References, quality control and activation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import citations as ct
from tessera.sources.tables import TRUSTED, table, trusted

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


CITATION_SQL = lambda c: ct.normalised_sql(c, "citation")


@query(f"""WITH r AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Section ' || p_size || '.' || p_partkey % 100 || '(a)' WHEN 1 THEN 'Rule: ' || ['II', 'X', 'XX', 'L', 'C', 'IIII', 'A'][p_partkey % 7 + 1] || ' - ' || p_size || '.1' WHEN 2 THEN 'Part 2-A - ' || p_size || '.2(b)(1)' WHEN 3 THEN 'IC-' || p_size || ' B' WHEN 4 THEN 'Ordinance 37.' || p_size % 10 || '(c)' ELSE 'sec. 37.8 (d)' END AS raw FROM part),
n AS (SELECT p_partkey, raw, {CITATION_SQL('raw')} AS citation, {ct.normalised_sql('raw', 'bare')} AS bare, {ct.normalised_sql('raw', 'code')} AS code FROM r)
SELECT p_partkey, citation, bare, code, string_split(citation, '(')[1] AS base, CASE WHEN starts_with(citation, 'ordinance37.') AND regexp_replace(regexp_replace(citation, '^ordinance', ''), '\\([a-z0-9]+\\)', '', 'g') IN ('37.1', '37.2', '37.8') THEN regexp_replace(citation, '^ordinance', '') ELSE citation END AS ordinance_key FROM n""")
def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal forms of citations of several shapes."""
    raw = F.expr("CASE p_partkey % 6 WHEN 0 THEN concat('Section ', p_size, '.', p_partkey % 100, '(a)') WHEN 1 THEN concat('Rule: ', element_at(array('II', 'X', 'XX', 'L', 'C', 'IIII', 'A'), CAST(p_partkey % 7 + 1 AS INT)), ' - ', p_size, '.1') WHEN 2 THEN concat('Part 2-A - ', p_size, '.2(b)(1)') WHEN 3 THEN concat('IC-', p_size, ' B') WHEN 4 THEN concat('Ordinance 37.', p_size % 10, '(c)') ELSE 'sec. 37.8 (d)' END")
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size").select("p_partkey", raw.alias("raw"))
    r = F.col("raw")
    return rows.select("p_partkey", ct.citation(r).alias("citation"), ct.bare_citation(r).alias("bare"), ct.index_code(r).alias("code"), ct.base(r).alias("base"), ct.ordinance_key(r).alias("ordinance_key"))


#: A catalogue of citations over the parts: several rows share a citation.
_CATALOGUE = "catalogue AS (SELECT p_partkey, 'Rule ' || p_size % 20 || '.' || p_partkey % 30 || CASE p_partkey % 3 WHEN 0 THEN '(a)' WHEN 1 THEN '(b)' ELSE '' END AS citation, p_size % 20 || '.' || p_partkey % 30 || CASE p_partkey % 3 WHEN 0 THEN '(a)' WHEN 1 THEN '(b)' ELSE '' END AS normalized, p_type AS heading, p_name AS body FROM part)"


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat((F.col("p_size") % 20).cast("string"), F.lit("."), (F.col("p_partkey") % 30).cast("string"), F.when(F.col("p_partkey") % 3 == 0, "(a)").when(F.col("p_partkey") % 3 == 1, "(b)").otherwise(""))
    rows = table(spark, sf_dir, "part", "p_partkey", "p_size", "p_type", "p_name")
    return rows.select("p_partkey", F.concat(F.lit("Rule "), number).alias("citation"), ct.citation(F.concat(F.lit("Rule "), number)).alias("normalized"), F.col("p_type").alias("heading"), F.col("p_name").alias("body"))


@query(f"""WITH {_CATALOGUE}, r AS (SELECT *, row_number() OVER (PARTITION BY normalized ORDER BY length(heading) + length(body) DESC, citation, p_partkey) AS rn, count(*) OVER (PARTITION BY normalized) AS merged FROM catalogue)
SELECT normalized, p_partkey AS canonical, merged, heading FROM r WHERE rn = 1""")
def canonical_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of rows with one normal form, that with most text; ties by citation."""
    rows = catalogue(spark, sf_dir)
    order = F.struct((-(F.length("heading") + F.length("body"))).alias("less"), "citation", "p_partkey")
    found = rows.groupBy("normalized").agg(F.min_by(F.struct("p_partkey", "heading"), order).alias("best"), F.count("*").alias("merged"))
    return found.select("normalized", F.col("best.p_partkey").alias("canonical"), "merged", F.col("best.heading").alias("heading"))


@query(f"""WITH {_CATALOGUE}, d AS (SELECT normalized, min(citation) AS canonical, min(p_partkey) % 7 = 0 AS reserved FROM catalogue GROUP BY normalized),
l AS (SELECT DISTINCT l_orderkey AS document_id, 'rule ' || l_partkey % 25 || '.' || l_suppkey % 30 || '(a)' AS raw FROM lineitem),
j AS (SELECT document_id, raw, {CITATION_SQL('raw')} AS normalized FROM l)
SELECT document_id, raw, j.normalized, canonical, CAST(canonical IS NOT NULL AS INTEGER) AS is_valid, CASE WHEN canonical IS NULL THEN 'error' WHEN reserved THEN 'warning' END AS severity FROM j LEFT JOIN d ON d.normalized = j.normalized""")
def reference_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's references with their canonical form, and an issue where
    none is known or it is reserved."""
    known = catalogue(spark, sf_dir).groupBy("normalized").agg(F.min("citation").alias("canonical"), (F.min("p_partkey") % 7 == 0).alias("reserved"))
    raw = F.concat(F.lit("rule "), (F.col("l_partkey") % 25).cast("string"), F.lit("."), (F.col("l_suppkey") % 30).cast("string"), F.lit("(a)"))
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey").select(F.col("l_orderkey").alias("document_id"), raw.alias("raw")).distinct()
    rows = rows.withColumn("normalized", ct.citation(F.col("raw"))).join(known, "normalized", "left")
    severity = F.when(F.col("canonical").isNull(), "error").when(F.col("reserved"), "warning")
    return rows.select("document_id", "raw", "normalized", "canonical", F.col("canonical").isNotNull().cast("int").alias("is_valid"), severity.alias("severity"))


@query(f"""WITH {_CATALOGUE}, q AS (SELECT s_suppkey, 'Section ' || s_suppkey % 21 || '.' || s_suppkey % 31 || CASE s_suppkey % 2 WHEN 0 THEN '(a)' ELSE '' END AS citation FROM supplier),
n AS (SELECT s_suppkey, {CITATION_SQL('citation')} AS normalized FROM q), k AS (SELECT normalized, string_split(normalized, '(')[1] AS base, count(*) AS n FROM catalogue GROUP BY normalized),
x AS (SELECT s_suppkey, n.normalized, coalesce(e.n, 0) AS exact, (SELECT count(*) FROM k r WHERE r.normalized = string_split(n.normalized, '(')[1] OR starts_with(r.normalized, n.normalized || '(')) AS related FROM n LEFT JOIN k e ON e.normalized = n.normalized)
SELECT s_suppkey, normalized, CASE WHEN exact = 0 THEN 'unresolved' WHEN exact = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN exact > 1 THEN 'multiple_exact' WHEN exact = 1 THEN 'exact_match' WHEN related > 0 THEN 'parent_or_related_only' ELSE 'not_found' END AS diagnostic FROM x""")
def citation_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether citations resolve; related ones are found by their base, so that no
    citation meets the whole catalogue."""
    known = catalogue(spark, sf_dir).groupBy("normalized").agg(F.count("*").alias("n")).withColumn("base", F.substring_index("normalized", "(", 1))
    raw = F.concat(F.lit("Section "), (F.col("s_suppkey") % 21).cast("string"), F.lit("."), (F.col("s_suppkey") % 31).cast("string"), F.when(F.col("s_suppkey") % 2 == 0, "(a)").otherwise(""))
    asked = table(spark, sf_dir, "supplier", "s_suppkey").select("s_suppkey", ct.citation(raw).alias("normalized"), ct.base(raw).alias("base"))
    near = asked.join(known.select("base", F.col("normalized").alias("candidate"), "n"), "base", "left")
    exact = F.coalesce(F.sum(F.when(F.col("candidate") == F.col("normalized"), F.col("n"))), F.lit(0))
    related = F.count_if((F.col("candidate") == F.col("base")) | F.startswith("candidate", F.concat("normalized", F.lit("("))))
    found = near.groupBy("s_suppkey", "normalized").agg(exact.alias("exact"), related.alias("related"))
    status = F.when(F.col("exact") == 0, "unresolved").when(F.col("exact") == 1, "resolved").otherwise("ambiguous")
    why = F.when(F.col("exact") > 1, "multiple_exact").when(F.col("exact") == 1, "exact_match").when(F.col("related") > 0, "parent_or_related_only").otherwise("not_found")
    return found.select("s_suppkey", "normalized", status.alias("status"), why.alias("diagnostic"))


@query("""WITH w AS (SELECT l_orderkey, l_suppkey, round(sum(CASE l_returnflag WHEN 'R' THEN 5 WHEN 'A' THEN 4.5 ELSE CASE WHEN l_discount > 0.05 THEN 3.5 ELSE 3.25 END END), 4) AS weight FROM lineitem GROUP BY l_orderkey, l_suppkey),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY weight DESC, l_suppkey) AS rn, lead(weight) OVER (PARTITION BY l_orderkey ORDER BY weight DESC, l_suppkey) AS second FROM w)
SELECT l_orderkey, l_suppkey AS code, CAST(weight AS DOUBLE) AS weight, CASE WHEN weight < 4.5 THEN 'weak' WHEN second IS NOT NULL AND weight = second THEN 'tie' ELSE 'clear' END AS verdict FROM r WHERE rn = 1""")
def inferred_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's code by weights over a crosswalk: the best, and how clearly."""
    weight = F.when(F.col("l_returnflag") == "R", 5.0).when(F.col("l_returnflag") == "A", 4.5).when(F.col("l_discount") > 0.05, 3.5).otherwise(3.25)
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_discount").groupBy("l_orderkey", "l_suppkey").agg(F.round(F.sum(weight), 4).alias("weight"))
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("weight"), "l_suppkey")
    ranked = rows.select("*", F.row_number().over(w).alias("rn"), F.lead("weight").over(w).alias("second")).where("rn = 1")
    verdict = F.when(F.col("weight") < 4.5, "weak").when(F.col("second").isNotNull() & (F.col("weight") == F.col("second")), "tie").otherwise("clear")
    return ranked.select("l_orderkey", F.col("l_suppkey").alias("code"), "weight", verdict.alias("verdict"))


@query(f"""WITH {_CATALOGUE}, e AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT (SELECT count(*) FROM catalogue) AS entries, (SELECT count(DISTINCT normalized) FROM catalogue) AS distinct_citations, (SELECT count(*) FROM e) AS linked, (SELECT count(*) FROM e JOIN part ON p_partkey = l_partkey) AS resolvable,
(SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM e)) AS unlinked, CASE WHEN (SELECT count(*) FROM e JOIN part ON p_partkey = l_partkey) = (SELECT count(*) FROM e) THEN 'ready' ELSE 'incomplete' END AS recommendation""")
def reference_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of a catalogue by its crosswalk, in two passes."""
    edges = table(spark, sf_dir, "lineitem", "l_partkey").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    both = catalogue(spark, sf_dir).withColumn("known", F.lit(1)).join(edges, "p_partkey", "full")
    found = both.agg(F.count("known").alias("entries"), F.countDistinct("normalized").alias("distinct_citations"), F.count("n").alias("linked"), F.count_if(F.col("known").isNotNull() & F.col("n").isNotNull()).alias("resolvable"), F.count_if(F.col("known").isNotNull() & F.col("n").isNull()).alias("unlinked"))
    return found.withColumn("recommendation", F.when(F.col("resolvable") == F.col("linked"), "ready").otherwise("incomplete"))


# ---- quality control -------------------------------------------------------

#: Thresholds of approval.
MOST_WARNINGS, LEAST_CONFIDENCE, MOST_UNRESOLVED = 4, 0.55, 1


def unresolved_limit(c: dict[str, Column]) -> Column:
    """How many unresolved references an approval bears: 5, 2 or the usual 1."""
    calm = (c["critical"] == 0) & ~c["no_rules"] & ~c["no_ordinance"]
    pilot = c["passed"] & c["confirmed"] & (c["confidence"] >= 0.6) & (c["warnings"] <= 7) & calm
    clean = (c["confidence"] >= 0.72) & (c["warnings"] <= 5) & calm
    return F.when(pilot, 5).when(clean, 2).otherwise(MOST_UNRESOLVED)


def readiness(c: dict[str, Column]) -> tuple[Column, Column]:
    """Blockers of an approval, in order, and its score from 0."""
    checks = {
        "rejected": c["rejected"],
        "already_approved": c["approved"],
        "qc_gate_not_passed": ~c["passed"],
        "metadata_not_confirmed": ~c["confirmed"],
        "critical_reference_exception_present": c["critical"] > 0,
        "unresolved_references_above_threshold": c["unresolved"] > unresolved_limit(c),
        "warnings_above_threshold": c["warnings"] > MOST_WARNINGS,
        "extraction_confidence_below_threshold": c["confidence"] < LEAST_CONFIDENCE,
        "missing_rules_detection": c["no_rules"],
        "missing_ordinance_detection": c["no_ordinance"],
    }
    blockers = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    score = 100 - F.size(blockers) * 15 - F.least(F.lit(30), c["unresolved"] * 5) - F.least(F.lit(20), F.greatest(F.lit(0), c["warnings"] - 2) * 2) + F.round(F.least(F.lit(20.0), c["confidence"] * 20))
    return blockers, F.greatest(F.lit(0), score.cast("bigint"))


_FACTS = """f AS (SELECT o_orderkey, o_orderstatus = 'P' AS rejected, o_orderpriority = '5-LOW' AS approved, o_totalprice > 20000 AS passed, o_custkey % 3 > 0 AS confirmed, l.* EXCLUDE (l_orderkey) FROM orders JOIN
 (SELECT l_orderkey, count(*) AS warnings, count(*) FILTER (WHERE l_returnflag = 'R' AND l_discount > 0.06) AS unresolved, count(*) FILTER (WHERE l_quantity >= 50) AS critical, round(max(l_discount) * 10, 2) AS confidence,
  count(*) FILTER (WHERE l_linestatus = 'O') = 0 AND min(l_quantity) < 3 AS no_rules, max(l_tax) < 0.01 AS no_ordinance FROM lineitem GROUP BY l_orderkey) l ON l_orderkey = o_orderkey)"""
_LIMIT = "CASE WHEN passed AND confirmed AND confidence >= 0.6 AND warnings <= 7 AND critical = 0 AND NOT no_rules AND NOT no_ordinance THEN 5 WHEN confidence >= 0.72 AND warnings <= 5 AND critical = 0 AND NOT no_rules AND NOT no_ordinance THEN 2 ELSE 1 END"
_BLOCKERS = f"""list_filter([CASE WHEN rejected THEN 'rejected' END, CASE WHEN approved THEN 'already_approved' END, CASE WHEN NOT passed THEN 'qc_gate_not_passed' END, CASE WHEN NOT confirmed THEN 'metadata_not_confirmed' END, CASE WHEN critical > 0 THEN 'critical_reference_exception_present' END,
 CASE WHEN unresolved > {_LIMIT} THEN 'unresolved_references_above_threshold' END, CASE WHEN warnings > 4 THEN 'warnings_above_threshold' END, CASE WHEN confidence < 0.55 THEN 'extraction_confidence_below_threshold' END, CASE WHEN no_rules THEN 'missing_rules_detection' END, CASE WHEN no_ordinance THEN 'missing_ordinance_detection' END], lambda x: x IS NOT NULL)"""


def _facts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, Column]]:
    """Orders as documents under review, their lines as what was extracted."""
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_discount", "l_quantity", "l_linestatus", "l_tax")
    counts = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.count("*").alias("warnings"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.06)).alias("unresolved"), F.count_if(F.col("l_quantity") >= 50).alias("critical"), F.round(F.max("l_discount") * 10, 2).alias("confidence"),
        ((F.count_if(F.col("l_linestatus") == "O") == 0) & (F.min("l_quantity") < 3)).alias("no_rules"), (F.max("l_tax") < 0.01).alias("no_ordinance"),
    )
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    rows = orders.join(counts, "o_orderkey").select("o_orderkey", (F.col("o_orderstatus") == "P").alias("rejected"), (F.col("o_orderpriority") == "5-LOW").alias("approved"), (F.col("o_totalprice") > 20000).alias("passed"), (F.col("o_custkey") % 3 > 0).alias("confirmed"), "warnings", "unresolved", "critical", "confidence", "no_rules", "no_ordinance")
    return rows, {c: F.col(c) for c in rows.columns}


@query(f"""WITH {_FACTS}, b AS (SELECT *, {_BLOCKERS} AS blockers FROM f)
SELECT o_orderkey, array_to_string(blockers, ',') AS blockers, len(blockers) = 0 AS eligible, CAST(greatest(0, 100 - len(blockers) * 15 - least(30, unresolved * 5) - least(20, greatest(0, warnings - 2) * 2) + round(least(20, confidence * 20))) AS BIGINT) AS score FROM b""")
def approval_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _facts(spark, sf_dir)
    blockers, score = readiness(c)
    rows = rows.select("o_orderkey", blockers.alias("b"), score.alias("score"))
    return rows.select("o_orderkey", F.array_join("b", ",").alias("blockers"), (F.size("b") == 0).alias("eligible"), "score")


@query(f"""WITH {_FACTS}, b AS (SELECT *, {_BLOCKERS} AS blockers, {_LIMIT} AS lim FROM f),
t AS (SELECT *, critical = 0 AND NOT no_rules AND NOT no_ordinance AND passed AS sound, blockers = ['metadata_not_confirmed'] AS only_metadata, blockers = ['metadata_not_confirmed', 'unresolved_references_above_threshold'] AND unresolved = lim + 1 AS one_fix FROM b)
SELECT o_orderkey, sound AND (only_metadata OR one_fix) AS ready, CASE WHEN sound AND only_metadata THEN 'low' WHEN sound AND one_fix THEN 'medium' ELSE 'high' END AS risk FROM t""")
def reviewer_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that one confirmation, or that and one fix, would release."""
    rows, c = _facts(spark, sf_dir)
    blockers, _ = readiness(c)
    named = F.array_join(blockers, ",")
    sound = (c["critical"] == 0) & ~c["no_rules"] & ~c["no_ordinance"] & c["passed"]
    only = named == "metadata_not_confirmed"
    fix = (named == "metadata_not_confirmed,unresolved_references_above_threshold") & (c["unresolved"] == unresolved_limit(c) + 1)
    return rows.select("o_orderkey", (sound & (only | fix)).alias("ready"), F.when(sound & only, "low").when(sound & fix, "medium").otherwise("high").alias("risk"))


_ISSUES = """i AS (SELECT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'rules_section' WHEN 1 THEN 'ordinance_section' ELSE 'index_code' END AS kind, CASE l_suppkey % 4 WHEN 0 THEN 'ordinance' ELSE '' END || CASE l_partkey % 2 WHEN 0 THEN '37.' ELSE '6.' END || l_suppkey % 12 AS raw,
 CASE l_linestatus WHEN 'O' THEN 'malformed citation' ELSE 'needs manual review' END AS message FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT *, regexp_replace(raw, '^(?:ordinance|rule)', '') AS bare FROM i), d AS (SELECT *, count(*) OVER (PARTITION BY l_orderkey, kind, bare) > 1 AS dup, kind = 'ordinance_section' AND bare IN ('37.3', '37.7', '37.9') AS unsafe,
 kind = 'rules_section' AND starts_with(bare, '37.') OR kind = 'ordinance_section' AND NOT starts_with(bare, '37.') AS crossed, regexp_matches(raw, '^ordinance[0-9]+\\.[0-9]+') OR regexp_matches(message, 'prefix|parenthetical|format|malformed|invalid') AS fixable FROM n)"""


@query(f"""WITH {_ISSUES}, b AS (SELECT l_orderkey, unnest(CASE WHEN unsafe THEN ['unsafe_37x_structural_block'] WHEN crossed THEN ['cross_context_ambiguous'] ELSE list_filter([CASE WHEN dup THEN 'duplicate_or_redundant_reference' END, CASE WHEN fixable THEN 'likely_parenthetical_or_prefix_fix' END, CASE WHEN NOT dup AND NOT fixable THEN 'safe_manual_drop_candidate' END], lambda x: x IS NOT NULL) END) AS bucket FROM d),
g AS (SELECT l_orderkey, list_sort(list(DISTINCT bucket)) AS buckets FROM b GROUP BY l_orderkey), c AS (SELECT l_orderkey, count(*) AS n FROM i GROUP BY l_orderkey)
SELECT l_orderkey, array_to_string(buckets, ',') AS buckets, CASE WHEN list_contains(buckets, 'unsafe_37x_structural_block') OR list_contains(buckets, 'cross_context_ambiguous') THEN 'high' WHEN n <= 2 THEN 'low' ELSE 'medium' END AS effort FROM g JOIN c USING (l_orderkey)""")
def unresolved_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kinds of unresolved references a document has, and the effort."""
    c = F.col
    kind = F.when(c("l_linenumber") % 3 == 0, "rules_section").when(c("l_linenumber") % 3 == 1, "ordinance_section").otherwise("index_code")
    raw = F.concat(F.when(c("l_suppkey") % 4 == 0, "ordinance").otherwise(""), F.when(c("l_partkey") % 2 == 0, "37.").otherwise("6."), (c("l_suppkey") % 12).cast("string"))
    message = F.when(c("l_linestatus") == "O", "malformed citation").otherwise("needs manual review")
    issues = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus", "l_returnflag").where("l_returnflag = 'R'").select("l_orderkey", kind.alias("kind"), raw.alias("raw"), message.alias("message"))
    issues = issues.withColumn("bare", F.regexp_replace("raw", "^(?:ordinance|rule)", ""))
    dup = F.count("*").over(Window.partitionBy("l_orderkey", "kind", "bare")) > 1
    unsafe = (c("kind") == "ordinance_section") & c("bare").isin("37.3", "37.7", "37.9")
    in37 = F.startswith("bare", F.lit("37."))
    crossed = (c("kind") == "rules_section") & in37 | (c("kind") == "ordinance_section") & ~in37
    fixable = F.regexp_like("raw", F.lit(r"^ordinance[0-9]+\.[0-9]+")) | F.regexp_like("message", F.lit("prefix|parenthetical|format|malformed|invalid"))
    rows = issues.select("l_orderkey", dup.alias("dup"), unsafe.alias("unsafe"), crossed.alias("crossed"), fixable.alias("fixable"))
    mild = F.array_compact(F.array(F.when(c("dup"), "duplicate_or_redundant_reference"), F.when(c("fixable"), "likely_parenthetical_or_prefix_fix"), F.when(~c("dup") & ~c("fixable"), "safe_manual_drop_candidate")))
    buckets = F.when(c("unsafe"), F.array(F.lit("unsafe_37x_structural_block"))).when(c("crossed"), F.array(F.lit("cross_context_ambiguous"))).otherwise(mild)
    counts = rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    found = rows.select("l_orderkey", F.explode(buckets).alias("bucket")).groupBy("l_orderkey").agg(F.array_sort(F.collect_set("bucket")).alias("b")).join(counts, "l_orderkey")
    hard = F.array_contains("b", "unsafe_37x_structural_block") | F.array_contains("b", "cross_context_ambiguous")
    return found.select("l_orderkey", F.array_join("b", ",").alias("buckets"), F.when(hard, "high").when(c("n") <= 2, "low").otherwise("medium").alias("effort"))


@query(f"""WITH {_FACTS}, s AS (SELECT o_orderkey, round(greatest(0, least(100, 40 + confidence * 40 - unresolved * 6 - greatest(0, warnings - 3) * 2 + CASE WHEN passed THEN 15 ELSE 0 END)), 2) AS score, rejected, critical FROM f)
SELECT o_orderkey, score, CASE WHEN rejected OR critical > 1 THEN 'exclude' WHEN score >= 70 THEN 'admit' WHEN score >= 45 THEN 'hold' ELSE 'exclude' END AS decision FROM s""")
def corpus_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, c = _facts(spark, sf_dir)
    score = 40 + c["confidence"] * 40 - c["unresolved"] * 6 - F.greatest(F.lit(0), c["warnings"] - 3) * 2 + F.when(c["passed"], 15).otherwise(0)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)), 2)
    decision = F.when(c["rejected"] | (c["critical"] > 1), "exclude").when(F.col("score") >= 70, "admit").when(F.col("score") >= 45, "hold").otherwise("exclude")
    return rows.withColumn("score", score).select("o_orderkey", "score", decision.alias("decision"))


@query(f"""WITH {_CATALOGUE}, {_ISSUES}, k AS (SELECT DISTINCT normalized FROM catalogue), kb AS (SELECT DISTINCT string_split(normalized, '(')[1] AS base FROM catalogue)
SELECT l_orderkey, kind, raw, CASE WHEN dup THEN 'duplicate' WHEN message LIKE '%malformed%' THEN 'malformed' WHEN crossed THEN 'cross_context' WHEN bare IN (SELECT base FROM kb) THEN 'parent_child' ELSE 'not_found' END AS cause, count(*) AS n FROM d GROUP BY ALL""")
def root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why references stay unresolved, by the first cause that holds."""
    c = F.col
    kind = F.when(c("l_linenumber") % 3 == 0, "rules_section").when(c("l_linenumber") % 3 == 1, "ordinance_section").otherwise("index_code")
    raw = F.concat(F.when(c("l_suppkey") % 4 == 0, "ordinance").otherwise(""), F.when(c("l_partkey") % 2 == 0, "37.").otherwise("6."), (c("l_suppkey") % 12).cast("string"))
    issues = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus", "l_returnflag").where("l_returnflag = 'R'").select("l_orderkey", kind.alias("kind"), raw.alias("raw"), (c("l_linestatus") == "O").alias("malformed"))
    issues = issues.withColumn("bare", F.regexp_replace("raw", "^(?:ordinance|rule)", ""))
    issues = issues.withColumn("dup", F.count("*").over(Window.partitionBy("l_orderkey", "kind", "bare")) > 1)
    bases = catalogue(spark, sf_dir).select(F.substring_index("normalized", "(", 1).alias("bare")).distinct().withColumn("known", F.lit(True))
    in37 = F.startswith("bare", F.lit("37."))
    crossed = (c("kind") == "rules_section") & in37 | (c("kind") == "ordinance_section") & ~in37
    cause = F.when(c("dup"), "duplicate").when(c("malformed"), "malformed").when(crossed, "cross_context").when(c("known").isNotNull(), "parent_child").otherwise("not_found")
    return issues.join(bases, "bare", "left").select("l_orderkey", "kind", "raw", cause.alias("cause")).groupBy("l_orderkey", "kind", "raw", "cause").agg(F.count("*").alias("n"))


# ---- activation ------------------------------------------------------------


@query(f"""WITH {TRUSTED}, m AS (SELECT doc_id, doc_id % 13 = 0 AS no_anchor FROM documents WHERE doc_id % 4 <> 1), p AS (SELECT vec_id AS doc_id, len(embedding) AS dims FROM embeddings)
SELECT coalesce(m.doc_id, p.doc_id) AS doc_id, CASE WHEN m.doc_id IS NULL THEN 'not_in_manifest' WHEN p.doc_id IS NULL THEN 'missing_embedding' WHEN t.document_id IS NULL THEN 'untrusted_document' WHEN no_anchor THEN 'provenance_incomplete' END AS reason,
m.doc_id IS NOT NULL AND p.doc_id IS NOT NULL AND t.document_id IS NOT NULL AND NOT coalesce(no_anchor, false) AS activated FROM m FULL JOIN p ON p.doc_id = m.doc_id LEFT JOIN trusted t ON t.document_id = coalesce(m.doc_id, p.doc_id)""")
def activation_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest against payloads: what is activated, and why the rest is not."""
    manifest = table(spark, sf_dir, "documents", "doc_id").where("doc_id % 4 <> 1").select("doc_id", (F.col("doc_id") % 13 == 0).alias("no_anchor"), F.lit(True).alias("listed"))
    payload = table(spark, sf_dir, "embeddings", "vec_id").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("embedded"))
    active = trusted(spark, sf_dir).select(F.col("document_id").alias("doc_id"), F.lit(True).alias("is_trusted"))
    rows = manifest.join(payload, "doc_id", "full").join(active, "doc_id", "left")
    reason = F.when(F.col("listed").isNull(), "not_in_manifest").when(F.col("embedded").isNull(), "missing_embedding").when(F.col("is_trusted").isNull(), "untrusted_document").when(F.col("no_anchor"), "provenance_incomplete")
    return rows.select("doc_id", reason.alias("reason"), reason.isNull().alias("activated"))


@query(f"""WITH {TRUSTED}, b AS (SELECT document_id, document_id % 5 AS batch FROM trusted), a AS (SELECT batch, count(*) AS before, bit_xor(CAST('0x' || md5(document_id::VARCHAR)[1:15] AS BIGINT)) AS checksum FROM b GROUP BY batch)
SELECT batch, before, CASE WHEN batch IN (1, 3) THEN 0 ELSE before END AS after, checksum, batch IN (1, 3) AS rolled_back FROM a""")
def rollback_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches before and after two of them are rolled back; a repeated rollback
    changes nothing.  A batch's checksum, of any order of its ids, is combined
    before it is shuffled."""
    rows = trusted(spark, sf_dir).withColumn("batch", F.col("document_id") % 5)
    digest = F.conv(F.substring(F.md5(F.col("document_id").cast("string")), 1, 15), 16, 10).cast("long")
    found = rows.groupBy("batch").agg(F.count("*").alias("before"), F.bit_xor(digest).alias("checksum"))
    gone = F.col("batch").isin(1, 3)
    return found.select("batch", "before", F.when(gone, F.lit(0)).otherwise(F.col("before")).alias("after"), "checksum", gone.alias("rolled_back"))
