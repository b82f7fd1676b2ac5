"""Rule tables: topics, intents and score adjustments as data.

A topic holds if one pattern of ``any`` and all of ``all`` occur; a rule adds its
delta where its topics hold for query and chunk and its section fits.  Tables are
parameters: the defaults here show their form.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.lexical import fold_sql
from tessera.sources.tables import CHUNKS, chunks, decisions, table


@dataclass(frozen=True)
class Topic:
    name: str
    any: Sequence[str] = ()
    all: Sequence[str] = ()
    words: bool = False

    def holds(self, folded: Column) -> Column:
        """Whether a folded text is on the topic."""
        test = (lambda t: tx.has_word(folded, t)) if self.words else (lambda t: F.contains(folded, F.lit(t)))
        some = reduce(lambda a, b: a | b, [test(t) for t in self.any]) if self.any else F.lit(True)
        every = reduce(lambda a, b: a & b, [test(t) for t in self.all]) if self.all else F.lit(True)
        return some & every

    def sql(self, column: str) -> str:
        test = (lambda t: f"regexp_matches({column}, '{tx.word_pattern(t)}')") if self.words else (lambda t: f"contains({column}, '{t}')")
        some = "(" + " OR ".join(map(test, self.any)) + ")" if self.any else "true"
        return " AND ".join([some, *map(test, self.all)])


@dataclass(frozen=True)
class Rule:
    reason: str
    delta: float
    topic: str
    unless: str | None = None
    sections: Sequence[str] = field(default_factory=tuple)


TOPICS = (Topic("noise", any=("thshon", "ertion")), Topic("repair", any=("onthe", "thention"), all=("th",)), Topic("rent", any=("the", "les"), words=True), Topic("procedure", any=("und", "que"), words=True))
RULES = (
    Rule("noise_in_findings", 0.24, "noise", sections=("Findings of Fact",)),
    Rule("noise_elsewhere", 0.08, "noise", unless="procedure"),
    Rule("repair_context", 0.12, "repair"),
    Rule("rent_in_conclusions", 0.18, "rent", sections=("Conclusions of Law", "Order")),
    Rule("procedural_drift", -0.16, "procedure"),
)
#: Intents by pattern, first match first.
INTENTS = (("citation", r"[0-9]+\.[0-9]+|section"), ("disposition", r"grant|den(y|ied)|outcome"), ("findings", r"finding|fact"), ("analysis", r"why|because|reason"), ("procedural", r"when|hearing|continu"), ("comparative", r"compare|versus"))


def adjustment(folded: Column, section: Column, topics: Sequence[Topic] = TOPICS, rules: Sequence[Rule] = RULES) -> tuple[Column, Column]:
    """The sum of the rules that hold, and their reasons in order."""
    by_name = {t.name: t for t in topics}

    def test(rule: Rule) -> Column:
        found = by_name[rule.topic].holds(folded)
        if rule.unless:
            found &= ~by_name[rule.unless].holds(folded)
        return found & section.isin(*rule.sections) if rule.sections else found

    total = reduce(lambda a, b: a + b, [F.when(test(r), r.delta).otherwise(0.0) for r in rules])
    reasons = F.array_compact(F.array(*[F.when(test(r), F.lit(r.reason)) for r in rules]))
    return F.round(total, 6), reasons


def _rule_sql(rule: Rule) -> str:
    by_name = {t.name: t for t in TOPICS}
    parts = [f"({by_name[rule.topic].sql('f')})"]
    if rule.unless:
        parts.append(f"NOT ({by_name[rule.unless].sql('f')})")
    if rule.sections:
        parts.append("section_label IN (" + ", ".join(f"'{s}'" for s in rule.sections) + ")")
    return " AND ".join(parts)


def intent(text: Column) -> Column:
    lowered = F.lower(text)
    found = F.when(F.regexp_like(lowered, F.lit(INTENTS[0][1])), INTENTS[0][0])
    for name, pattern in INTENTS[1:]:
        found = found.when(F.regexp_like(lowered, F.lit(pattern)), name)
    return found.otherwise("unknown")


def rule_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's adjustment by the rule table."""
    rows = chunks(decisions(spark, sf_dir)).select("chunk_id", "section_label", tx.fold(F.col("chunk_text")).alias("f"))
    delta, reasons = adjustment(F.col("f"), F.col("section_label"))
    return rows.select("chunk_id", delta.alias("delta"), F.array_join(reasons, ",").alias("reasons"))


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intent and topics of queries, for which conversation turns stand."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", "text", tx.fold(F.col("text")).alias("f"))
    topics = F.array_compact(F.array(*[F.when(t.holds(F.col("f")), F.lit(t.name)) for t in TOPICS]))
    return rows.select("conv_id", "turn", intent(F.col("text")).alias("intent"), F.array_join(topics, ",").alias("topics"))


def spelled_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with one misspelling each, corrected, and what they quote."""
    wrong = sorted(tx.CORRECTIONS)
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn").select("conv_id", "turn", F.concat(F.lit("The "), F.element_at(F.array(*map(F.lit, wrong)), (F.col("conv_id") % len(wrong) + 1).cast("int")), F.lit(" of turn "), F.col("turn").cast("string")).alias("q"))
    return rows.select("conv_id", "turn", tx.corrected(F.col("q")).alias("corrected"), tx.quoted_phrase(F.concat(F.lit(' "'), "q", F.lit('" '))).alias("quoted"))


QUERIES = {f.__name__: f for f in (rule_scores, query_intents, spelled_queries)}
_WRONG = sorted(tx.CORRECTIONS)
SQL = {
    "rule_scores": f"""WITH {CHUNKS}, x AS (SELECT chunk_id, section_label, {fold_sql('chunk_text')} AS f FROM chunks)
SELECT chunk_id, round({' + '.join(f'CASE WHEN {_rule_sql(r)} THEN {r.delta}::DOUBLE ELSE 0.0::DOUBLE END' for r in RULES)}, 6) AS delta, array_to_string(list_filter([{', '.join(f"CASE WHEN {_rule_sql(r)} THEN '{r.reason}' END" for r in RULES)}], lambda x: x IS NOT NULL), ',') AS reasons FROM x""",
    "query_intents": f"""WITH x AS (SELECT conv_id, turn, text, {fold_sql('text')} AS f FROM conversations)
SELECT conv_id, turn, CASE {' '.join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in INTENTS)} ELSE 'unknown' END AS intent, array_to_string(list_filter([{', '.join(f"CASE WHEN {t.sql('f')} THEN '{t.name}' END" for t in TOPICS)}], lambda x: x IS NOT NULL), ',') AS topics FROM x""",
    "spelled_queries": f"""WITH x AS (SELECT conv_id, turn, [{', '.join(f"'{w}'" for w in _WRONG)}][conv_id % {len(_WRONG)} + 1] AS w FROM conversations)
SELECT conv_id, turn, 'The ' || CASE w {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in tx.CORRECTIONS.items())} END || ' of turn ' || turn AS corrected, 'The ' || w || ' of turn ' || turn AS quoted FROM x""",
}
