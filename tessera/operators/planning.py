"""From a query to its plan: variants of words, limits, tiers of a rescue ladder,
list options and sorts, all by tables of fixed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators.lexical import fold_sql, substring_match, tokens_sql
from tessera.plans.lineage import settle
from tessera.sources.tables import CHUNKS, PARAGRAPHS, chunks, decisions, paragraphs, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# ---- variants of words -------------------------------------------------------

#: Endings of a word, and the variant they make: characters that go and
#: what is put in their place.
ENDINGS = (
    ("^.{2,}ies$", 3, "y"),
    ("^.{3,}y$", 1, "ies"),
    ("^.{3,}es$", 2, ""),
    ("^.{3,}s$", 1, ""),
    ("[^s]$", 0, "s"),
    ("(^|[^e])s$|(x|z|ch|sh)$", 0, "es"),
)

#: What a phrase is also written like.
SPELLINGS = (("['’]", ""), ("['’]", " "), ("-", " "), (" ", "-"), (" ", ""))

#: Irregular forms of words.
IRREGULAR = {
    "leak": "leaks|leaky|leaking|water intrusion",
    "leaks": "leak|leaky|leaking|leakage|water intrusion",
    "leaky": "leak|leaks|leaking|leakage|water intrusion",
    "leaking": "leak|leaks|leaky|leakage|water intrusion",
    "leakage": "leak|leaks|leaky|leaking|water intrusion",
    "malfunction": "malfunctioning|malfunctioned|broken|not working",
    "malfunctioning": "malfunction|malfunctioned|broken|not working",
    "malfunctioned": "malfunction|malfunctioning|broken|not working",
    "mouse": "mice",
    "mice": "mouse",
    "child": "children|kid|kids",
    "children": "child|kid|kids",
    "kid": "kids|child|children",
    "kids": "kid|child|children",
    "person": "people",
    "people": "person",
    "ant": "ants",
    "ants": "ant",
    "flea": "fleas",
    "fleas": "flea",
    "package": "packages",
    "packages": "package",
    "mailbox": "mailboxes",
    "mailboxes": "mailbox",
    "window": "windows",
    "windows": "window",
    "stair": "stairs",
    "stairs": "stair",
    "supply": "supplies",
    "supplies": "supply",
    "allergy": "allergies",
    "allergies": "allergy",
}

#: Words of a concept, and what stands for it in texts.
CONCEPTS = (
    ("^pipes?$", "pipe|pipes|plumbing|radiator|radiators|boiler|steam heat|heating system"),
    ("^nois(?:e|es|y)$", "noise|noises|noisy|humming|hum|banging|clanging|sound|sounds|vibration|vibrating"),
    ("^(heat|heater|heaters|heating)$", "heat|heater|heaters|heating|boiler|radiator|radiators|steam heat|heating system"),
    ("^boilers?$", "boiler|boilers|heat|heating|heating system|steam heat"),
    ("^radiators?$", "radiator|radiators|heat|heating|heating system|steam heat"),
    ("^malfunction(?:ing|ed)?$", "malfunction|malfunctioning|malfunctioned|broken|not working|not functioning|failed|failure|problem|repair|replace"),
    ("^winter$", "winter|cold|cold weather|minimum room temperature|70 degrees|heat|heating"),
    ("^mold$", "mold|mildew"),
    ("^mildew$", "mildew|mold"),
    ("^leak(?:s|y|ing|age)?$", "leak|leaks|leaky|leaking|leakage|water intrusion|water damage|water"),
    ("^roofs?$", "roof|roofs|ceiling|ceilings|exterior wall|water intrusion"),
    ("^ceilings?$", "ceiling|ceilings|roof|roofs|overhead|water intrusion"),
    ("^bedrooms?$", "bedroom|bedrooms|room|rooms"),
    ("^locks?$|^locking$|^locked$", "lock|locks|locking|locked|latch|deadbolt"),
    ("^doors?$", "door|doors|front door|entry door"),
    ("^electrical$|^electric$", "electrical|electric|outlet|outlets|wiring"),
    ("^outlets?$", "outlet|outlets|electrical outlet|electrical outlets|working electrical outlet|working electrical outlets"),
    ("^working$", "working|not working|non working|non-working|not functioning|properly functioning|good working order"),
    ("^broken$", "broken|not working|non working|non-working|not functioning|malfunctioning|repair|replace"),
    ("^rotten$|^rotted$", "rotten|rotted|rot|dry rot|soft|damaged|deteriorated"),
    ("^floors?$|^flooring$|^boards?$", "floor|floors|flooring|floor boards|floorboards|boards"),
    ("^trash$|^garbage$|^rubbish$|^refuse$", "trash|garbage|rubbish|refuse|waste|debris"),
    ("^chutes?$", "chute|chutes|trash chute|garbage chute|refuse chute"),
    ("^odou?rs?$|^smells?$|^smelly$|^stench$", "odor|odors|odour|odours|smell|smells|smelly|stench|foul odor|offensive odor|noxious odor"),
    ("^sewers?$|^sewage$", "sewer|sewers|sewage|waste line|waste pipe|plumbing"),
    ("^drains?$|^drainage$", "drain|drains|drainage|plumbing|sewer|waste line|waste pipe"),
    ("^clogg(?:ed|ing)?$|^clogs?$|^blocked$|^blockage$", "clog|clogs|clogged|clogging|blocked|blockage|stoppage|obstructed"),
    ("^back(?:ing|ed)?$|^backup$|^backups$|^overflow(?:ed|ing)?$", "backing|backing up|backed up|backup|backups|overflow|overflowed|overflowing|sewage backing up"),
    ("^hallways?$|^halls?$|^corridors?$", "hallway|hallways|hall|halls|corridor|corridors|common area|common areas"),
    ("^bathroom$", "bathroom|bath|shower|toilet|sink"),
    ("^showers?$|^bathtubs?$|^tubs?$", "shower|showers|bathtub|bathtubs|tub|tubs|bath"),
    ("^windows?$", "window|windows|window sash|window latch|window lock|weatherstrip|draft"),
    ("^kitchen$", "kitchen"),
)
#: Tokens of a query that make concept groups, at least and at most.
LEAST_GROUPS, MOST_GROUPS = 2, 6


def _list(values: str) -> Column:
    return F.array(*map(F.lit, values.split("|")))


def surface_variants(token: Column) -> Column:
    """A folded word, its irregular forms and its plural or singular."""
    known = F.create_map(*[x for word, forms in IRREGULAR.items() for x in (F.lit(word), _list(forms))])
    made = [F.when(F.regexp_like(token, F.lit(p)), F.concat(F.substring(token, F.lit(1), F.length(token) - cut), F.lit(put))) for p, cut, put in ENDINGS]
    return F.array_distinct(F.concat(F.array(token), F.coalesce(known[token], F.array().cast("array<string>")), F.array_compact(F.array(*made))))


def concept_variants(token: Column) -> Column:
    """The same with what stands for its concepts."""
    none = F.array().cast("array<string>")
    found = [F.when(F.regexp_like(token, F.lit(p)), _list(values)).otherwise(none) for p, values in CONCEPTS]
    return F.array_distinct(F.concat(surface_variants(token), *found))


def phrase_variants(folded: Column) -> Column:
    """A folded phrase with and without apostrophes, hyphens and spaces."""
    return F.array_distinct(F.array(folded, *[tx.squeeze(F.regexp_replace(folded, a, b)) for a, b in SPELLINGS]))


def concept_groups(tokens: Column) -> Column:
    """A group of variants for each token of a query; of many tokens, the longest
    ones, in the query's order.  None for a single token."""
    placed = F.transform(tokens, lambda t, i: F.struct((-F.length(t)).alias("less"), i.alias("place"), t.alias("token")))
    best = F.array_sort(F.transform(F.slice(F.array_sort(placed), 1, MOST_GROUPS), lambda x: F.struct(x["place"], x["token"])))
    groups = F.transform(best, lambda x: concept_variants(x["token"]))
    return F.when(F.size(tokens) >= LEAST_GROUPS, groups).otherwise(F.array().cast("array<array<string>>"))


#: Words of the queries that stand for a user's; a query has one of each row.
_ASKED = ("leak noisy mold mouse", "bedroom hallways kitchen", "pipes heater windows doors", "broken rotten working", "winter sewage odors", "allergies supplies packages", "box dish tenant's")


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn")
    pick = lambda i, words: F.element_at(_list(words.replace(" ", "|")), ((F.col("conv_id") + i * F.col("turn")) % len(words.split()) + 1).cast("int"))
    words = F.array(*[pick(i, words) for i, words in enumerate(_ASKED)])
    return rows.select("conv_id", "turn", F.slice(words, F.lit(1), (F.col("conv_id") % len(_ASKED) + 1).cast("int")).alias("tokens"))


_ASKED_SQL = "asked AS (SELECT conv_id, turn, [" + ", ".join(f"['{"', '".join(w.replace("'", "''") for w in words.split())}'][(conv_id + {i} * turn) % {len(words.split())} + 1]" for i, words in enumerate(_ASKED)) + f"][1:conv_id % {len(_ASKED)} + 1] AS tokens FROM conversations)"
_SURFACE_SQL = "list_concat([t], coalesce(CASE t " + " ".join(f"WHEN {_text(w)} THEN [{', '.join(map(_text, f.split('|')))}]" for w, f in IRREGULAR.items()) + " END, []), " + "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(t, {_text(p)}) THEN t[1:length(t) - {cut}] || '{put}' END" for p, cut, put in ENDINGS) + "], lambda x: x IS NOT NULL))"
_CONCEPT_SQL = f"flatten([{_SURFACE_SQL}, " + ", ".join(f"CASE WHEN regexp_matches(t, {_text(p)}) THEN [{', '.join(map(_text, v.split('|')))}] ELSE [] END" for p, v in CONCEPTS) + "])"


@query(f"""WITH {_ASKED_SQL}, p AS (SELECT conv_id, turn, tokens, unnest(tokens) AS t, generate_subscripts(tokens, 1) AS place FROM asked WHERE len(tokens) >= {LEAST_GROUPS}),
b AS (SELECT conv_id, turn, place, array_to_string(list_sort(list_distinct({_CONCEPT_SQL})), '|') AS g FROM p QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY length(t) DESC, place) <= {MOST_GROUPS})
SELECT a.conv_id, a.turn, count(g) AS n_groups, coalesce(string_agg(g, ';' ORDER BY place), '') AS groups FROM asked a LEFT JOIN b ON a.conv_id = b.conv_id AND a.turn = b.turn GROUP BY a.conv_id, a.turn""")
def query_concept_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of variants that queries ask for."""
    rows = _asked(spark, sf_dir).select("conv_id", "turn", concept_groups(F.col("tokens")).alias("g"))
    return rows.select("conv_id", "turn", F.size("g").cast("bigint").alias("n_groups"), F.array_join(F.transform("g", lambda v: F.array_join(F.array_sort(v), "|")), ";").alias("groups"))


@query(f"""WITH {_ASKED_SQL}, q AS (SELECT conv_id, turn, tokens[1] AS t, array_to_string(tokens, ' ') AS p FROM asked)
SELECT conv_id, turn, array_to_string(list_sort(list_distinct([p, {', '.join(f"trim(regexp_replace(regexp_replace(p, {_text(a)}, {_text(b)}, 'g'), ' +', ' ', 'g'))" for a, b in SPELLINGS)}])), '|') AS phrases, array_to_string(list_sort(list_distinct({_SURFACE_SQL})), '|') AS words FROM q""")
def query_surface_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How queries, and their first words, are also written."""
    rows = _asked(spark, sf_dir).select("conv_id", "turn", F.array_join("tokens", " ").alias("p"), F.get("tokens", F.lit(0)).alias("t"))
    joined = lambda c: F.array_join(F.array_sort(c), "|")
    return rows.select("conv_id", "turn", joined(phrase_variants(F.col("p"))).alias("phrases"), joined(surface_variants(F.col("t"))).alias("words"))


# ---- limits ------------------------------------------------------------------

#: For a class of queries and the kinds of filters that it has (2 for
#: more), limits as (most, times the page's window, least).
LIMITS = {
    ("short", 0): {"lexical": (80, 4, 0), "vector": (30, 1, 10), "decision": (12, 1, 10), "fallback": (0, 0, 0), "scope": (0, 0, 0), "phrase": (360, 6, 120)},
    ("short", 1): {"lexical": (48, 2, 0), "vector": (30, 1, 10), "decision": (10, 1, 8), "fallback": (0, 0, 0), "scope": (12, 1, 8), "phrase": (360, 6, 120)},
    ("short", 2): {"lexical": (48, 2, 0), "vector": (30, 1, 10), "decision": (10, 1, 8), "fallback": (0, 0, 0), "scope": (12, 1, 8), "phrase": (360, 6, 120)},
    ("sentence", 0): {"lexical": (96, 4, 0), "vector": (120, 1, 50), "decision": (14, 1, 12), "fallback": (0, 0, 0), "scope": (18, 2, 0), "phrase": (360, 8, 160)},
    ("sentence", 1): {"lexical": (72, 3, 0), "vector": (120, 1, 50), "decision": (12, 1, 10), "fallback": (0, 0, 0), "scope": (16, 2, 0), "phrase": (360, 8, 160)},
    ("sentence", 2): {"lexical": (72, 3, 0), "vector": (120, 2, 50), "decision": (12, 1, 10), "fallback": (0, 0, 0), "scope": (16, 2, 0), "phrase": (360, 8, 160)},
    ("plain", 0): {"lexical": (2400, 12, 0), "vector": (120, 1, 50), "decision": (160, 4, 12), "fallback": (0, 0, 0), "scope": (96, 10, 0), "phrase": (360, 10, 240)},
    ("plain", 1): {"lexical": (2400, 15, 0), "vector": (120, 1, 50), "decision": (160, 5, 16), "fallback": (140, 6, 24), "scope": (96, 10, 0), "phrase": (360, 10, 240)},
    ("plain", 2): {"lexical": (2400, 20, 0), "vector": (120, 2, 50), "decision": (160, 8, 24), "fallback": (140, 10, 40), "scope": (96, 10, 0), "phrase": (360, 10, 240)},
}


def limits(kind: Column, filters: Column, window: Column, one_document: Column) -> dict[str, Column]:
    """How many rows each part of a search may take.  A scope of documents is no
    smaller than what decisions or fallbacks take, up to its own most, but for short
    queries; a search in one document has that scope."""
    of = lambda name, i: reduce(lambda c, key: c.when((kind == key[0]) & (F.least(filters, F.lit(2)) == key[1]), LIMITS[key][name][i]), LIMITS, F.when(F.lit(False), 0))
    plain = {name: F.least(of(name, 0), F.greatest(of(name, 1) * window, of(name, 2))) for name in ("lexical", "vector", "decision", "fallback", "scope", "phrase")}
    wide = F.least(of("scope", 0), F.greatest(of("scope", 1) * window, plain["decision"], plain["fallback"]))
    return {
        "lexical": plain["lexical"],
        "vector": plain["vector"],
        "decision": F.when(one_document, 1).otherwise(plain["decision"]),
        "fallback": F.when(one_document, 0).otherwise(plain["fallback"]),
        "scope": F.when(one_document, 1).when(kind == "short", plain["scope"]).otherwise(wide),
        "phrase": F.greatest(plain["lexical"], plain["phrase"]),
    }


_VALUES = ", ".join(f"('{kind}', {n}, '{name}', {', '.join(map(str, values))})" for (kind, n), named in LIMITS.items() for name, values in named.items())


@query(f"""WITH l(kind, filters, name, most, times, least) AS (VALUES {_VALUES}), q AS (SELECT conv_id, turn, ['short', 'sentence', 'plain'][conv_id % 3 + 1] AS kind, CAST(turn % 4 AS INTEGER) AS filters, 5 * (conv_id % 7 + 1) AS w, conv_id % 11 = 0 AS one FROM conversations),
x AS (SELECT conv_id, turn, q.kind, one, w, name, most, times, least(most, greatest(times * w, least)) AS v FROM q JOIN l ON l.kind = q.kind AND l.filters = least(q.filters, 2)),
y AS (SELECT conv_id, turn, min(kind) AS kind, bool_or(one) AS one, max(v) FILTER (name = 'lexical') AS lexical, max(v) FILTER (name = 'vector') AS vector, max(v) FILTER (name = 'decision') AS d, max(v) FILTER (name = 'fallback') AS f, max(v) FILTER (name = 'scope') AS s, max(v) FILTER (name = 'phrase') AS p, max(most) FILTER (name = 'scope') AS sm, max(times * w) FILTER (name = 'scope') AS st FROM x GROUP BY conv_id, turn)
SELECT conv_id, turn, CAST(lexical AS BIGINT) AS lexical, CAST(vector AS BIGINT) AS vector, CAST(CASE WHEN one THEN 1 ELSE d END AS BIGINT) AS decision, CAST(CASE WHEN one THEN 0 ELSE f END AS BIGINT) AS fallback, CAST(CASE WHEN one THEN 1 WHEN kind = 'short' THEN s ELSE least(sm, greatest(st, d, f)) END AS BIGINT) AS scope, CAST(greatest(lexical, p) AS BIGINT) AS phrase FROM y""")
def adaptive_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limits of queries of several classes, filters and page windows."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn")
    kind = F.element_at(F.array(*map(F.lit, ("short", "sentence", "plain"))), (F.col("conv_id") % 3 + 1).cast("int"))
    found = limits(kind, F.col("turn") % 4, 5 * (F.col("conv_id") % 7 + 1), F.col("conv_id") % 11 == 0)
    return rows.select("conv_id", "turn", *[c.cast("bigint").alias(n) for n, c in found.items()])


# ---- tests on rows -----------------------------------------------------------

#: Without evidence, a row goes below these lexical scores, with and
#: without any vector match, if its similarity is below the last.
KILL, KILL_ALONE, SAVED = 0.7, 0.35, 0.72


def killed(evidence: Column, lexical: Column, similarity: Column, any_vector: Column) -> Column:
    """Whether a row without strong evidence for the issue goes."""
    return ~evidence & (lexical < F.when(any_vector, KILL).otherwise(KILL_ALONE)) & (similarity < SAVED)


@query(f"""WITH s AS (SELECT d.doc_id, contains(lower(text), 'thention') AS evidence, least(1.2::DOUBLE, len(regexp_extract_all(lower(text), 'ertion')) / 10.0::DOUBLE) AS lexical, CASE WHEN d.doc_id % 2 = 0 THEN 0.0::DOUBLE ELSE coalesce(label, 0) % 10 / 10.0::DOUBLE END AS similarity, d.doc_id % 2 AS q FROM documents d LEFT JOIN embeddings ON vec_id = d.doc_id)
SELECT doc_id, NOT evidence AND lexical < CASE WHEN q = 1 THEN {KILL}::DOUBLE ELSE {KILL_ALONE}::DOUBLE END AND similarity < {SAVED}::DOUBLE AS killed FROM s""")
def evidence_bar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of two queries, one without vectors, against the bar."""
    labels = table(spark, sf_dir, "embeddings", "vec_id", "label").select(F.col("vec_id").alias("doc_id"), "label")
    rows = table(spark, sf_dir, "documents", "doc_id", "text").join(labels, "doc_id", "left")
    t, with_vectors = F.lower("text"), F.col("doc_id") % 2 == 1
    lexical = F.least(F.lit(1.2), F.regexp_count(t, F.lit("ertion")) / 10.0)
    similarity = F.when(with_vectors, F.coalesce("label", F.lit(0)) % 10 / 10.0).otherwise(0.0)
    return rows.select("doc_id", killed(F.contains(t, F.lit("thention")), lexical, similarity, with_vectors).alias("killed"))


#: Boosts by the span of a sentence's facts, in characters.
FACT_SPANS = ((180, 0.12), (320, 0.08), (520, 0.04))


def fact_metrics(folded: Column, facts: list[str]) -> dict[str, Column]:
    """How many of a sentence's facts a text has, the ratio, and a boost for a small
    span between the first places of the first and the last."""
    places = F.filter(F.array(*[F.instr(folded, f) - 1 for f in facts]), lambda p: p >= 0)
    span = F.array_max(places) - F.array_min(places)
    boost = reduce(lambda c, x: c.when(span <= x[0], x[1]), FACT_SPANS, F.when(F.size(places) < 2, 0.0)).otherwise(0.0)
    return {"matched": F.size(places), "coverage": F.round(F.size(places) / len(facts), 4), "proximity": boost}


_FACTS = ("ertion", "thention", "onthe", "ment")


@query(f"""WITH {PARAGRAPHS}, f AS (SELECT id, paragraph_order, list_filter([{', '.join(f"instr({fold_sql('paragraph_text')}, '{f}') - 1" for f in _FACTS)}], lambda p: p >= 0) AS p FROM paragraphs)
SELECT id, paragraph_order, CAST(len(p) AS INTEGER) AS matched, round(len(p) / {len(_FACTS)}.0::DOUBLE, 4) AS coverage, CASE WHEN len(p) < 2 THEN 0.0::DOUBLE {' '.join(f"WHEN list_max(p) - list_min(p) <= {s} THEN {b}::DOUBLE" for s, b in FACT_SPANS)} ELSE 0.0::DOUBLE END AS proximity FROM f WHERE len(p) > 0""")
def fact_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The facts of one sentence in all paragraphs that have any."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", tx.fold(F.col("paragraph_text")).alias("f"))
    found = fact_metrics(F.col("f"), list(_FACTS))
    return rows.select("id", "paragraph_order", *[c.alias(n) for n, c in found.items()]).where("matched > 0")


# ---- headings ----------------------------------------------------------------

#: Headings that a paragraph may run into, and captions that are none.
EMBEDDED = ("FINDINGS OF FACT", "CONCLUSIONS OF LAW", "ORDER", "DECISION", "BACKGROUND", "DISCUSSION", "ANALYSIS", "RULES", "ORDINANCE", "INDEX CODES")
CAPTIONS = (
    r"(?i)^city and county of ",
    r"(?i)^case no\.?",
    r"(?i)^(tenant|landlord)\s+(petitioner|respondent|appellant|appellee)[,.]?$",
    r"(?i)^in re\b",
    r"(?i)^from [a-z0-9]",
    r"(?i)^[a-z0-9 .,'&/-]+\s+llc[,.]?$",
    r"(?i)^[a-z0-9 .,'&/-]+\s+inc[,.]?$",
    r"(?i)^[a-z0-9 .,'&/-]+\s+corporation[,.]?$",
    r"(?i)^[a-z0-9 .,'&/-]+\s+management[,.]?$",
    r"(?i)^([A-Z][A-Z0-9.'#&/,-]*\s+){1,6}(LLC|INC|L\.?P\.?|LP|LTD|CORP\.?|CORPORATION)[,.]?$",
    r"(?i)^[A-Z][A-Z0-9.'#&/,-]*(\s+[A-Z][A-Z0-9.'#&/,-]*)*\s*\(#?\d{1,6}\)\s*,?$",
)


def embedded_parts(paragraph: Column) -> Column:
    """A paragraph's parts between the headings that it runs into, headings too."""
    apart = reduce(lambda c, h: F.regexp_replace(c, rf"\s*{h}\s*", f"\n\n{h}\n\n"), EMBEDDED, paragraph)
    return F.filter(F.transform(F.split(apart, "\n{2,}"), lambda p: F.trim(F.regexp_replace(p, r"[ \t]+", " "))), lambda p: p != "")


def _steady(pattern: str) -> str:
    """A caption's pattern with its loop over words possessive: Java recurses for each turn
    of another loop, and a line of some thousand words overflows the executor's stack.  A
    word holds no space and no bracket, so nothing that such a loop took is ever given back."""
    word = r"\s+[A-Z][A-Z0-9.'#&/,-]*"
    return pattern.replace(f"({word})*", f"(?:{word}+)*+")


def caption_noise(line: Column) -> Column:
    """Whether a line that looks like a heading belongs to a case's caption."""
    clean = tx.squeeze(F.regexp_replace(F.regexp_replace(line, r"^#+\s*", ""), ":$", ""))
    return reduce(lambda a, p: a | F.regexp_like(clean, F.lit(_steady(p))), CAPTIONS, F.lit(False)) & (clean != "")


_RUN_IN = "concat(paragraph_text, ' ', CASE CAST(id % 5 AS INTEGER) WHEN 0 THEN 'FINDINGS OF FACT' WHEN 1 THEN 'The ORDER' WHEN 2 THEN 'RULES ANALYSIS' ELSE 'none' END, ' ', paragraph_text)"
_LINE = "CASE CAST(paragraph_order % 6 AS INTEGER) WHEN 0 THEN concat('Case No. T', id, ':') WHEN 1 THEN 'Acme Holdings LLC,' WHEN 2 THEN concat('# Smith Jones (#', id % 1000, ')') WHEN 3 THEN 'In re the matter' WHEN 4 THEN 'Tenant Petitioner' ELSE paragraph_text END"
_APART = reduce(lambda c, h: rf"regexp_replace({c}, '\s*{h}\s*', chr(10) || chr(10) || '{h}' || chr(10) || chr(10), 'g')", EMBEDDED, "r")


@query(f"""WITH {PARAGRAPHS}, r AS (SELECT id, paragraph_order, {_RUN_IN} AS r, {_LINE} AS line FROM paragraphs),
p AS (SELECT id, paragraph_order, list_filter(list_transform(string_split_regex({_APART}, '\\n{{2,}}'), lambda p: trim(regexp_replace(p, '[ \\t]+', ' ', 'g'))), lambda p: p <> '') AS p, trim(regexp_replace(regexp_replace(regexp_replace(line, '^#+\\s*', ''), ':$', ''), '[\\s\\x{{00A0}}]+', ' ', 'g')) AS c FROM r)
SELECT id, paragraph_order, CAST(len(p) AS INTEGER) AS n_parts, md5(array_to_string(p, chr(10))) AS digest, c <> '' AND ({' OR '.join(f"regexp_matches(c, {_text(x)})" for x in CAPTIONS)}) AS is_caption FROM p""")
def embedded_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs that run into headings, apart again; and lines of captions."""
    rows = paragraphs(decisions(spark, sf_dir)).select("id", "paragraph_order", embedded_parts(F.expr(_RUN_IN)).alias("p"), caption_noise(F.expr(_LINE)).alias("is_caption"))
    return rows.select("id", "paragraph_order", F.size("p").alias("n_parts"), F.md5(F.array_join("p", "\n")).alias("digest"), "is_caption")


# ---- titles ------------------------------------------------------------------


def title_difference(given: Column, canonical: Column) -> Column:
    """How a title differs from the canonical one, by the least that explains it."""
    plain = tx.squeeze
    bare = lambda t: F.lower(plain(F.regexp_replace(t, r"[^A-Za-z0-9\s]", "")))
    same = plain(given) == plain(canonical)
    ends = (given != F.trim(given)) | (canonical != F.trim(canonical))
    return (
        F.when(given == canonical, "exact_match").when(same & ends, "trailing_whitespace").when(same, "duplicate_spacing")
        .when(F.lower(plain(given)) == F.lower(plain(canonical)), "case_only_difference").when(bare(given) == bare(canonical), "punctuation_only_difference").otherwise("true_semantic_mismatch")
    )


_GIVEN = "CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN p_name WHEN 1 THEN concat(p_name, ' ') WHEN 2 THEN replace(p_name, ' ', '  ') WHEN 3 THEN upper(p_name) WHEN 4 THEN concat(p_name, '.') ELSE concat('Other ', p_name) END"
_PLAIN = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_BARE = "lower(trim(regexp_replace(regexp_replace({}, '[^A-Za-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')))"


@query(f"""WITH t AS (SELECT p_partkey, p_name AS c, {_GIVEN} AS g FROM part)
SELECT p_partkey, CASE WHEN g = c THEN 'exact_match' WHEN {_PLAIN.format('g')} = {_PLAIN.format('c')} AND (g <> trim(g) OR c <> trim(c)) THEN 'trailing_whitespace' WHEN {_PLAIN.format('g')} = {_PLAIN.format('c')} THEN 'duplicate_spacing'
  WHEN lower({_PLAIN.format('g')}) = lower({_PLAIN.format('c')}) THEN 'case_only_difference' WHEN {_BARE.format('g')} = {_BARE.format('c')} THEN 'punctuation_only_difference' ELSE 'true_semantic_mismatch' END AS reason FROM t""")
def title_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles given for parts against their names."""
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", title_difference(F.expr(_GIVEN), F.col("p_name")).alias("reason"))


# ---- lists -------------------------------------------------------------------

#: The sorts of a list, as columns, with - for descending ones.
SORTS = {
    "createdAtDesc": "-created",
    "createdAtAsc": "created",
    "confidenceDesc": "-confidence -created",
    "confidenceAsc": "confidence -created",
    "titleAsc": "title -created",
    "titleDesc": "-title -created",
    "warningCountDesc": "-warnings -unresolved -created",
    "unresolvedReferenceDesc": "-unresolved -warnings -created",
    "criticalExceptionDesc": "-critical -warnings -created",
    "approvalReadinessDesc": "-approval -created",
    "reviewerReadinessDesc": "-reviewer -approval -created",
    "reviewerEffortAsc": "unresolved -approval -created",
    "batchabilityDesc": "-unresolved -approval -created",
    "unresolvedLeverageDesc": "unresolved -approval -created",
    "blocked37xBatchKeyAsc": "-unsafe -unresolved -created",
}
#: Conditions of a list's options on its rows; those on status exclude each other.
OPTIONS = {
    "staged": "searchable IS NULL",
    "searchable": "searchable IS NOT NULL",
    "approved": "approved IS NOT NULL",
    "rejected": "rejected IS NOT NULL",
    "pending": "approved IS NULL AND rejected IS NULL",
    "fileType": "file_type = 'decision_docx'",
    "hasWarnings": "warnings > 0",
    "missingRequired": "file_type = 'decision_docx' AND NOT (has_codes AND has_rules AND has_ordinance)",
    "missingRulesOnly": "file_type = 'decision_docx' AND NOT has_rules",
    "missingOrdinanceOnly": "file_type = 'decision_docx' AND NOT has_ordinance",
    "unresolvedReferencesOnly": "unresolved > 0",
    "criticalExceptionsOnly": "critical > 0",
    "filteredNoiseOnly": "warning LIKE '%Extraction noise filtered%'",
    "lowConfidenceTaxonomyOnly": "(taxonomy = 'general' OR confidence < 0.45)",
    "realOnly": "title NOT LIKE '%harness%' AND title NOT LIKE '%fixture%'",
    "taxonomyCaseTypeId": "taxonomy = 'noise'",
    "query": "(title LIKE '%12%' OR citation LIKE '%12%')",
}
#: Rows of a list without a limit of its own.
LISTED = 200

_LISTED = """SELECT o_orderkey AS id, o_orderdate AS created, o_orderpriority AS title, concat('c-', o_custkey) AS citation, CASE WHEN o_orderkey % 3 = 0 THEN 'decision_docx' ELSE 'decision_md' END AS file_type,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS searchable, CASE WHEN o_orderkey % 7 = 0 THEN o_orderdate END AS approved, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate END AS rejected,
  CAST(o_custkey % 4 AS INTEGER) AS warnings, CASE WHEN o_custkey % 5 = 0 THEN '["Extraction noise filtered: 3"]' ELSE '[]' END AS warning, o_custkey % 2 = 0 AS has_codes, o_custkey % 3 = 0 AS has_rules, o_custkey % 5 <> 0 AS has_ordinance,
  CASE WHEN o_orderkey % 13 = 0 THEN 'general' WHEN o_orderkey % 2 = 0 THEN 'noise' ELSE 'repair' END AS taxonomy, (o_orderkey % 100) / 100.0 AS confidence, CAST(o_orderkey % 97 AS INTEGER) AS approval, CAST(o_custkey % 89 AS INTEGER) AS reviewer, {counts}
FROM {orders} LEFT JOIN {lines} ON l_orderkey = o_orderkey"""
_COUNTS = "CAST(coalesce(r, 0) AS BIGINT) AS unresolved, CAST(coalesce(a, 0) AS BIGINT) AS critical, CAST(coalesce(n, 0) AS BIGINT) AS unsafe"
_LINES = "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS n FROM {} GROUP BY l_orderkey"
_LISTED_SQL = "listed AS (" + _LISTED.format(counts=_COUNTS, orders="orders", lines="lines") + ")"


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the rows of a reviewers' list, their lines counted first."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag")
    return spark.sql(_LISTED.format(counts=_COUNTS, orders="{orders}", lines="{lines}"), orders=orders, lines=spark.sql(_LINES.format("{lines}"), lines=lines))


def sort_of(name: str) -> list[Column]:
    """The sort of that name, then the id."""
    return [*[F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in SORTS.get(name, SORTS["createdAtDesc"]).split()], F.asc("id")]


def _order_sql(name: str) -> str:
    return ", ".join([f"{c[1:]} DESC" if c[0] == "-" else c for c in SORTS[name].split()] + ["id"])


@query(f"WITH lines AS ({_LINES.format('lineitem')}), {_LISTED_SQL} " + " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, CAST(row_number() OVER (ORDER BY {_order_sql(name)}) AS INTEGER) AS place, id FROM listed) WHERE place <= 10" for name in SORTS))
def list_sorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten rows of the list by each of its sorts."""
    rows = settle(listed(spark, sf_dir))
    # ten rows each are numbered
    place = lambda name: F.row_number().over(Window.orderBy(*sort_of(name))).alias("place")
    return reduce(DataFrame.unionAll, [rows.orderBy(*sort_of(name)).limit(10).select(F.lit(name).alias("sort"), place(name), "id") for name in SORTS])


@query(f"WITH lines AS ({_LINES.format('lineitem')}), {_LISTED_SQL} " + " UNION ALL ".join(f"SELECT '{name}' AS option, count(*) AS n, CAST(coalesce(sum(id), 0) AS BIGINT) AS ids FROM listed WHERE {condition}" for name, condition in OPTIONS.items()))
def list_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each option of the list leaves, all in one aggregate."""
    rows = listed(spark, sf_dir)
    found = [F.struct(F.lit(name).alias("option"), F.count_if(F.expr(condition)).alias("n"), F.coalesce(F.sum(F.when(F.expr(condition), F.col("id"))), F.lit(0)).cast("bigint").alias("ids")) for name, condition in OPTIONS.items()]
    return rows.agg(F.array(*found).alias("all")).select(F.inline("all"))


# ---- the rescue ladder -------------------------------------------------------

#: Queries of the ladder: groups of variants for a phrase, and terms.
_LADDER = {
    "phrase": ((("the", "les"), ("and", "und")), ("ertion",)),
    "terms": ((("zzqx",), ("the",)), ("thention", "thshon")),
    "scan": ((("zzqx",), ("the",)), ("zzqy",)),
    "nothing": ((("zzqx",), ("zzqy",)), ("zzqz",)),
}
#: The substring that the third tier looks for, and documents of the last tier.
_SCANNED = {"phrase": "ertion", "terms": "thention", "scan": "onth", "nothing": "zzqz"}
RECOVERED = 6


def _tiers(name: str) -> Column:
    """The best tier in which a chunk answers a query: 1 all groups, 2 a token that
    begins with a term, 3 a substring of the texts; null if none."""
    groups, terms = _LADDER[name]
    every = reduce(lambda a, b: a & b, [F.arrays_overlap("words", F.array(*map(F.lit, g))) for g in groups])
    begins = lambda t: lambda w: F.startswith(w, F.lit(t))
    some = reduce(lambda a, b: a | b, [F.exists("words", begins(t)) for t in terms])
    return F.when(every, 1).when(some, 2).when(substring_match((_SCANNED[name],)), 3)


def _tiers_sql(name: str) -> str:
    groups, terms = _LADDER[name]
    every = " AND ".join(f"list_has_any(w, [{', '.join(map(_text, g))}])" for g in groups)
    some = " OR ".join(f"len(list_filter(w, lambda x: starts_with(x, '{t}'))) > 0" for t in terms)
    scan = " OR ".join(f"contains(lower(coalesce({c}, '')), '{_SCANNED[name]}')" for c in ("chunk_text", "citation", "title", "author"))
    return f"CASE WHEN {every} THEN 1 WHEN {some} THEN 2 WHEN {scan} THEN 3 END"


@query(f"""WITH {CHUNKS}, w AS (SELECT *, {tokens_sql("section_label || ' ' || chunk_text")} AS w FROM chunks), t AS ({' UNION ALL '.join(f"SELECT '{n}' AS query, document_id, {_tiers_sql(n)} AS tier FROM w" for n in _LADDER)}),
d AS (SELECT query, document_id, min(tier) AS tier, count(*) AS n FROM t WHERE tier IS NOT NULL GROUP BY query, document_id, tier), b AS (SELECT query, min(tier) AS tier FROM d GROUP BY query),
s AS (SELECT document_id FROM (SELECT DISTINCT document_id FROM chunks) ORDER BY document_id LIMIT {RECOVERED}), r AS (SELECT q.query, s.document_id, 4 AS tier FROM (VALUES {', '.join(f"('{n}')" for n in _LADDER)}) q(query), s WHERE q.query NOT IN (SELECT query FROM b))
SELECT d.query, CAST(d.tier AS INTEGER) AS tier, d.document_id, d.n FROM d JOIN b ON b.query = d.query AND b.tier = d.tier UNION ALL SELECT query, CAST(tier AS INTEGER), document_id, (SELECT count(*) FROM chunks c WHERE c.document_id = r.document_id) FROM r""")
def rescue_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries that find nothing by vectors: the documents of the first tier that
    answers - a conjunction, any term, a scan - and else the first documents of the
    scope.  One scan serves all tiers and queries."""
    docs = decisions(spark, sf_dir)
    rows = chunks(docs).withColumn("words", tx.tokens(F.concat_ws(" ", "section_label", "chunk_text")))
    each = F.array(*[F.struct(F.lit(n).alias("query"), _tiers(n).alias("tier")) for n in _LADDER])
    hits = rows.select("document_id", F.inline(each)).where("tier IS NOT NULL").groupBy("query", "tier", "document_id").agg(F.count("*").alias("n"))
    hits = settle(hits, narrow=True)
    best = hits.groupBy("query").agg(F.min("tier").alias("tier"))
    found = hits.join(F.broadcast(best), ["query", "tier"]).select("query", "tier", "document_id", "n")
    asked = spark.createDataFrame([(n,) for n in _LADDER], "query string")
    scope = docs.where(F.exists(F.split("text", "\n"), lambda x: F.trim(x) != "")).select(F.col("id").alias("document_id"), F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("bigint").alias("n")).orderBy("document_id").limit(RECOVERED)
    rest = asked.join(best, "query", "left_anti").crossJoin(F.broadcast(scope)).select("query", F.lit(4).alias("tier"), "document_id", "n")
    return found.unionByName(rest)


# ---- common terms ------------------------------------------------------------

#: Rows beyond which a token is too common for an alternative of terms.
COMMON = 50_000


def selective_terms(terms: DataFrame, frequencies: DataFrame, most: int = COMMON) -> DataFrame:
    """Of (query, term, token), one row for each token of a term: the terms (query,
    term) whose rarest token is in ``most`` rows or fewer, or else the rarest term."""
    df = terms.join(frequencies, "token", "left").groupBy("query", "term").agg(F.min(F.coalesce("df", F.lit(0))).alias("df"))
    least = df.groupBy("query").agg(F.min(F.struct("df", "term")).alias("least"))
    return df.join(least, "query").where((F.col("df") <= most) | ((F.col("least.df") > most) & (F.col("term") == F.col("least.term")))).select("query", "term", "df")


_TERMS = [(q, t, token) for q, terms in {"mixed": ("the ertion", "thention", "the"), "common": ("the", "der")}.items() for t in terms for token in t.split()]


@query(f"""WITH {CHUNKS}, w AS (SELECT chunk_id, unnest(list_distinct({tokens_sql("section_label || ' ' || chunk_text")})) AS token FROM chunks), f AS (SELECT token, count(*) AS df FROM w GROUP BY token),
t(query, term, token) AS (VALUES {', '.join(str(t) for t in _TERMS)}), d AS (SELECT query, term, min(coalesce(df, 0)) AS df FROM t LEFT JOIN f USING (token) GROUP BY query, term), l AS (SELECT query, min(df) AS least, arg_min(term, (df, term)) AS term FROM d GROUP BY query)
SELECT d.query, d.term, d.df FROM d JOIN l USING (query) WHERE df <= 20 OR least > 20 AND d.term = l.term""")
def pruned_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of two queries without those too common, here in over 20 chunks."""
    words = F.array_distinct(tx.tokens(F.concat_ws(" ", "section_label", "chunk_text")))
    wanted = sorted({token for *_, token in _TERMS})
    rows = chunks(decisions(spark, sf_dir)).select(F.explode(F.filter(words, lambda w: w.isin(*wanted))).alias("token"))
    terms = spark.createDataFrame(_TERMS, "query string, term string, token string")
    return selective_terms(terms, rows.groupBy("token").agg(F.count("*").alias("df")), 20)
