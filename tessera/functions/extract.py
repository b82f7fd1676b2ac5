"""Metadata of legal decisions from their text, as Columns.

Patterns avoid look-around, so that they mean the same to RE2.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as tx

# What introduces or forms a citation, date or label.
INDEX_LINE = r"(?i)\b(?:index\s*codes?|ic)\s*[:#-]?\s*([^\n\r]{0,220})"
INDEX_CODE = r"\b(?:[A-Z]{1,4}\s*-?\s*(?:\d\s*){1,4}(?:\.\s*(?:\d\s*){1,2})?[A-Z]?|\d{1,4}(?:\.\d{1,2})?[A-Z]?)\b"
SECTION_ID = r"((?:[IVXLC]+-)?\d+(?:\.\d+)+(?:\([a-z0-9]+\))*)\b"
RULE = r"(?i)\b(?:rules?\s+and\s+regulations?|rules?)\s*(?:section|sec\.?|§)?\s*" + SECTION_ID
SECTION = r"(?i)\b((?:section|sec\.?|§)\s*)" + SECTION_ID
ORDINANCE = r"(?i)\b(?:rent\s+ordinance|ordinance)\s*(?:no\.?|#|section|sec\.?|§)?\s*(\d+(?:\.\d+)+(?:\([a-z0-9]+\))*)\b"
SECTION_37 = r"(?i)\b((?:section|sec\.?|§)\s*)(37\.\d+(?:\([a-z0-9]+\))*)\b"
RULE_CONTEXT, ORDINANCE_CONTEXT = "rule|regulation|rent board", "ordinance|rent stabilization"
ISO_DATE = r"\b((?:20|19)\d{2})-(\d{2})-(\d{2})\b"
MONTHS = "January February March April May June July August September October November December".split()
LONG_DATE = r"(?i)\b(" + "|".join(MONTHS) + r")\s+(\d{1,2}),\s+((?:20|19)\d{2})\b"
CASE_NUMBER = r"(?i)\b(?:case\s*(?:no\.?|number|#)|docket\s*(?:no\.?|#))\s*[:#-]?\s*([A-Z0-9\-/]{3,30})\b"
AUTHOR = r"(?i)\b(?:judge|alj|hearing officer|author)\s*[:\-]\s*([A-Z][A-Za-z .,'-]{2,80})\b"
GRANT = r"\b(?:grant|approved?|allow(?:ed)?|sustain(?:ed)?)\b"
DENY = r"\b(?:deny|denied|reject(?:ed)?|dismiss(?:ed)?)\b"
PARTIAL = r"\b(?:partial|partially|limited grant|modified)\b"
#: Codes that are really years, long numbers, dates or amounts.
NOISE = r"^(?:(?:19|20)\d{2}|\d{6,}|\d|\d{5})$|^\d{1,2}-\d{1,2}-\d{2,4}$"


def _first(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group)


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def index_codes(text: Column) -> Column:
    """Codes on labelled lines, at most twenty, without noise."""
    found = _all(F.array_join(_all(text, INDEX_LINE), "\n"), INDEX_CODE, 0)
    clean = F.transform(found, lambda c: F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), "^[^A-Z0-9]+", ""), "[^A-Z0-9-]+$", "")))
    return F.slice(F.array_distinct(F.filter(clean, lambda c: (c != "") & ~F.regexp_like(F.replace(c, F.lit("-"), F.lit("")), F.lit(NOISE)) & ~F.regexp_like(c, F.lit(NOISE)))), 1, 20)


def _cited(kind: str, lists: list[Column]) -> Column:
    found = F.transform(reduce(lambda a, b: F.concat(a, b), lists), lambda c: F.concat(F.lit(f"{kind} "), F.regexp_replace(c, r"\s+", "")))
    return F.slice(F.array_distinct(found), 1, 30)


#: Characters on each side of a section in which its context must be, and the
#: most sections that can lie in them.
REACH, PIECES = 80, 17


def sections_near(text: Column, section: str, context: str) -> Column:
    """Sections by a pattern of two groups, the second the id, that have a word
    of their context within reach."""
    plain = F.translate(text, "\x01\x02\x03", "")
    marked = F.split(F.regexp_replace(plain, section, "\x01$2\x02$1\x03$2"), "\x01")

    def found(parts: Column) -> Column:
        clean = F.transform(parts, lambda p: F.replace(F.regexp_replace(p, "^[^\x02]*\x02", ""), F.lit("\x03"), F.lit("")))

        def hit(i: Column) -> Column:
            part = F.element_at(parts, i)
            number = F.substring_index(part, "\x02", 1)
            length = F.length(number) + F.length(F.substring_index(F.regexp_replace(part, "^[^\x02]*\x02", ""), "\x03", 1))
            low = F.greatest(F.lit(1), i - PIECES)
            before = F.right(F.array_join(F.slice(clean, low, i - low), ""), F.lit(REACH))
            after = F.left(F.array_join(F.slice(clean, i, F.lit(PIECES)), ""), length + REACH)
            return F.when(F.regexp_like(F.lower(F.concat(before, after)), F.lit(context)), number)

        places = F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i > 1)
        return F.array_compact(F.transform(places, hit))

    return F.get(F.transform(F.array(marked), found), F.lit(0))


def sections_near_sql(section: str, context: str, text: str = "text") -> str:
    """The same as an expression in SQL."""
    q = section.replace("'", "''")
    parts = f"string_split(regexp_replace(translate({text}, chr(1) || chr(2) || chr(3), ''), '{q}', chr(1) || '\\2' || chr(2) || '\\1' || chr(3) || '\\2', 'g'), chr(1))"
    tail = "regexp_replace(p, '^[^\x02]*\x02', '')"
    clean = f"list_transform(x.p, lambda p: replace({tail}, chr(3), ''))"
    number = "string_split(x.p[i], chr(2))[1]"
    length = f"length({number}) + length(string_split({tail.replace('(p,', '(x.p[i],')}, chr(3))[1])"
    before = f"right(array_to_string(({clean})[greatest(1, i - {PIECES}):i - 1], ''), {REACH})"
    after = f"left(array_to_string(({clean})[i:i + {PIECES - 1}], ''), {length} + {REACH})"
    hit = f"CASE WHEN regexp_matches(lower({before} || {after}), '{context}') THEN {number} END"
    return f"list_transform([{{'p': {parts}}}], lambda x: list_filter(list_transform(range(2, len(x.p) + 1), lambda i: {hit}), lambda v: v IS NOT NULL))[1]"


def rule_sections(text: Column) -> Column:
    """Rules cited directly, then sections near a mention of rules."""
    return _cited("Rule", [_all(text, RULE), sections_near(text, SECTION, RULE_CONTEXT)])


def ordinance_sections(text: Column) -> Column:
    return _cited("Ordinance", [_all(text, ORDINANCE), sections_near(text, SECTION_37, ORDINANCE_CONTEXT)])


def decision_date(text: Column) -> Column:
    """The first ISO date, else the first one in words, as yyyy-mm-dd; '' if none."""
    iso = F.concat_ws("-", *[_first(text, ISO_DATE, g) for g in (1, 2, 3)])
    month = F.lower(_first(text, LONG_DATE, 1))
    number = F.array_position(F.array(*[F.lit(m.lower()) for m in MONTHS]), month)
    long = F.concat_ws("-", _first(text, LONG_DATE, 3), F.lpad(number.cast("string"), 2, "0"), F.lpad(_first(text, LONG_DATE, 2), 2, "0"))
    return F.when(iso != "--", iso).when(month != "", long).otherwise("")


def case_number(text: Column) -> Column:
    return _first(text, CASE_NUMBER)


def author(text: Column) -> Column:
    return F.trim(F.regexp_replace(_first(text, AUTHOR), r"[ \t]+", " "))


def outcome(text: Column) -> Column:
    """A vote of words for granted, denied and partial."""
    lowered = F.lower(text)
    grant, deny, partial = (F.regexp_count(lowered, F.lit(p)) for p in (GRANT, DENY, PARTIAL))
    return F.when((partial >= F.greatest(grant, deny)) & (partial > 0), "partial").when(grant > deny, "grant").when(deny > grant, "deny").otherwise("unclear")


def confidence(codes: Column, rules: Column, ordinances: Column, case: Column, date: Column, name: Column) -> Column:
    """0.3 and something for each kind of metadata found, 0.98 at most."""
    some = lambda c, w: F.when(c, w).otherwise(0.0)
    total = F.lit(0.3) + some(F.size(codes) > 0, 0.15) + some(F.size(rules) > 0, 0.15) + some(F.size(ordinances) > 0, 0.15) + some(case != "", 0.1) + some(date != "", 0.1) + some(name != "", 0.05)
    return F.round(F.least(F.lit(0.98), total), 2)


#: Headings of chunk types, in order of precedence.
HEADING_TYPES = (
    ("caption_title", r"caption|appearance|parties|before the|case\s+no\.?|case\s+number"),
    ("procedural_history", r"procedural|history|background and procedural|chronology|prior proceedings|hearing history"),
    ("facts_background", r"facts|background|factual background|statement of facts|record background"),
    ("issue_statement", r"issues? presented|issues?|question presented|question"),
    ("authority_discussion", r"conclusions? of law|authority|legal standard|rules?|ordinance"),
    ("analysis_reasoning", r"analysis|discussion|reasoning|application of law"),
    ("findings", r"findings?(?: of fact)?"),
    ("holding_disposition", r"holding|order|disposition|decision|relief|conclusion"),
)
#: Signals of chunk types in text.
SIGNALS = {
    "disposition": r"ordered|granted|denied|dismissed|disposition|relief|affirmed|reversed",
    "findings": r"\bfindings?\b|found that|finding of fact|credibility",
    "procedural": r"procedural|history|hearing|petition filed|notice of hearing|continuance|prior order",
    "facts": r"facts?|background|record shows|testimony|evidence",
    "issue": r"\bissue\b|issues? presented|question presented|whether",
    "analysis": r"analysis|therefore|because|reasoning|we conclude|balanc",
    "authority": r"ordinance\s+[0-9]|rules?(?:\s+and\s+regulations?)?\s+sections?|authority|conclusions? of law|legal standard|index codes?",
    "caption": r"case\s+no\.?|petitioner|respondent|before the|department",
}
#: Type, confidence and reason by signal, in order.
BY_SIGNAL = (
    ("disposition", "holding_disposition", 0.78, "disposition_language_match"),
    ("findings", "findings", 0.76, "finding_section_match"),
    ("procedural", "procedural_history", 0.7, "procedural_language_match"),
    ("facts", "facts_background", 0.68, "facts_background_language_match"),
    ("issue", "issue_statement", 0.66, "issue_language_match"),
    ("analysis", "analysis_reasoning", 0.64, "analysis_language_match"),
)


def signal(lowered: Column, name: str) -> Column:
    return tx.like(lowered, SIGNALS[name])


def heading_type(heading: Column) -> Column:
    """The type that a heading names, or null."""
    h = F.lower(heading)
    return reduce(lambda found, rule: found.when(F.regexp_like(h, F.lit(rule[1])), rule[0]), HEADING_TYPES[1:], F.when(F.regexp_like(h, F.lit(HEADING_TYPES[0][1])), HEADING_TYPES[0][0]))


def chunk_class(heading: Column, text: Column, density: Column) -> Column:
    """struct(type, confidence, reason): by heading, else by the first signal,
    else by the density of references."""
    of = heading_type(heading)
    lowered = F.lower(text)
    entry = lambda t, c, r: F.struct(F.lit(t).alias("type") if isinstance(t, str) else t.alias("type"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    by_heading = F.when(of == "findings", "finding_section_match").when(of == "authority_discussion", "authority_reference_density").otherwise("heading_match")
    found = F.when(of.isNotNull(), entry(of, F.when(of == "findings", 0.93).otherwise(0.9), by_heading))
    for name, kind, sure, reason in BY_SIGNAL:
        here = signal(lowered, name)
        if name == "facts":
            here &= ~signal(lowered, "authority")
        found = found.when(here, entry(kind, sure, reason))
    found = found.when(signal(lowered, "authority") | (density >= 2.0), entry("authority_discussion", F.when(density >= 2.6, 0.72).otherwise(0.66), "authority_reference_density"))
    return found.when(signal(lowered, "caption"), entry("caption_title", 0.62, "caption_signal_match")).otherwise(entry("general_body", 0.53, "heading_match"))


def retrieval_priority(kind: Column, sure: Column, aligned: Column, lowered: Column) -> Column:
    high = kind.isin("holding_disposition", "findings") | (kind == "analysis_reasoning") & (sure >= 0.66) | (kind == "authority_discussion") & aligned
    medium = kind.isin("procedural_history", "facts_background", "issue_statement") | signal(lowered, "authority") | signal(lowered, "findings") | signal(lowered, "disposition")
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-16 units, in hexadecimal."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.call_function("ascii", c).cast("bigint"))
    beyond = lambda c: c - 0x10000
    pair = lambda c: F.array(F.shiftright(beyond(c), 10) + 0xD800, beyond(c).bitwiseAND(F.lit(0x3FF)) + 0xDC00)
    units = F.flatten(F.transform(codes, lambda c: F.when(c < 0x10000, F.array(c)).otherwise(pair(c))))
    mask = F.lit(0xFFFFFFFF)
    value = F.aggregate(units, F.lit(0x811C9DC5).cast("bigint"), lambda h, c: (h.bitwiseXOR(c) * 16777619).bitwiseAND(mask))
    return F.lpad(F.lower(F.hex(value)), 8, "0")
