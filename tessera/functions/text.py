"""Text as Columns: folding, tokens, whole words, phrases and keys.

All of it is native expressions.  Folding takes every letter that Unicode
decomposes to a base and marks to its base.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from functools import cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from re import _constants, _parser
except ImportError:  # then patterns are searched as they are
    _parser = None


def _bases() -> dict[str, str]:
    """Letters of one base and marks to the base, and marks to nothing."""
    out = {}
    for point in (*range(0xC0, 0x600), *range(0x1E00, 0x2000)):
        parts = unicodedata.normalize("NFD", chr(point))
        base = "".join(c for c in parts if not 0x300 <= ord(c) <= 0x36F)
        if base != chr(point) and len(base) <= 1:
            out[chr(point)] = base
    return out


_BASES = _bases()
#: Accented letters, and their bases in the same order; marks at the end have none.
ACCENTED = "".join(sorted(_BASES, key=lambda c: not _BASES[c]))
BASES = "".join(_BASES[c] for c in ACCENTED)

#: Words that carry no meaning in a query.
STOPWORDS = (
    "a an and are as at be but by for from if in into is it no not of on or such that the their then there these they this to was will with "
    "about am been being can could did do does done had has have having her him his how its may might must my our shall she should what when "
    "where which who whom whose why without would your"
).split()

#: Corrections of frequent misspellings in queries.
CORRECTIONS = {
    "habitibility": "habitability", "habitablity": "habitability", "habitabilty": "habitability", "habitality": "habitability",
    "harrassment": "harassment", "harasment": "harassment", "harrasment": "harassment",
    "evicton": "eviction", "evition": "eviction", "evciton": "eviction",
    "landord": "landlord", "lanlord": "landlord", "landlrod": "landlord",
    "tenent": "tenant", "tennant": "tenant",
    "maintenence": "maintenance", "maintainance": "maintenance", "maintanence": "maintenance",
    "negligance": "negligence", "negligense": "negligence",
    "apartement": "apartment", "aparment": "apartment",
    "subleese": "sublease", "sublese": "sublease",
    "nusance": "nuisance", "nuisence": "nuisance",
    "retalliation": "retaliation", "retaliaton": "retaliation",
    "relocaton": "relocation", "ordinence": "ordinance",
    "infestion": "infestation", "infestaton": "infestation",
}


def squeeze(text: Column) -> Column:
    """White space, no-break spaces too, as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{00A0}]+", " "))


def bare(text: Column) -> Column:
    """Lower case without accents; a text of ASCII alone has none to look up."""
    lowered = F.lower(text)
    return F.when(F.octet_length(text) == F.length(text), lowered).otherwise(F.translate(lowered, ACCENTED, BASES))


def fold(text: Column) -> Column:
    """Lower case without accents, white space squeezed."""
    return squeeze(bare(text))


def tokens(text: Column) -> Column:
    """Folded runs of letters, digits, _, : and -, of two characters or more."""
    return F.regexp_extract_all(bare(text), F.lit("[a-z0-9_:-]{2,}"), F.lit(0))


def _stop() -> Column:
    return F.array(*map(F.lit, STOPWORDS))


def lexical_tokens(text: Column) -> Column:
    """Distinct tokens that mean something, eight at most; short ones only if
    they have a digit or no longer word is there."""
    kept = F.filter(F.array_distinct(tokens(text)), lambda t: ~F.array_contains(_stop(), t))
    longer = F.exists(kept, lambda t: (F.length(t) >= 4) & ~F.regexp_like(t, F.lit("^[0-9]+$")))
    return F.slice(F.filter(kept, lambda t: (F.length(t) >= 4) | ~longer | F.regexp_like(t, F.lit("[0-9]"))), 1, 8)


def phrase_tokens(text: Column) -> Column:
    """Distinct tokens of three characters or more that mean something, eight at most."""
    return F.slice(F.filter(F.array_distinct(tokens(text)), lambda t: (F.length(t) >= 3) & ~F.array_contains(_stop(), t)), 1, 8)


def corrected(text: Column) -> Column:
    """A query's words with known misspellings put right."""
    words = F.split(F.regexp_replace(text, "([A-Za-z]+)", "\x01$1\x01"), "\x01")
    known = F.create_map(*[F.lit(x) for pair in CORRECTIONS.items() for x in pair])
    return F.array_join(F.transform(words, lambda w: F.coalesce(known[F.lower(w)], w)), "")


def quoted_phrase(text: Column) -> Column:
    """What a query quotes, if it quotes as a whole and at least two tokens; else ''."""
    straight = F.trim(F.translate(text, "“”„‟", '""""'))
    inner = F.trim(F.regexp_extract(straight, r'^"([^"]+)"$', 1))
    return F.when((F.length(straight) >= 4) & (F.size(tokens(inner)) >= 2), inner).otherwise("")


def phrase_literal(text: Column) -> Column:
    """A quoted full-text phrase of the letters and digits."""
    plain = squeeze(F.regexp_replace(fold(text), r"[^a-z0-9\s]", " "))
    return F.when(plain != "", F.concat(F.lit('"'), plain, F.lit('"'))).otherwise("")


def word_pattern(term: str) -> str:
    """A pattern for a folded term as a whole word, which both Java and RE2 read."""
    return "(^|[^a-z0-9])" + "".join(c if c.isalnum() or c in " _" else "\\" + c for c in term) + "([^a-z0-9]|$)"


def bounded(pattern: str) -> str:
    """A pattern whose word boundaries are those of ASCII letters, digits and _, as in
    RE2 and ECMAScript; Java's also know other letters.  Beside a character of a word
    only the other side is looked at."""
    word = "[A-Za-z0-9_]"
    pattern = re.sub(rf"\\b(?={word}(?![?*{{]))", rf"(?<!{word})", pattern)
    pattern = re.sub(rf"(?<=(?<!\\){word})\\b", rf"(?!{word})", pattern)
    return pattern.replace(r"\b", f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def spaced(folded: Column) -> Column:
    """A folded text between spaces, each character that isn't a letter or digit as one:
    has_spaced() and count_spaced() tell the same of it as has_word() and count_word()."""
    return F.concat(F.lit(" "), F.regexp_replace(folded, "[^a-z0-9]", " "), F.lit(" "))


def has_spaced(spaced_text: Column, folded: Column, term: str) -> Column:
    found = F.contains(spaced_text, F.lit(f" {term} "))
    return found if _plain(term) else F.contains(folded, F.lit(term)) & F.regexp_like(folded, F.lit(word_pattern(term)))


def count_spaced(spaced_text: Column, folded: Column, term: str) -> Column:
    if not _plain(term):
        return count_word(folded, term)
    word = f" {term} "
    left = F.length(F.replace(spaced_text, F.lit(word), F.lit("")))
    return F.when(~F.contains(spaced_text, F.lit(word)), 0).otherwise(((F.length(spaced_text) - left) / len(word)).cast("int"))


def _plain(term: str) -> bool:
    return re.fullmatch("[a-z0-9]+", term) is not None


def _best(options: list[tuple[str, ...]]) -> tuple[str, ...]:
    return max(options, key=lambda o: (min(4, min(map(len, o))), -len(o)), default=())


def _needed(nodes) -> tuple[str, ...]:
    options, run = [], ""
    for op, value in [*nodes, (None, None)]:
        if op is _constants.LITERAL:
            run += chr(value)
            continue
        if op in (_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT):
            continue  # no characters of the match
        if run:
            options.append((run,))
        run = ""
        if op is _constants.SUBPATTERN and not value[1] and not value[2]:
            options.append(_needed(value[3]))
        elif op is _constants.BRANCH:
            each = [_needed(x) for x in value[1]]
            options.append(tuple(x for o in each for x in o) if all(each) else ())
        elif op in (_constants.MAX_REPEAT, _constants.MIN_REPEAT) and value[0]:
            options.append(_needed(value[2]))
    return _best([o for o in options if o])


@cache
def needed(pattern: str) -> tuple[str, ...]:
    """Strings one of which is in every match of a pattern; none if that isn't known."""
    if _parser is None or "(?i" in pattern or "\\x{" in pattern:
        return ()
    found = set(_needed(_parser.parse(pattern)))
    return tuple(sorted(x for x in found if not any(y != x and y in x for y in found)))


def like(text: Column, pattern: str) -> Column:
    """Whether a text matches a pattern, with the word boundaries of ``bounded``.  A text
    without any of the strings that a match needs isn't searched by the pattern."""
    found = F.regexp_like(text, F.lit(bounded(pattern)))
    strings = needed(pattern)
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(x)) for x in strings]) & found if strings else found


def has_word(folded: Column, term: str) -> Column:
    return F.contains(folded, F.lit(term)) & F.regexp_like(folded, F.lit(word_pattern(term)))


def count_word(folded: Column, term: str) -> Column:
    """Occurrences as a whole word; neighbours that share a separator count once."""
    return F.when(~F.contains(folded, F.lit(term)), 0).otherwise(F.regexp_count(folded, F.lit(word_pattern(term))))


def _place(folded: Column, pattern: str) -> Column:
    """0-based place of what follows a pattern's leading separator, or -1."""
    hit = F.regexp_instr(folded, F.lit(pattern))
    at_start = (hit == 1) & F.regexp_like(F.substring(folded, 1, 1), F.lit("[a-z0-9]"))
    return F.when(hit == 0, -1).when(at_start, 0).otherwise(hit)


def word_position(folded: Column, term: str) -> Column:
    """0-based place of the first occurrence as a whole word, or -1."""
    return _place(folded, word_pattern(term))


def group_position(folded: Column, group: Sequence[str]) -> Column:
    """The same for the first of several terms, in one pass."""
    return _place(folded, "(^|[^a-z0-9])(" + "|".join(word_pattern(v)[13:-13] for v in group) + ")([^a-z0-9]|$)")


def slug(text: Column) -> Column:
    """Lower case, other characters than letters and digits as single _."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_|_$", "")


def padded(text: Column) -> Column:
    """Lower case between spaces, separators as spaces, for word tests by substring."""
    plain = F.translate(F.coalesce(text, F.lit("")), "\n\r.,;:()-/", "          ")
    return F.concat(F.lit(" "), F.lower(plain), F.lit(" "))


def places(folded: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Where groups of variants first occur, for those that do."""
    return F.filter(F.array(*[group_position(folded, g) for g in groups]), lambda p: p >= 0)


def coverage(found: Column, n: int) -> dict[str, Column]:
    """How many of n groups have a place, the ratio, and a boost for a small span."""
    matched = F.size(found)
    span = F.array_max(found) - F.array_min(found)
    boost = F.when(span <= 120, 0.18).when(span <= 240, 0.12).when(span <= 420, 0.07).when(span <= 700, 0.035).otherwise(0.0)
    return {
        "matched": matched,
        "coverage": F.round(matched / n, 4),
        "proximity": F.when(matched >= 2, boost).otherwise(0.0),
    }


def longest_run(wanted: Column, present: Column) -> Column:
    """Most tokens of ``wanted`` in a row that are all in ``present``."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))

    def step(state: Column, token: Column) -> Column:
        now = F.when(F.array_contains(present, token), state["now"] + 1).otherwise(F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["best"], now).alias("best"))

    return F.aggregate(wanted, start, step, lambda s: s["best"])
