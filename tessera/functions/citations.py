"""Normal forms of citations, as Columns: each form is a row of steps, and each step a
pattern, what takes its place, and the pattern that a text must have for it."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Step(NamedTuple):
    pattern: str
    replacement: str = ""
    only: str = ""


#: The steps.  They leave out a leading section, sec. or rule; a leading
#: part; a leading part in Roman numerals, of one letter at least; the prefix of index
#: codes; white space and _; what no citation has; and leading dashes.
STEPS = {
    "word": Step(r"(?i)^(?:sections?\b|sec\b\.?|rules?\b)\s*[:.\-§]*\s*"),
    "part": Step(r"(?i)^part\b\s*[0-9a-z.\-]+\s*-\s*"),
    "roman": Step(r"(?i)^m{0,4}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})\s*-\s*", only=r"(?i)^[ivxlcdm]+\s*-\s*[^\s]"),
    "code": Step(r"(?i)^ic(?:[\s_-]+|([0-9]))", "$1"),
    "space": Step(r"[\s_]+"),
    "other": Step(r"[^a-z0-9.()\-]"),
    "dashes": Step(r"^-+"),
}
#: The forms; before "space", a text is trimmed at each step, then lower case.
FORMS = {
    "citation": ("word", "part", "space", "other"),
    "bare": ("word", "roman", "part", "space", "other"),
    "code": ("code", "space", "other", "dashes"),
}
#: Ordinance bases whose prefix may be dropped in a look-up.
SAFE_BASES = ("37.1", "37.2", "37.8")
_LOWERED = "space"


def normalised(text: Column, form: str) -> Column:
    """A text in one of FORMS."""

    def step(value: Column, name: str) -> Column:
        pattern, replacement, only = STEPS[name]
        value = F.lower(value) if name == _LOWERED else value if name in ("other", "dashes") else F.trim(value)
        found = F.regexp_replace(value, pattern, replacement)
        return F.when(F.regexp_like(value, F.lit(only)), found).otherwise(value) if only else found

    return reduce(step, FORMS[form], text)


def normalised_sql(column: str, form: str) -> str:
    """The same in SQL with RE2 patterns."""

    def step(value: str, name: str) -> str:
        pattern, replacement, only = STEPS[name]
        value = f"lower({value})" if name == _LOWERED else value if name in ("other", "dashes") else f"trim({value})"
        found = f"regexp_replace({value}, '{pattern}', '{replacement.replace('$', chr(92))}', 'g')"
        return f"CASE WHEN regexp_matches({value}, '{only}') THEN {found} ELSE {value} END" if only else found

    return reduce(step, FORMS[form], column)


def citation(text: Column) -> Column:
    return normalised(text, "citation")


def bare_citation(text: Column) -> Column:
    return normalised(text, "bare")


def index_code(text: Column) -> Column:
    return normalised(text, "code")


def base(text: Column) -> Column:
    """The citation up to its first subsection."""
    return F.substring_index(citation(text), "(", 1)


def ordinance_key(text: Column) -> Column:
    """The citation, without the word ordinance where that is safe."""
    found = citation(text)
    plain = F.regexp_replace(found, "^ordinance", "")
    safe = F.regexp_replace(plain, r"\([a-z0-9]+\)", "").isin(*SAFE_BASES)
    return F.when(F.startswith(found, F.lit("ordinance37.")) & safe, plain).otherwise(found)


def extends(query: Column, candidate: Column) -> Column:
    """Whether a candidate is the query or a subsection of it."""
    return (query != "") & (candidate != "") & ((query == candidate) | F.startswith(candidate, F.concat(query, F.lit("("))))
