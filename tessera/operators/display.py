"""Text as it is shown: words that extraction has torn apart are put together."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans.arrow import add_columns

#: Characters that have no width, other spaces, and words of three
#: letters that a torn word may be.
INVISIBLE = re.compile("[­​-‍⁠﻿]")
SPACES = re.compile("[   -   　]")
SHORT_WORDS = frozenset(("the", "and", "not", "was", "are", "for"))
#: Letters that stand alone before the rest of a word, and a letter before
#: short pieces; letters that are words; and what parts the words of a query.
LETTERS = re.compile(r"\b(?:[A-Za-z]\s+){1,4}[A-Za-z]{2,}\b", re.ASCII)
PIECES = re.compile(r"\b[A-Za-z](?:\s+[A-Za-z]{1,4}){1,3}\b", re.ASCII)
WORDS_OF_ONE = ("A", "a", "I")
BETWEEN_WORDS = re.compile(r"[\s,.;:()/\"'-]+")
LEAST_TERM, LEAST_WORD = 3, 4


def cased(torn: str, word: str) -> str:
    """The word in the case that the torn one has: upper, capitalised or lower."""
    joined = re.sub(r"\s+", "", torn)
    if not joined:
        return word
    if joined == joined.upper():
        return word.upper()
    return word.capitalize() if joined[0] == joined[0].upper() and joined[1:] == joined[1:].lower() else word.lower()


def _lone(parts: list[str]) -> bool:
    """Whether the first letter may be a word of its own, as too little follows."""
    return parts[0] in WORDS_OF_ONE and len(parts) < 3


def _letters(match: re.Match) -> str:
    parts = match.group().split()
    merged = "".join(parts)
    shaped = merged[0].isupper() and merged[1:].islower() or merged.islower()
    if len(parts) < 2 or len(merged) < LEAST_WORD or not shaped or _lone(parts):
        return match.group()
    return cased(match.group(), merged)


def _pieces(match: re.Match) -> str:
    parts = match.group().split()
    merged = "".join(parts)
    if len(merged) < LEAST_WORD and merged.lower() not in SHORT_WORDS or _lone(parts):
        return match.group()
    return cased(match.group(), merged)


def repaired(text: str, query: str = "") -> str:
    """A text without invisible characters, with plain spaces, the words of a query put
    together wherever they are torn, and then other torn words."""
    text = SPACES.sub(" ", INVISIBLE.sub("", text))
    terms = sorted({t for t in BETWEEN_WORDS.split(query) if len(t) >= LEAST_TERM}, key=lambda t: (-len(t), t))
    for term in terms:
        word = re.sub("[^A-Za-z0-9]", "", term)
        if len(word) >= LEAST_TERM:
            pattern = rf"(?<![A-Za-z0-9]){r'\s*'.join(word)}(?![A-Za-z0-9])"
            text = re.sub(pattern, lambda m, w=word: cased(m.group(), w), text, flags=re.IGNORECASE)
    return PIECES.sub(_pieces, LETTERS.sub(_letters, text))


def with_display(rows: DataFrame, text: str = "text", query: str | None = None, name: str = "display") -> DataFrame:
    """rows with the text as it is shown; a null text or query is empty.  Rows and their
    repetitions are kept; an equal name is replaced."""

    def start() -> Callable:
        def compute(texts: pa.Array, queries: pa.Array | None = None) -> list:
            asked = queries.to_pylist() if queries is not None else [""] * len(texts)
            return [[repaired(t.as_py() or "", q or "") for t, q in zip(texts, asked, strict=True)]]

        return compute

    return add_columns(rows, [text] if query is None else [text, query], [T.StructField(name, T.StringType())], start)
