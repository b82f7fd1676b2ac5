"""Quality rules: counts, and the divergence of a text's character classes and
common words from language references.

References are the mean histograms of all documents of a language, so that no long
one outweighs the others.  A text is judged against one language, the closest by
the sum of its Jensen-Shannon distances (the square root of the divergence to
base 2, from 0 to 1); the common words only if it has enough words for a
histogram.  Words of languages without a list in COMMON share one bin, so those
are told apart by their characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans.arrow import add_columns

#: Base rules: least words, and the largest share of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Largest Jensen-Shannon distances of a kept text.
MOST_CLASS_DISTANCE, MOST_WORD_DISTANCE = 0.25, 0.5
#: Parts of a document's weight that are counted, and languages at most.
UNITS, MOST_LANGUAGES = 1_000_000, 1000
#: Words and characters below which a histogram is not judged.
LEAST_FOR_WORDS, LEAST_FOR_CLASSES = 50, 100

#: Very common words of some languages; all others share a bin.
COMMON = {
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "en": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec elle son aux être cette ou comme mais on leur nous vous même",
}
_BIN = {w.encode(): i for i, w in enumerate(sorted({w for text in COMMON.values() for w in text.split()}))}
WORD_BINS = len(_BIN) + 1
_SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\v\f\r"
_EDGES = b".,;:!?\"'()[]"


@cache
def _classes() -> np.ndarray:
    """The class of each code point: lower, upper and other letters, digits,
    white space, punctuation, symbols, the rest."""
    kinds = {"Ll": 0, "Lu": 1, "Lt": 1, "N": 3, "Z": 4, "P": 5, "S": 6, "L": 2}
    out = np.full(0x110000, 7, np.uint8)
    for i in range(0x110000):
        kind = unicodedata.category(chr(i))
        out[i] = kinds.get(kind, kinds.get(kind[0], 7))
    out[[9, 10, 11, 12, 13]] = 4
    return out


CLASSES = 8


def class_histogram(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_classes()[points], minlength=CLASSES)


def word_histogram(distinct: Iterable[bytes], counts: np.ndarray) -> np.ndarray:
    bins = [_BIN.get(w.strip(_EDGES).decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass"), WORD_BINS - 1) for w in distinct]
    return np.bincount(np.array(bins, np.int64), weights=counts, minlength=WORD_BINS) if bins else np.zeros(WORD_BINS)


def _numbered(text: str) -> tuple[dict[bytes, int], np.ndarray]:
    number: dict[bytes, int] = {}
    ids = [number.setdefault(w, len(number)) for w in text.encode("utf-8", "surrogatepass").split()]
    return number, np.array(ids, np.int64)


def base_counts(text: str, number: dict[bytes, int], ids: np.ndarray) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, _SYMBOLS))
    seen: set[str] = set()
    copies = 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            if line in seen:
                copies += 1
            seen.add(line)
    repeated = 0
    if len(ids) >= 4:
        _, pair = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)
        _, window, times = np.unique(pair[:-1] * len(number) + ids[2:], return_inverse=True, return_counts=True)
        often = times[window] > 1
        covered = np.zeros(len(ids), bool)
        for k in range(3):
            covered[k : k + len(often)] |= often
        repeated = int(covered.sum())
    return chars, symbols, copies, repeated


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 1 if one is empty."""
    if not a.sum() or not b.sum():
        return 1.0
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2

    def entropy(x: np.ndarray) -> float:
        x = x[x > 0]
        return float(-(x * np.log2(x)).sum())

    return max(0.0, entropy(m) - (entropy(p) + entropy(q)) / 2) ** 0.5


def references(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Class and word histograms of each language, over all its rows, each of weight
    1 in each (UNITS of it are counted); as many numbers for each language at any
    input size.  More than MOST_LANGUAGES distinct labels are an error: the
    references go to every task."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for batch in batches:
            for of, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                number, ids = _numbered(t)
                words = word_histogram(number, np.bincount(ids, minlength=len(number)))
                sums = found.setdefault(of, np.zeros(CLASSES + WORD_BINS))
                for own, part in ((class_histogram(t), slice(0, CLASSES)), (words, slice(CLASSES, None))):
                    if own.sum():
                        sums[part] += np.rint(own * (UNITS / own.sum()))
        for of, sums in found.items():
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([of] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(sums[at].astype(np.int64))], names=["lang", "bin", "n"])

    known = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    if known.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    out: dict[str, np.ndarray] = {}
    for r in known.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.lang, np.zeros(CLASSES + WORD_BINS))[r.bin] = r.n
    return {of: (x[:CLASSES], x[CLASSES:]) for of, x in sorted(out.items())}


FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("class_distance", T.DoubleType()),
    T.StructField("word_distance", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def judge(text: str | None, known: dict[str, tuple[np.ndarray, np.ndarray]]) -> tuple:
    """The values of FIELDS for one text."""
    text = text or ""
    number, ids = _numbered(text)
    n = len(ids)
    chars, symbols, copies, repeated = base_counts(text, number, ids)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    own_classes = class_histogram(text) if len(text) >= LEAST_FOR_CLASSES else None
    own_words = word_histogram(number, np.bincount(ids, minlength=len(number))) if n >= LEAST_FOR_WORDS else None
    of = lambda own, reference: None if own is None else distance(own, reference)
    each = [(of(own_classes, c), of(own_words, w)) for c, w in known.values()]
    classes, words = min(each, key=lambda d: (d[0] or 0) + (d[1] or 0)) if each else (None, None)
    kept = not failed and (classes is None or classes <= MOST_CLASS_DISTANCE) and (words is None or words <= MOST_WORD_DISTANCE)
    return n, chars, symbols, copies, repeated, failed, classes, words, kept


def with_quality(docs: DataFrame, known: dict[str, tuple[np.ndarray, np.ndarray]], text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with FIELDS; equal names in docs are replaced.

    A null text counts as empty: no words, so base_failed.  A distance is null
    where the text is too short for it or there is no reference; it then doesn't
    speak against the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def start() -> Callable:
        own = shared.value

        def compute(texts: pa.Array) -> list:
            found = [judge(t.as_py(), own) for t in texts]
            return [[f[i] for f in found] for i in range(len(FIELDS))]

        return compute

    return add_columns(docs, [text], FIELDS, start, drop=[text] if drop_text else [])
