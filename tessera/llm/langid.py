"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained by follow-the-regularised-leader with elastic-net
penalties and calibrated by one temperature.

Three passes: document frequencies of the hashed n-grams over all training
documents, the features of a bounded sample per language for the fit on the
driver, and prediction over all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.rolling import mix
from tessera.plans.arrow import add_columns

#: Slots for hashed n-grams: the bound on all model and statistics sizes.
SLOTS = 1 << 14
#: n-gram lengths, in characters.
LENGTHS = (1, 2, 3)
#: Expected labelled rows per language in the sample for the fit, and languages at
#: most: the model has a weight for each slot and language.
SAMPLE, MOST_LANGUAGES = 800, 1000
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of the hashed n-grams of the lower-cased text, where each run of
    other characters than letters is one space; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    run = np.where(letter, points, np.uint32(32))[keep]
    run = np.concatenate([[32], run]).astype(np.uint64)
    counts = np.zeros(SLOTS, np.int64)
    for n in LENGTHS:
        if len(run) >= n:
            code = np.full(len(run) - n + 1, n, np.uint64)
            for j in range(n):
                code = (code << np.uint64(21)) ^ run[j : j + len(code)]
            counts += np.bincount((mix(code) >> np.uint64(50)).astype(np.int64), minlength=SLOTS)
    return counts


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots and TF-IDF values, of length 1."""
    at = np.flatnonzero(counts)
    x = np.sqrt(counts[at]) * idf[at]
    return at, x / max(np.linalg.norm(x), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # slots by languages
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text)
        if counts is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*features(counts, self.idf)) / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    languages: list[str],
    idf: np.ndarray,
    alpha: float = 1.0,
    beta: float = 1.0,
    l1: float = 1e-3,
    l2: float = 1e-2,
    epochs: int = 3,
    seed: int = 7,
) -> Model:
    """Follow the regularised leader, one row at a time; each fifth row only
    sets the temperature."""
    shape = (len(idf) + 1, len(languages))  # the last slot, always 1, is the bias
    z, squares = np.zeros(shape), np.zeros(shape)
    rng = np.random.default_rng(seed)

    def lazy(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        shrunk = np.sign(zs) * np.maximum(np.abs(zs) - l1, 0)
        return -shrunk / ((beta + np.sqrt(squares[at])) / alpha + l2)

    train = [r for k, r in enumerate(rows) if k % 5]
    held = [r for k, r in enumerate(rows) if k % 5 == 0]
    for _ in range(epochs):
        for k in rng.permutation(len(train)):
            at, x, label = train[k]
            at, x = np.append(at, len(idf)), np.append(x, 1.0)
            w = lazy(at)
            error = softmax(x @ w)
            error[label] -= 1
            g = np.outer(x, error)
            old = squares[at]
            squares[at] = old + g * g
            z[at] += g - (np.sqrt(squares[at]) - np.sqrt(old)) / alpha * w
    weights = lazy(np.arange(len(idf) + 1)).astype(np.float32)
    model = Model(languages, idf, weights[:-1], weights[-1])
    if held:
        scores = np.array([model.logits(at, x) for at, x, _ in held])
        truth = np.array([label for *_, label in held])

        def loss(t: float) -> float:
            s = scores / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        low, high = np.log(0.2), np.log(20.0)
        for _ in range(40):
            a, b = low + (high - low) * 0.382, low + (high - low) * 0.618
            low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
        model.temperature = float(np.exp((low + high) / 2))
    return model


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """A model of the rows with text and label.  Document frequencies cover all
    of them; the fit takes about ``sample`` rows for each label, chosen by a
    hash of the key.  More than MOST_LANGUAGES distinct labels are an error."""
    known = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("string").alias("label")).where("text is not null and label is not null")

    if known.select("label").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        df, n = np.zeros(SLOTS, np.int64), {}
        for batch in batches:
            for t, of in zip(batch.column(0), batch.column(1), strict=True):
                counts = ngram_counts(t.as_py())
                if counts is not None:
                    df += counts > 0
                    n[of.as_py()] = n.get(of.as_py(), 0) + 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict(
            {"slot": pa.array([*at.tolist(), *[None] * len(n)], pa.int32()), "label": pa.array([*[None] * len(at), *n], pa.string()), "n": pa.array([*df[at].tolist(), *n.values()], pa.int64())}
        )

    found = known.select("text", "label").mapInArrow(frequencies, "slot int, label string, n long").groupBy("slot", "label").agg(F.sum("n").alias("n")).collect()
    totals = {r.label: r.n for r in found if r.label is not None}
    languages = sorted(totals)
    df = np.zeros(SLOTS)
    for r in found:
        if r.slot is not None:
            df[r.slot] = r.n
    idf = np.log((1 + sum(totals.values())) / (1 + df)) + 1
    if not languages:
        return Model([], idf, np.zeros((SLOTS, 0), np.float32), np.zeros(0))

    grain = 1_000_000
    share = F.create_map(*[x for of, n in totals.items() for x in (F.lit(of), F.lit(int(min(1.0, sample / n) * grain)))])
    chosen = known.where(F.pmod(F.xxhash64("key", F.lit("sample")), F.lit(grain)) < F.coalesce(share[F.col("label")], F.lit(0)))

    def sparse(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t, of, order in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                counts = ngram_counts(t.as_py())
                if counts is not None:
                    at = np.flatnonzero(counts)
                    out.append((at, counts[at], of.as_py(), order.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.list_(pa.int32())), pa.array([o[1] for o in out], pa.list_(pa.int32())), pa.array([o[2] for o in out], pa.string()), pa.array([o[3] for o in out], pa.int64())], names=["slots", "counts", "label", "order"])

    rows = chosen.select("text", "label", F.xxhash64("key", "text").alias("order")).mapInArrow(sparse, "slots array<int>, counts array<int>, label string, order long").collect()
    number = {of: i for i, of in enumerate(languages)}
    examples = []
    for r in sorted(rows, key=lambda r: (r.order, r.label)):
        at = np.array(r.slots)
        x = np.sqrt(np.array(r.counts)) * idf[at]
        examples.append((at, x / max(np.linalg.norm(x), 1e-12), number[r.label]))
    return fit(examples, languages, idf)


def held_out(key: str = "doc_id"):
    """True for the fifth of the keys that is never learned from; null keys too."""
    return F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def with_language(docs: DataFrame, model: Model, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with ``lang_pred`` string and ``score`` double, the calibrated
    probability.  A null text, one without a letter, or a model without
    languages gives ``und`` and 0.  Equal names in docs are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable:
        own = shared.value

        def compute(texts: pa.Array) -> list:
            found = [own.predict(t.as_py()) for t in texts]
            return [[f[0] for f in found], [f[1] for f in found]]

        return compute

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return add_columns(docs, [text], fields, start, drop=[text] if drop_text else [])
