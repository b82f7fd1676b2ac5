"""Greedy word-piece token counts by a linear longest-match automaton.

Each node of the vocabulary trie has a failure link and the number of pieces
that following it emits, so a word is measured in one pass over its characters
and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans.arrow import add_columns

#: Words whose counts a worker remembers; beyond it, it starts anew.
REMEMBERED = 200_000
#: The mark before word-initial pieces in the vocabulary.
MARK = "▁"


class LongestMatch:
    """Counts pieces of words over a vocabulary.

    ``initial`` pieces may start a word, ``inner`` ones continue it.
    """

    def __init__(self, initial: Iterable[str], inner: Iterable[str]):
        # node 0 starts a word; node 1 continues it
        self._edges: list[dict[str, int]] = [{}, {}]
        self._is_piece = [False, False]
        for root, pieces in ((0, initial), (1, inner)):
            for piece in pieces:
                node = root
                for c in piece:
                    following = self._edges[node].get(c)
                    if following is None:
                        following = len(self._edges)
                        self._edges[node][c] = following
                        self._edges.append({})
                        self._is_piece.append(False)
                    node = following
                self._is_piece[node] |= bool(piece)
        self._link()
        self._known: dict[bytes, int] = {}

    def _link(self) -> None:
        n = len(self._edges)
        self._fail, self._popped = [-1] * n, [0] * n
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in self._edges[node].items():
                if self._is_piece[child]:
                    self._fail[child], self._popped[child] = 1, 1
                else:
                    popped, at = self._popped[node], self._fail[node]
                    while at >= 0 and c not in self._edges[at]:
                        popped += self._popped[at]
                        at = self._fail[at]
                    if at >= 0:
                        self._fail[child], self._popped[child] = self._edges[at][c], popped
                queue.append(child)

    def count(self, word: str) -> int:
        """Pieces of the greedy longest match; 0 if it can't cover the word."""
        edges, fail, popped = self._edges, self._fail, self._popped
        node = total = 0
        for c in word:
            following = edges[node].get(c)
            while following is None:
                if fail[node] < 0:
                    return 0
                total += popped[node]
                node = fail[node]
                following = edges[node].get(c)
            node = following
        while node > 1:
            if fail[node] < 0:
                return 0
            total += popped[node]
            node = fail[node]
        return total

    def forget(self) -> None:
        """Let go of what was remembered of texts."""
        self._known = {}

    def count_text(self, text: str | None) -> tuple[int, int, int]:
        """Words, tokens and unknown words; an unknown word is one token."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        known = self._known
        try:
            counts = [known[w] for w in words]
        except KeyError:
            counts = []
            for w in words:
                n = known.get(w)
                if n is None:
                    n = self.count(w.decode("utf-8", "surrogatepass"))
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[w] = n
                counts.append(n)
        unknown = counts.count(0)
        return len(words), sum(counts) + unknown, unknown


def from_sentencepiece(path: str) -> LongestMatch:
    """The vocabulary of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    initial = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1]
    return LongestMatch(initial, [p for p in pieces if MARK not in p])


_loaded: dict[str, LongestMatch] = {}


def loaded(path: str) -> LongestMatch:
    """The automaton, built once in each worker process."""
    if path not in _loaded:
        _loaded[path] = from_sentencepiece(path)
    return _loaded[path]


def with_piece_counts(docs: DataFrame, vocabulary: str, text: str = "text", drop_text: bool = False) -> DataFrame:
    """docs with ``n_words``, ``n_tokens`` and ``n_unknown``, all long.

    Words are the runs without ASCII white space.  A null or empty text has 0 of
    each.  Rows and repetitions are kept; equal names in docs are replaced.
    """

    def start() -> Callable:
        match = loaded(vocabulary)

        def compute(texts: pa.Array) -> list:
            found = [match.count_text(t.as_py()) for t in texts]
            return [list(x) for x in zip(*found, strict=True)] or [[], [], []]

        compute.close = match.forget
        return compute

    fields = [T.StructField(n, T.LongType()) for n in ("n_words", "n_tokens", "n_unknown")]
    return add_columns(docs, [text], fields, start, drop=[text] if drop_text else [])
