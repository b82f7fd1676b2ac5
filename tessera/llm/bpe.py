"""Byte-level BPE: backtracking encoder and offset-table decoder.

The vocabulary must number its merges in order (token 256 + k is merge k), as
byte-level vocabularies commonly do.  An Aho-Corasick automaton over the reversed
tokens names, for every position of a pre-token, all tokens that start there.
The encoder walks from the left, takes the longest token whose pair with its
predecessor could stand side by side in a finished encoding, by a table of pairs
that fills as they occur, goes on to shorter ones, and steps back where none can; each position is given up at most once, so the work is linear.  The
result is the one that applying the merges by rank would give.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Sequence
from hashlib import sha256

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans.arrow import add_columns

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pre-tokens in each of a worker's two memories of encodings: beyond it, the
#: newer becomes the older, from which what is used again comes back.
REMEMBERED = 140_000


#: Pairs of tokens in a worker's table of those that may stand side by side; a full
#: one starts anew.
PAIRS = 1 << 19


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in vocabulary files: itself if it is
    a visible Latin-1 character, else the next free one from 256 on."""
    visible = {b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()}
    letters, free = {}, 256
    for b in range(256):
        if b in visible:
            letters[chr(b)] = b
        else:
            letters[chr(free)] = b
            free += 1
    return letters


class BytePairs:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = _byte_letters()
        model = spec["model"]
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces: dict[int, bytes] = {}
        for token, number in vocabulary.items():
            if token not in self.special:
                pieces[number] = bytes(letters[c] for c in token)
        size = 1 + max([*pieces, *self.special.values()])
        self._bytes = [pieces.get(i, b"") for i in range(size)]
        for content, number in self.special.items():
            self._bytes[number] = content.encode()
        lengths = np.fromiter(map(len, self._bytes), np.int64, size)
        self._sizes = lengths.tolist()
        self._offsets = np.concatenate([[0], np.cumsum(lengths)])
        self._lengths = lengths
        self._pool = np.frombuffer(b"".join(self._bytes), np.uint8)

        self._merged: dict[tuple[int, int], int] = {}
        self._halves = [(i, i) for i in range(size)]
        for pair in model["merges"]:
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            number = vocabulary[left + right]
            halves = (vocabulary[left], vocabulary[right])
            self._merged.setdefault(halves, number)
            if self._halves[number] == (number, number):
                self._halves[number] = halves
        single = [i for i, (a, b) in enumerate(self._halves) if a == b == i and i in pieces]
        ranks = [self._merged[k] for k in self._merged]
        if any(len(pieces[i]) != 1 for i in single) or ranks != sorted(ranks) or (ranks and max(single) > ranks[0]):
            raise ValueError("the vocabulary doesn't number its merges in order")

        numbers = {piece: number for number, piece in pieces.items()}
        # of each token, the next shorter one that begins it, or -1
        self._shorter = [-1] * size
        for piece, number in numbers.items():
            for k in range(len(piece) - 1, 0, -1):
                if piece[:k] in numbers:
                    self._shorter[number] = numbers[piece[:k]]
                    break
        self._pairs: dict[int, bool] = {}
        self._starts = ahocorasick.Automaton()
        for number, piece in pieces.items():
            self._starts.add_word(piece[::-1].decode("latin-1"), number)
        self._starts.make_automaton()
        self._split = regex.compile(PATTERN).findall
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._ascii = {c: b for c, b in letters.items()}
        self._decimals = [str(i) for i in range(size)]
        # a pre-token that is a token is one: always remembered
        self._whole: dict[str, tuple[bytes, str]] = {}
        for number, piece in pieces.items():
            try:
                self._whole[piece.decode()] = self._entry([number])
            except UnicodeDecodeError:
                continue
        self._known = dict(self._whole)
        self._older: dict[str, tuple[bytes, str]] = {}

    def _compatible(self, left: int, right: int) -> bool:
        """The table of pairs that may stand side by side, filled as they occur."""
        key = left * len(self._sizes) + right
        found = self._pairs.get(key)
        if found is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            found = self._pairs[key] = self._stand(left, right)
        return found

    def _stand(self, left: int, right: int) -> bool:
        """Whether merging left and right's common bytes by rank leaves the
        border between these two tokens open.

        The border would close if, at some moment, the two parts that touch it
        have a merge that ranks before the merges that go on to build left and
        right.  The parts are found by undoing, again and again, the later of
        the two tokens."""
        merged, halves = self._merged, self._halves
        before = 1 << 60
        while True:
            joint = merged.get((left, right))
            if joint is not None and joint < before:
                return False
            if left > right:
                before, inner = left, halves[left][1]
                if inner == left:
                    before, inner = right + 1, halves[right][0]
                    if inner == right:
                        return True
                    right = inner
                else:
                    left = inner
            else:
                before, inner = right + 1, halves[right][0]
                if inner == right:
                    before, inner = left, halves[left][1]
                    if inner == left:
                        return True
                    left = inner
                else:
                    right = inner

    def encode_piece(self, piece: bytes) -> list[int]:
        """The tokens of one pre-token."""
        n = len(piece)
        longest = array("i", [-1]) * n  # at each place; shorter ones follow by their links
        for end, number in self._starts.iter(piece[::-1].decode("latin-1")):
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = number
        sizes, shorter, compatible = self._sizes, self._shorter, self._compatible
        dead = bytearray(n + 1)
        taken = array("i")
        at, token = 0, longest[0] if n else -1
        while at < n:
            while token >= 0 and (dead[at + sizes[token]] or taken and not compatible(taken[-1], token)):
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at += sizes[token]
                token = longest[at] if at < n else -1
            else:
                dead[at] = 1
                last = taken.pop()
                at -= sizes[last]
                token = shorter[last]
        return taken.tolist()

    def _entry(self, ids: list[int]) -> tuple[bytes, str]:
        decimals = self._decimals
        return array("i", ids).tobytes(), ",".join([decimals[i] for i in ids])

    def _look_up(self, piece: str) -> tuple[bytes, str]:
        found = self._known.get(piece) or self._older.get(piece)
        if found is None:
            found = self._entry(self.encode_piece(piece.encode("utf-8", "surrogatepass")))
        if len(self._known) >= REMEMBERED + len(self._whole):
            self._older, self._known = self._known, dict(self._whole)
        self._known[piece] = found
        return found

    def forget(self) -> None:
        """Let go of what was remembered of texts."""
        self._older, self._known = {}, dict(self._whole)

    def _parts(self, text: str) -> list[tuple[bytes, str]]:
        get, look_up = self._known.get, self._look_up
        if self._specials is None:
            return [get(p) or look_up(p) for p in self._split(text)]
        out: list[tuple[bytes, str]] = []
        for k, run in enumerate(self._specials.split(text)):
            if k % 2:
                number = self.special[run]
                out.append((np.array([number], np.int32).tobytes(), str(number)))
            else:
                out += [get(p) or look_up(p) for p in self._split(run)]
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join([p[0] for p in self._parts(text)]), np.int32)

    def encode_listed(self, text: str) -> tuple[np.ndarray, str]:
        """The tokens, and their decimal numbers joined by commas."""
        parts = self._parts(text)
        return np.frombuffer(b"".join([p[0] for p in parts]), np.int32), ",".join([p[1] for p in parts])

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens in a row, gathered by the offset table."""
        if not len(ids):
            return b""
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1]) + np.repeat(self._offsets[ids] - ends + lengths, lengths)
        return self._pool[source].tobytes()


#: What with_tokens can add.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "token_ids": T.ArrayType(T.IntegerType()),
    "decoded": T.StringType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def with_tokens(docs: DataFrame, vocabulary: str, text: str = "text", outputs: Sequence[str] = ("n_tokens", "token_ids", "decoded"), drop_text: bool = False) -> DataFrame:
    """docs with some of OUTPUTS: the number of tokens, their ids, the text that
    decoding them gives, and SHA-256 digests in lowercase hex of the decimal ids
    joined by commas and of the decoded text.

    A null text counts as empty: no token, empty decoding.  Rows and their
    repetitions are kept; equal names in docs are replaced.
    """

    def start() -> Callable:
        pairs = loaded(vocabulary)

        def compute(texts: pa.Array) -> list:
            found: dict[str, list] = {name: [] for name in OUTPUTS}
            for scalar in texts:
                ids, listed = pairs.encode_listed(scalar.as_py() or "")
                back = pairs.decode(ids).decode("utf-8", "replace")
                values = len(ids), ids, back, sha256(listed.encode()).hexdigest(), sha256(back.encode()).hexdigest()
                for name, value in zip(OUTPUTS, values, strict=True):
                    if name in outputs:
                        found[name].append(value)
            return [found[name] for name in outputs]

        compute.close = pairs.forget
        return compute

    return add_columns(docs, [text], [T.StructField(name, OUTPUTS[name]) for name in outputs], start, drop=[text] if drop_text else [])


_loaded: dict[str, BytePairs] = {}


def loaded(path: str) -> BytePairs:
    """The vocabulary, read once in each worker process."""
    if path not in _loaded:
        _loaded[path] = BytePairs(path)
    return _loaded[path]
