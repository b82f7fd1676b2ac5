"""Byte-level BPE over a table of ranks, by prefix dynamic programming.

Of the tokens that end where a prefix ends, exactly one can be the last token of the
prefix's encoding: the one that may follow the last token of the prefix before it.
So one number for each prefix holds the encodings of all prefixes.  Bytes are appended
by computing their prefixes alone; after an edit, prefixes are computed again until as
many in a row as the longest token has bytes agree with those before, since all that
follow then agree too.

A text is cut by the pattern of the vocabulary first, and its matches are encoded one
by one.  A match that is a token is that token.
"""

from __future__ import annotations

import base64
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

#: Matches in each of a worker's two memories: beyond it, the newer becomes the
#: older, from which what is used again comes back.
REMEMBERED = 140_000
#: Pairs of tokens in a worker's table of those that may follow each other; a full one
#: starts anew.
PAIRS = 1 << 19
#: Characters beyond its end that decide where a match of the pattern ends.
AHEAD = 2


class Ranks:
    """One vocabulary: tokens in the order in which they were merged."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as file:
            self.rank = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        count = 1 + max(self.rank.values())
        self.token = [b""] * count
        for token, rank in self.rank.items():
            self.token[rank] = token
        if any(bytes([b]) not in self.rank for b in range(256)):
            raise ValueError("the vocabulary lacks a byte")
        self.longest = max(map(len, self.token))
        merged = min((r for t, r in self.rank.items() if len(t) > 1), default=count)
        if any(self.rank[bytes([b])] > merged for b in range(256)):
            raise ValueError("bytes must rank before what is merged")
        lengths = np.fromiter(map(len, self.token), np.int64, count)
        self.size = lengths.tolist()
        self._lengths, self._offsets = lengths, np.concatenate([[0], np.cumsum(lengths)])
        self._pool = np.frombuffer(b"".join(self.token), np.uint8)
        self._follows: dict[int, bool] = {}
        self._parts: dict[int, tuple[int, int]] = {}
        self._ends = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self._ends.add_word(token.decode("latin-1"), rank)
        self._ends.make_automaton()
        self.cut = regex.compile(pattern)
        self._whole: dict[str, bytes] = {}
        for token, rank in self.rank.items():
            try:
                self._whole[token.decode()] = array("I", [rank]).tobytes()
            except UnicodeDecodeError:
                continue
        self.forget()

    def forget(self) -> None:
        """Let go of what was remembered of texts."""
        self._older, self._known = {}, dict(self._whole)

    def ends(self, data: bytes):
        """(last place, token) of all tokens in data, by place."""
        return self._ends.iter(data.decode("latin-1"))

    def _made_of(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge is the last to make this one; of a byte, and of
        a token that merging its bytes doesn't give, itself twice."""
        found = self._parts.get(token)
        if found is None:
            parts, rank = [bytes([b]) for b in self.token[token]], self.rank
            while len(parts) > 2:
                best, at = min((rank.get(a + b, len(self.token)), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
                if best == len(self.token):
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            found = self._parts[token] = (rank[parts[0]], rank[parts[1]]) if len(parts) == 2 else (token, token)
        return found

    def stands(self, token: int) -> bool:
        """Whether merging the token's bytes gives the token."""
        return self.size[token] == 1 or self._made_of(token)[0] != token

    def _border_stays(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both by rank ends in just these two.  Their
        merges are undone from the last; at each moment, the parts at the border must
        not have a merge that comes before the next one that makes left or right."""
        if not (self.stands(left) and self.stands(right)):
            return False
        rank, token, next_merge = self.rank, self.token, len(self.token)
        while True:
            joint = rank.get(token[left] + token[right])
            if joint is not None and joint < next_merge:
                return False
            if self.size[left] == self.size[right] == 1:
                return True
            # of two merges of the same rank, the left one comes first
            if left > right:
                next_merge, left = left, self._made_of(left)[1]
            else:
                next_merge, right = right + 1, self._made_of(right)[0]

    def follows(self, left: int, right: int) -> bool:
        """Whether right may come after left, by a table that fills as pairs occur."""
        key = left * len(self.size) + right
        found = self._follows.get(key)
        if found is None:
            if len(self._follows) >= PAIRS:
                self._follows.clear()
            found = self._follows[key] = self._border_stays(left, right)
        return found

    def encode_match(self, data: bytes) -> list[int]:
        """The tokens of one match of the pattern."""
        whole = self.rank.get(data)
        return [whole] if whole is not None else Prefixes(self, data).tokens()

    def _look_up(self, match: str) -> bytes:
        found = self._known.get(match) or self._older.get(match)
        if found is None:
            found = array("I", self.encode_match(match.encode())).tobytes()
        if len(self._known) >= REMEMBERED + len(self._whole):
            self._older, self._known = self._known, dict(self._whole)
        self._known[match] = found
        return found

    def encode_bytes(self, text: str) -> bytes:
        """The tokens of a text as little-endian numbers of four bytes."""
        get, look_up = self._known.get, self._look_up
        return b"".join([get(m) or look_up(m) for m in self.cut.findall(text)])

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_bytes(text), np.uint32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of all tokens in a row, gathered by their offsets."""
        if not len(ids):
            return b""
        lengths = self._lengths[ids]
        ends = np.cumsum(lengths)
        source = np.arange(ends[-1]) + np.repeat(self._offsets[ids] - ends + lengths, lengths)
        return self._pool[source].tobytes()


class Prefixes:
    """Bytes that grow and change, with the last token of each of their prefixes."""

    def __init__(self, ranks: Ranks, data: bytes = b""):
        self._ranks, self.data, self._last = ranks, bytearray(), array("i")
        self.append(data)

    def _compute(self, data: bytes, last: array, begin: int, old: array | None = None, kept: int = 0) -> int:
        """Extend last from ``begin`` prefixes to all of data.  If, from ``kept`` on,
        enough in a row equal the same places of old, counted from the end, the rest
        is copied from it.  The number computed."""
        size, follows, stands, longest = self._ranks.size, self._ranks.follows, self._ranks.stands, self._ranks.longest
        back = max(0, begin - longest)
        shift = len(old) - len(data) if old is not None else 0
        same = 0
        for end, token in self._ranks.ends(data[back:]):
            end += back + 1
            if end <= len(last):
                continue
            begins = end - size[token]
            if follows(last[begins - 1], token) if begins else stands(token):
                last.append(token)
                if old is not None and end > kept:
                    same = same + 1 if old[end + shift - 1] == token else 0
                    if same >= longest:
                        last.extend(old[end + shift :])
                        return end - begin
        return len(data) - begin

    def append(self, more: bytes) -> int:
        """Bytes at the end; how many prefixes were computed."""
        begin = len(self.data)
        self.data += more
        return self._compute(bytes(self.data), self._last, begin)

    def edit(self, at: int, removed: int, inserted: bytes = b"") -> int:
        """Other bytes in place of some; how many prefixes were computed."""
        old, self._last = self._last, self._last[:at]
        self.data[at : at + removed] = inserted
        return self._compute(bytes(self.data), self._last, at, old, at + len(inserted))

    def tokens(self, length: int | None = None) -> list[int]:
        """The tokens of all bytes, or of so many from the start."""
        found, at = [], len(self.data) if length is None else length
        while at > 0:
            found.append(self._last[at - 1])
            at -= self._ranks.size[found[-1]]
        return found[::-1]


class Encoded:
    """A text with its matches and their tokens, for edits."""

    def __init__(self, ranks: Ranks, text: str):
        self._ranks, self.text = ranks, text
        self._ends, self._tokens = self._matches(text, 0, None)

    def _matches(self, text: str, at: int, old: dict[int, int] | None) -> tuple[list[int], list[bytes]]:
        ends, tokens, ranks = [], [], self._ranks
        for match in ranks.cut.finditer(text, at):
            ends.append(match.end())
            tokens.append(ranks._known.get(match.group()) or ranks._look_up(match.group()))
            if old is not None and match.end() in old:
                break
        return ends, tokens

    def edit(self, at: int, removed: int, inserted: str = "") -> int:
        """Characters in place of some; how many matches were made anew.  Those that
        the edit can't reach stay, and so do all from the first common border on."""
        before = sum(e <= at - AHEAD for e in self._ends)
        start = self._ends[before - 1] if before else 0
        shift = len(inserted) - removed
        after = {e + shift: k for k, e in enumerate(self._ends) if e >= at + removed}
        self.text = self.text[:at] + inserted + self.text[at + removed :]
        # a border before what was inserted ends may be one by chance only
        later = {e: k for e, k in after.items() if e >= at + len(inserted)}
        ends, tokens = self._matches(self.text, start, later)
        rest = later[ends[-1]] + 1 if ends and ends[-1] in later else len(self._ends)
        self._ends = self._ends[:before] + ends + [e + shift for e in self._ends[rest:]]
        self._tokens = self._tokens[:before] + tokens + self._tokens[rest:]
        return len(ends)

    def ids(self) -> np.ndarray:
        return np.frombuffer(b"".join(self._tokens), np.uint32)


#: What with_rank_tokens can add.
OUTPUTS = {
    "n_tokens": T.LongType(),
    "token_ids": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}

_loaded: dict[tuple[str, str], Ranks] = {}


def loaded(path: str, pattern: str) -> Ranks:
    """The vocabulary, read once in each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Ranks(path, pattern)
    return _loaded[path, pattern]


def with_rank_tokens(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", outputs: Sequence[str] = ("n_tokens", "token_ids", "decoded"), drop_text: bool = False, edits: str | None = None) -> DataFrame:
    """docs with some of OUTPUTS: the number of tokens, their ids, the bytes that they
    decode to, and SHA-256 digests in lowercase hex of the ids as little-endian
    numbers of four bytes and of the decoded bytes.

    ``edits`` names a column of arrays of (at, removed, inserted), in characters, that
    are applied to the text one after the other before the tokens are given; only what
    an edit touches is encoded again.  Places beyond the text mean its end.

    A null or empty text has no token, null edits are none.  Rows and their
    repetitions are kept; equal names in docs are replaced; an empty table gives one.
    """

    def start() -> Callable:
        ranks = loaded(vocabulary, pattern)

        def encoded(text: str, changes: list[dict] | None) -> bytes:
            if not changes:
                return ranks.encode_bytes(text)
            whole = Encoded(ranks, text)
            for change in changes:
                if change is not None:
                    at = min(max(change["at"] or 0, 0), len(whole.text))
                    whole.edit(at, min(max(change["removed"] or 0, 0), len(whole.text) - at), change["inserted"] or "")
            return whole.ids().tobytes()

        def compute(texts: pa.Array, changes: pa.Array | None = None) -> list:
            found: dict[str, list] = {name: [] for name in OUTPUTS}
            for k, scalar in enumerate(texts):
                listed = encoded(scalar.as_py() or "", changes[k].as_py() if changes is not None else None)
                ids = np.frombuffer(listed, np.uint32)
                back = ranks.decode(ids)
                values = len(ids), ids.astype(np.int32), back, sha256(listed).hexdigest(), sha256(back).hexdigest()
                for name, value in zip(OUTPUTS, values, strict=True):
                    if name in outputs:
                        found[name].append(value)
            return [found[name] for name in outputs]

        compute.close = ranks.forget
        return compute

    inputs = [text] if edits is None else [text, edits]
    return add_columns(docs, inputs, [T.StructField(name, OUTPUTS[name]) for name in outputs], start, drop=[text] if drop_text else [])
