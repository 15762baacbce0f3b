"""Problem 8: encode a corpus by a public byte-level BPE vocabulary.

A backtracking encoder: an Aho-Corasick automaton over the vocabulary gives the
longest token at each byte; a token is kept if the pair it forms with its left
neighbour is one that the merges can leave side by side, else the next shorter
prefix is tried, else the neighbour is given up. Each byte position is given up at
most once, so the work is linear, and the result is what running all merges gives.

Defined results: null and empty texts give an empty list; strings of special
tokens are ordinary text; repeated rows are encoded one by one.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The pre-token pattern of the vocabulary and its byte alphabet (printable bytes stand for themselves).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
REMEMBERED = 200_000  # pre-tokens an encoder keeps with their ids; more are encoded anew


def _byte_letters() -> dict[str, int]:
    hidden = iter(range(256, 512))
    return {chr(b) if b in PRINTABLE else chr(next(hidden)): b for b in range(256)}


class Encoder:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, content: str):
        model = json.loads(content)["model"]
        letters = _byte_letters()
        raw = lambda t: bytes(letters[c] for c in t)
        ids = model["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.parts = {i: (i, i) for i in ids.values()}
        self.rank = {i: -1 for i in ids.values()}
        self.merged: dict[tuple[int, int], int] = {}
        self.bytes: dict[int, bytes] = {ids[c]: bytes([b]) for c, b in letters.items()}
        for at, (a, b) in enumerate(merges):
            whole = ids[a + b]
            self.merged[ids[a], ids[b]] = whole
            if whole not in self.bytes:
                self.parts[whole], self.rank[whole] = (ids[a], ids[b]), at
                self.bytes[whole] = raw(a + b)
        by_bytes = {v: k for k, v in self.bytes.items()}
        self.shorter = {}
        for token, data in self.bytes.items():
            n = len(data) - 1
            while n and data[:n] not in by_bytes:
                n -= 1
            self.shorter[token] = by_bytes.get(data[:n], -1) if n else -1
        self.machine = ahocorasick.Automaton()
        for data, token in by_bytes.items():
            self.machine.add_word(data.decode("latin-1"), (len(data), token))
        self.machine.make_automaton()
        self.by_bytes, self.fits, self.seen = by_bytes, {}, {}
        order = sorted(self.bytes)
        self.offsets = np.zeros(max(order) + 2, dtype=np.int64)
        for token in order:
            self.offsets[token + 1] = len(self.bytes[token])
        self.offsets = np.cumsum(self.offsets)
        self.blob = b"".join(self.bytes[t] for t in order)
        self.pattern = regex.compile(PATTERN)

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both tokens leaves exactly these two; remembered pair by pair."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.merged.get((left, right)) is None and self._apart(left, right, len(self.rank))
            if len(self.fits) < REMEMBERED:
                self.fits[left, right] = known
        return known

    def _apart(self, left: int, right: int, until: int) -> bool:
        """Whether no merge crosses the border of two tokens before the merge of that rank.

        Walks back in time over the pieces that meet at the border, undoing the later
        of their last merges. A crossing comes first if its rank is below that of the
        left piece's next merge and not above that of the right one's, as equal merges
        run from left to right.
        """
        next_left = next_right = until
        while self.rank[left] >= 0 or self.rank[right] >= 0:
            if self.rank[left] > self.rank[right]:
                next_left, left = self.rank[left], self.parts[left][1]
            else:
                next_right, right = self.rank[right], self.parts[right][0]
            crossing = self.merged.get((left, right))
            if crossing is not None and self.rank[crossing] < next_left and self.rank[crossing] <= next_right:
                return False
        return True

    def word(self, data: bytes) -> list[int]:
        """The ids of one pre-token."""
        whole = self.by_bytes.get(data)
        if whole is not None and self._reached(whole):
            return [whole]
        n = len(data)
        longest = [-1] * n
        size = [0] * n
        for end, (length, token) in self.machine.iter(data.decode("latin-1")):
            start = end - length + 1
            if length > size[start]:
                size[start], longest[start] = length, token
        out: list[int] = []
        open_ = bytearray(b"\x01") * (n + 1)
        at, token = 0, longest[0]
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                end = at + len(self.bytes[token])
                if open_[end] and (last < 0 or self.compatible(last, token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:
                open_[at] = 0
                token = out.pop()
                at -= len(self.bytes[token])
                token = self.shorter[token]
        return out

    def _reached(self, token: int) -> bool:
        """Whether the merges make this token out of its own bytes."""
        a, b = self.parts[token]
        return a == b == token or (self._reached(a) and self._reached(b) and self._apart(a, b, self.rank[token]))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; [] of None."""
        out: list[int] = []
        seen = self.seen
        for piece in self.pattern.findall(text or ""):
            ids = seen.get(piece)
            if ids is None:
                ids = self.word(piece.encode("utf-8", "surrogatepass"))
                if len(seen) < REMEMBERED:
                    seen[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids, by the offset table."""
        o, blob = self.offsets, self.blob
        return b"".join(blob[o[i] : o[i + 1]] for i in ids).decode("utf-8", "surrogatepass")


_encoders: dict[str, Encoder] = {}


def _encoder(path: str, content) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(content.value)
    return _encoders[path]


def token_ids(df: DataFrame, text: str, vocabulary: str = VOCABULARY) -> Column:
    """A column of the text's ids. The vocabulary file (some 1.5 MB, whatever the corpus) is read once and broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("array<int>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(vocabulary, content)
        for texts in batches:
            yield pd.Series([encoder.encode(t) for t in texts])

    return encode(F.col(text))


def decoded(df: DataFrame, ids: str, vocabulary: str = VOCABULARY) -> Column:
    """A column of the text that ids stand for."""
    with open(vocabulary, encoding="utf-8") as f:
        content = df.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = _encoder(vocabulary, content)
        for rows in batches:
            yield pd.Series([None if r is None else encoder.decode(r) for r in rows])

    return decode(F.col(ids))
