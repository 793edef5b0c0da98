"""A subword tokenizer: byte-level pair merges in the order of their ranks, from a vocabulary file.

A text is cut into pre-tokens by a pattern, a pre-token into bytes, and of all adjacent pairs the one of the lowest
rank is merged, the leftmost first, until no pair is in the vocabulary. Pairs wait in a heap by (rank, place); what a
merge leaves behind is told by the links between parts, so a pre-token of n bytes takes n log n steps, however long it is.
Special tokens are not looked for: their strings are text like any other.

Two forms of file are read: JSON with a vocabulary and its merges, in which bytes are written as letters, and
lines of a token in base64 and its rank.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

import regex
from pyspark import SparkFiles
from pyspark.sql import SparkSession

from auralake.sources.stores import store

#: The pattern of pre-tokens that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens whose ids are kept, and the longest of them.
MEMO, MEMO_BYTES = 100_000, 48


@dataclass(frozen=True)
class Vocabulary:
    """ids of tokens by their bytes, and (rank, id) of what two adjacent ids merge to."""

    ids: dict[bytes, int]
    merges: dict[tuple[int, int], tuple[int, int]]


def letters() -> dict[str, int]:
    """The letter that stands for each byte: printable bytes for themselves, the others from U+0100 on in turn."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    found, next_ = {}, 256
    for b in range(256):
        found[chr(b) if b in plain else chr(next_)] = b
        next_ += b not in plain
    return found


def from_json(content: bytes) -> Vocabulary:
    model, back = json.loads(content)["model"], letters()
    ids = {bytes(back[c] for c in t): i for t, i in model["vocab"].items() if all(c in back for c in t)}
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        a, b = (bytes(back[c] for c in t) for t in (pair.split(" ") if isinstance(pair, str) else pair))
        merges[ids[a], ids[b]] = (rank, ids[a + b])
    return Vocabulary(ids, merges)


def from_ranks(content: bytes) -> Vocabulary:
    """Any two tokens merge whose bytes together are a token; its rank is its id."""
    ids = {base64.b64decode(t): int(i) for t, i in (line.split() for line in content.splitlines() if line)}
    merges = {}
    for token, i in ids.items():
        for k in range(1, len(token)):
            if token[:k] in ids and token[k:] in ids:
                merges[ids[token[:k]], ids[token[k:]]] = (i, i)
    return Vocabulary(ids, merges)


def read(path: str) -> Vocabulary:
    """The vocabulary of a file of any store."""
    where, own = store(path)
    with where.open_input_stream(own) as f:
        content = f.read()
    return from_json(content) if content.lstrip()[:1] == b"{" else from_ranks(content)


class PairTokenizer:
    def __init__(self, vocabulary: Vocabulary, pattern: str = PATTERN):
        self.merges, self.first = vocabulary.merges, [vocabulary.ids[bytes([b])] for b in range(256)]
        self.tokens = {i: t for t, i in vocabulary.ids.items()}
        self.pattern, self.memo = regex.compile(pattern), {}

    def merged(self, piece: bytes) -> list[int]:
        """The ids of one pre-token."""
        own = [self.first[b] for b in piece]
        n = len(own)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        waiting = []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and (found := self.merges.get((own[i], own[j]))):
                heapq.heappush(waiting, (found[0], i, own[i], own[j], found[1]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, left, right, made = heapq.heappop(waiting)
            j = after[i]
            # A part that has merged since is told by its id; one that is gone has none.
            if own[i] != left or j < 0 or own[j] != right:
                continue
            own[i], own[j], after[i] = made, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            if before[i] >= 0:
                offer(before[i])
            offer(i)
        return [t for t in own if t >= 0]

    def encode(self, text: str) -> list[int]:
        out = []
        for found in self.pattern.finditer(text):
            piece = found.group().encode()
            ids = self.memo.get(piece)
            if ids is None:
                ids = self.merged(piece)
                if len(piece) <= MEMO_BYTES:
                    if len(self.memo) >= MEMO:
                        self.memo.clear()
                    self.memo[piece] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; ids that are none of the vocabulary are left out, bytes that are no UTF-8 become U+FFFD."""
        return b"".join(self.tokens.get(i, b"") for i in ids).decode(errors="replace")


def _made(name: str, pattern: str) -> PairTokenizer:
    return PairTokenizer(read(SparkFiles.get(name)), pattern)


def shared(spark: SparkSession, path: str, pattern: str = PATTERN) -> Callable[[], PairTokenizer]:
    """A factory for the model steps: Spark hands the file to every executor, whichever store it lies in."""
    spark.sparkContext.addFile(path)
    return partial(_made, path.rstrip("/").rsplit("/", 1)[-1], pattern)
