"""Token counts by the whole-token shortcut.

Offline, once on the driver, every string of the vocabulary that closes a word is put through the
merges alone; those that come out as one token are the whole tokens. A pre-token found among them
counts 1 without any merging; only the rest is merged, with a bounded memo.

Normaliser and pre-tokeniser are done here by one compiled pattern for texts whose code points are
all below U+0250, where the classes are spelled out; tests compare each of those code points with
the library. Any other text goes through the library's own normaliser and pre-tokeniser, and a text
that holds the string of a special token through the whole library.

Nulls and empty texts have 0 tokens. Texts are never cut; a pre-token of any length is merged whole.
Other columns of the input are dropped from the result unless named in `keep`.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from auralake.llm.common import table

VOCABULARY = "word_bpe_49k.json"
#: Code points below this are normalised and split here.
KNOWN = 0x250
#: Entries of the memo for merged pre-tokens and the longest that enters it.
MEMO, MEMO_CHARS = 500_000, 48

_SPACE = "\\t-\\r \x85\xa0"
#: The known characters and what they become in lower case, which may lie above.
_known = sorted({x for c in range(KNOWN) for x in chr(c) + chr(c).lower()})
_LETTERS = "".join(c for c in _known if unicodedata.category(c)[0] == "L")
_NUMBERS = "".join(c for c in _known if unicodedata.category(c)[0] == "N")
#: A contraction starts with an apostrophe and so with neither letter nor number: the order of these does not matter.
_PRETOKEN = re.compile(f"[{_LETTERS}]+|[{_NUMBERS}]|'(?:[stmd]|re|ve|ll)|[^{_SPACE}{_LETTERS}{_NUMBERS}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_UNKNOWN = re.compile(f"[^\\x00-{chr(KNOWN - 1)}]")


def byte_letters() -> dict[int, str]:
    """The byte alphabet of byte-level BPE: printable bytes stand for themselves, others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def whole_tokens(tokenizer: Tokenizer, suffix: str = "</w>") -> frozenset[str]:
    """The pre-tokens, as plain text, that the merges make one token of when they stand alone."""
    back = {c: b for b, c in byte_letters().items()}
    found = set()
    for entry in tokenizer.get_vocab(with_added_tokens=False):
        body = entry.removesuffix(suffix)
        if body == entry or not body or any(c not in back for c in body):
            continue
        if len(tokenizer.model.tokenize(body)) == 1:
            try:
                found.add(bytes(back[c] for c in body).decode())
            except UnicodeDecodeError:
                continue
    return frozenset(found)


class Counts(dict):
    """Tokens of a run of text between white space: whole tokens at 1 for good, other runs as they come."""

    def __init__(self, whole: frozenset[str], tokenizer: Tokenizer):
        super().__init__(dict.fromkeys(whole, 1))
        self.whole, self.model, self.letters = whole, tokenizer.model, byte_letters()

    def merged(self, pretoken: str) -> int:
        plain = pretoken.isascii() and pretoken.isprintable()
        return len(self.model.tokenize(pretoken if plain else "".join(map(self.letters.__getitem__, pretoken.encode()))))

    def __missing__(self, run: str) -> int:
        n = sum(1 if pretoken in self.whole else self.merged(pretoken) for pretoken in _PRETOKEN.findall(run))
        if len(run) <= MEMO_CHARS:
            if len(self) >= len(self.whole) + MEMO:
                self.clear()
                self.update(dict.fromkeys(self.whole, 1))
            self[run] = n
        return n


class Counter:
    """Counts tokens of texts as the library does; one per task."""

    def __init__(self, path: str, whole: frozenset[str]):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)")
        self.counts = Counts(whole, self.tokenizer)

    def count(self, text: str) -> int:
        if "<|" in text and self.special.search(text):
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        if not text.isascii() and _UNKNOWN.search(text):
            pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))
            return sum(len(self.tokenizer.model.tokenize(piece)) for piece, _ in pieces)
        if _SEPARATORS.search(text):  # white space to str.split(), not to the tokenizer
            return sum(self.counts[p] for p in _PRETOKEN.findall(text.lower()))
        return sum(map(self.counts.__getitem__, text.lower().split()))


def count_tokens(docs: DataFrame, text: str = "text", path: str | None = None, limit: int = 2048, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_bytes, n_tokens and over_limit (n_tokens > limit) for every row of docs, without a shuffle."""
    path = path or public_tokenizers.path(VOCABULARY)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(Tokenizer.from_file(path)))  # bounded by the vocabulary
    rows = docs.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kept = [f for f in rows.schema.fields if f.name != "__text"]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path, whole.value)
        for batch in batches:
            texts, n = batch.column("__text"), []
            for i in range(0, len(texts), 64):
                n += [counter.count(t) for t in texts.slice(i, 64).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(n, pa.int64())], names=[*(f.name for f in kept), "n_tokens"])

    schema = type(rows.schema)(list(kept)).add("n_tokens", "long", False)
    return rows.mapInArrow(counted, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
ORACLES: dict[str, str] = {}
