"""Fill-in-middle by a two-pass streaming matcher in constant memory.

A text is seen as units, the matches of a pattern from left to right; the default takes each code point
for one. The first pass goes through the matches and counts them. Two ranks, drawn from a hash of the id, say
where prefix and middle end; the second pass advances a lazy iterator of matches to the lower rank and on to
the higher, and reads where these matches end. Neither pass stores units: of a text there is the text,
one match and the output.

Forms: plain gives the text; psm `<P>`prefix`<S>`suffix`<M>`middle; spm `<S>`suffix`<P>`prefix`<M>`middle.
Empty texts, texts that hold one of the markers and a share of the others stay plain. A null text counts
as empty; a null id is hashed as no digits. What lies before the first unit belongs to the first part that
is not empty, what lies after a unit to the part after it, so that nothing is lost where a pattern
leaves gaps. Rows are independent: repeated rows repeat their results, an empty table gives none, and no
shuffle takes place. Other columns are dropped from the result unless named in `keep`. Batches go through
Python in slices of 64 rows, so that a task holds the Arrow batch and 64 outputs.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auralake.llm.common import table

UNIT = r"(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts that could be cut, these many are; of 100 that are, these many have their suffix first.
CUT_SHARE, SUFFIX_FIRST_SHARE = 90, 20


_MADE = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


def count_units(unit: re.Pattern, text: str) -> int:
    """How many units a text has, by going through its matches."""
    n = count()
    deque(zip(unit.finditer(text), n, strict=False), maxlen=0)
    # zip asks the matches first: the counter has been asked once for each of them.
    return next(n)


def borders(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Where units number `low` and `high` (from 1; 0: the start) end, low <= high, by one lazy iterator."""
    matches = unit.finditer(text)
    first = next(islice(matches, low - 1, None)).end() if low else 0
    second = next(islice(matches, high - low - 1, None)).end() if high > low else first
    return first, second


def cut_text(unit: re.Pattern, text: str, h: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, str]:
    """n, form, prefix_chars, middle_chars and output of one text; h: four numbers of the row's hash."""
    n = count_units(unit, text)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h[2] % 100 >= CUT_SHARE:
        return n, "plain", None, None, text
    a, b = borders(unit, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    if h[3] % 100 < SUFFIX_FIRST_SHARE:
        return n, "spm", a, b - a, f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    return n, "psm", a, b - a, f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"


def hash_numbers(id: Column, salt: str = "1:") -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of the SHA-256 of salt and id."""
    digits = F.sha2(F.concat(F.lit(salt), F.coalesce(id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digits, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def fill_in_middle(docs: DataFrame, id: str = "doc_id", text: str = "text", unit: str = UNIT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n, form, prefix_chars, middle_chars and output for every row of docs."""
    rows = docs.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text), F.lit("")).alias("text"), *hash_numbers(F.col(id)))
    own = [f for f in rows.schema.fields if f.name.startswith("k")]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = re.compile(unit)
        for whole in batches:
            for i in range(0, whole.num_rows, 64):
                batch = whole.slice(i, 64)
                hs = zip(*(batch.column(f"h{j}").to_pylist() for j in (1, 2, 3, 4)), strict=True)
                done = [cut_text(units, t.as_py(), h) for t, h in zip(batch.column("text"), hs, strict=True)]
                n, form, prefix, middle, output = zip(*done, strict=True)
                found = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
                yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in own), *found], names=[*(f.name for f in own), *_MADE.fieldNames()])

    out = rows.mapInArrow(made, T.StructType([*own, *_MADE.fields]))
    return out.withColumnsRenamed({f.name: c for f, c in zip(own, keep, strict=True)})


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    No part holds a marker, and none can arise where a part meets one, as a marker begins with what ends no other.
    """
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda *order: F.concat(*(F.get(parts, i) for i in order))
    return F.when(form == "psm", part(1, 3, 2)).when(form == "spm", part(2, 3, 1)).otherwise(output)


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


QUERIES = {"op12_infill": op12_infill}
ORACLES = {
    "op12_infill": """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substring(t, 1, a) AS prefix, substring(t, a + 1, b - a) AS middle, substring(t, b + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
}
