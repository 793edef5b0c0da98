"""Exact duplicates by deterministic block naming, in DataFrame functions only.

A text is normalised (each run of ASCII white space becomes one space) and cut into blocks of a fixed
number of UTF-8 bytes. All distinct blocks of the corpus are sorted and numbered: a block's name is its
place. Then adjacent names are paired, the distinct pairs sorted and numbered anew, and so on until
each document has one name: two documents have the same name of the same level if and only if their
bytes are the same.

Blocks are sorted by a 64-bit hash and, among blocks of one hash, by their bytes. The distinct blocks are
shuffled once, after map-side grouping; documents carry hashes, and each hash is checked to belong to
one block. For those that do not, `tie` is a block's place among the blocks of its hash, told by its bytes. So
hashes only route, and no collision of theirs joins two texts.

Every row has one row of result. Of equal texts the row with the smallest id stays; ids that are null come
last, and of rows with one id one stays. A null text counts as empty, and all empty texts are equal.
Texts are taken whole, however long: a text of 2**k blocks takes k rounds, in which only texts of more
blocks than 2**(round - 1) take part. Rows of a group are never gathered: groups are counted by
aggregates, and joins on names have plain exchanges on both sides, which adaptive execution splits
where a name is hot. An empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm.common import cut, small, table
from auralake.operators.numbering import numbered

SPACE = r"[\x20\x09-\x0D]+"
#: UTF-8 bytes of a block.
BLOCK_BYTES = 4096


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def blocks_of(text: Column, size: int) -> Column:
    """The blocks of a text's bytes; an empty text is one empty block."""
    data = text.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(text) / size).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * size + 1, F.lit(size)))


def name_blocks(blocks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(h, tie, name) of all distinct blocks in the order of h and bytes; and (h, block, tie) of hashes with several blocks, None if there are none."""
    held = cut(blocks.groupBy("h", "block").agg(F.lit(1).alias("one")).select("h"))
    crowded = held.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    if crowded.isEmpty():
        return numbered(held.select("h", F.lit(0).alias("tie")), ["h", "tie"], "name", unique=True), None
    ties = blocks.join(small(cut(crowded)), "h", "left_semi").groupBy("h", "block").agg(F.lit(1).alias("one"))
    ties = cut(ties.select("h", "block", (F.row_number().over(Window.partitionBy("h").orderBy("block")) - 1).alias("tie")))
    keys = held.distinct().select("h", F.lit(0).alias("tie")).union(ties.where("tie > 0").select("h", "tie"))
    return numbered(keys, ["h", "tie"], "name", unique=True), ties


def name_texts(places: DataFrame, names: DataFrame) -> DataFrame:
    """(row, level, name) of each row of places (row, pos, n, h, tie), n the number of its blocks."""
    here = cut(places.join(names, ["h", "tie"]).select("row", "pos", "n", "name"))
    found = here.where("n = 1").select("row", F.lit(0).alias("level"), "name")
    longest = here.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    for level in range(1, (longest - 1).bit_length() + 1):
        left, right = F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))), F.max(F.when(F.col("pos") % 2 == 1, F.col("name")))
        paired = here.where("n > 1").groupBy("row", F.floor(F.col("pos") / 2).cast("int").alias("pos"))
        # The last name of an odd number is paired with none.
        pairs = paired.agg(F.ceil(F.first("n") / 2).cast("int").alias("n"), left.alias("a"), F.coalesce(right, F.lit(-1)).alias("b"))
        own = numbered(pairs.select("a", "b").distinct(), ["a", "b"], "name", unique=True)
        here = cut(pairs.join(own, ["a", "b"]).select("row", "pos", "n", "name"))
        found = found.union(here.where("n = 1").select("row", F.lit(level).alias("level"), "name"))
    return found


def exact_dups(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and the level and name that are the text's identity, for every row of docs."""
    own = normalised(F.col(text))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("doc_id"), own.alias("text"))
    blocks = docs.select(F.explode(blocks_of(own, size)).alias("block")).select(hashed(F.col("block")).alias("h"), "block")
    names, ties = name_blocks(blocks)
    cells = rows.select("row", "doc_id", F.sha2("text", 256).alias("sha"), blocks_of(F.col("text"), size).alias("blocks"))
    cells = cells.select("row", "doc_id", "sha", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    first = lambda c: F.when(F.col("pos") == 0, F.col(c)).alias(c)
    cells = cells.select("row", first("doc_id"), first("sha"), "n", "pos", hashed(F.col("block")).alias("h"), "block")
    if ties is not None:
        cells = cells.join(small(ties), ["h", "block"], "left")
    places = cut(cells.select("row", "doc_id", "sha", "n", "pos", "h", (F.coalesce("tie", F.lit(0)) if ties is not None else F.lit(0)).alias("tie")))
    found = name_texts(places.select("row", "pos", "n", "h", "tie"), names)
    named = cut(places.where("pos = 0").select("row", "doc_id", "sha").join(found, "row"))
    rank = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    groups = cut(named.groupBy("level", "name").agg(F.min(rank).alias("head"), F.count("*").alias("size")).where("size > 1"))
    out = named.join(small(groups), ["level", "name"], "left")
    return out.select(
        "doc_id",
        F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("head.row") == F.col("row"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "level",
        "name",
    )


def op11_exact_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dups(table(spark, sf_dir, "documents")).drop("level", "name")


QUERIES = {"op11_exact_dups": op11_exact_dups}
ORACLES = {
    "op11_exact_dups": r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT doc_id, t, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept
  FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, group_size, kept, sha256(t) AS text_sha256 FROM g"""
}
