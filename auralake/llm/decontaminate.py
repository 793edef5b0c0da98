"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame functions only.

Words are runs of letters and digits in lower case; shingles are runs of five words (a text of fewer
words is one shingle of all of them, so an item of under five words is found where it is the whole
text). A window is a frame as long as an item, laid at any place over a document; at the document's ends
it holds what is there, so a document that begins or ends within an item is seen, too.

1. A window that holds t shingles of items of its length, out of c, has a similarity of at most
   t / (c + m - t) to one of m shingles. All windows for which this reaches the threshold go on: those
   that are left out cannot be contaminated, whatever the fingerprints say. They are found from the
   sorted places of such shingles, each start once, without going over the others.
2. Every window that is left has a fingerprint of 256 bits, each the sign of a sum over its shingles.
   Fingerprints are cut into 16 blocks of 16 bits. Two that differ in at most RADIUS = 63 bits differ in
   at most 3 bits in some block: items are stored under all values within 2 bits of a block's and
   windows ask for all within 1 bit, so the join on (item, block, value) finds every pair within the
   radius, and is the only source of pairs. At 0.8 some 39 bits differ, with a deviation of 6. A window asks
   for the items that it shares an anchor with: of an item's m shingles one of 0.8 similarity lacks at most
   m - ceil(0.8 * m), so it holds one of any m - ceil(0.8 * m) + 1 of them; the rarest among items
   are its anchors. No pair that can be verified is lost by this, and what the join makes grows with the windows
   times the items that are like them, not with all items of their length.
3. Pairs left after the exact Hamming distance are verified by the weighted Jaccard similarity of their
   shingles, each weighted by its number of occurrences: 0.8 or more is contamination.

Windows of equal shingles are one, so copies of a passage are verified once. Documents meet the items'
shingles first, and only those few that have windows are read again; no document is cut, however long.

Null and empty texts have no windows and are clean; an empty benchmark leaves all clean. An item of
no words is left out; items may repeat an id or a text. Rows of one id are told apart by their text's
hash and reported under the id, repeated rows once, rows without an id under null. Of equally similar
windows the first counts. Extra columns, whatever their names, are ignored or, in drop_contaminated, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm.common import cut, small, table

SIZE, RADIUS, BLOCKS, BITS = 5, 63, 16, 16
#: Bits turned over in a block's value, on the items' side and on the windows'.
STORED, ASKED = 2, 1
#: The least similarity, as a fraction.
LEAST = (4, 5)


def words(text: Column) -> Column:
    """The words of a text: an empty array if there are none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of SIZE words of the stored column w; one of all words if there are fewer."""
    n = F.size(w)
    runs = F.transform(F.sequence(F.lit(0), n - SIZE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SIZE))))
    none = F.array().cast("array<bigint>")
    return F.when(n >= SIZE, runs).when(n > 0, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(none)


def _bit(hashes: Column, b: int) -> Column:
    """Whether more of the hashes have bit b than have not."""
    return F.aggregate(hashes, F.lit(0), lambda sum_, h: sum_ + F.shiftright(h, b).bitwiseAND(F.lit(1)).cast("int") * 2 - 1) > 0


def fingerprint(hashes: Column) -> Column:
    """SimHash of an array of hashes, as an array of BLOCKS numbers of BITS bits each."""

    def four(own: Column) -> Column:
        value = lambda block: sum((F.when(_bit(own, BITS * block + i), F.lit(1 << i)).otherwise(F.lit(0)) for i in range(BITS)), F.lit(0))
        return F.array(*(value(block) for block in range(64 // BITS)))

    # Each 64 bits are from a hash of their own; inside the lambda it is a value, not an expression.
    salt = lambda j: F.transform(hashes, lambda h: F.xxhash64(h, F.lit(j)))
    return F.flatten(F.transform(F.array(*map(salt, range(BLOCKS * BITS // 64))), four))


def near(value: Column, flips: int) -> Column:
    """All numbers of BITS bits within `flips` bits of value."""
    masks = [0] + [1 << i for i in range(BITS)] + [1 << i | 1 << j for i in range(BITS) for j in range(i)]
    return F.transform(F.array(*(F.lit(m) for m in masks if m.bit_count() <= flips)), lambda m: m.bitwiseXOR(value))


def filed(prints: DataFrame, flips: int, *keep: str) -> DataFrame:
    """keep, block and value, for each value within `flips` bits of a block of the fingerprint fp."""
    blocks = prints.select(*keep, F.posexplode_outer("fp").alias("block", "value"))
    return blocks.select(*keep, "block", F.explode_outer(near(F.col("value"), flips)).alias("value"))


def anchors(items: DataFrame) -> DataFrame:
    """it, n and h: of each item the shingles of which a window of LEAST similarity has one, the rarest first.

    A shingle that an item holds twice counts twice. A window over the shingles of one item ranks them.
    """
    num, den = LEAST
    each = items.select("it", "n", F.size("hs").alias("m"), F.posexplode("hs").alias("place", "h"))
    common = each.groupBy("h").agg(F.count_distinct("it").alias("df"))
    rank = F.row_number().over(Window.partitionBy("it").orderBy("df", "h", "place"))
    ranked = each.join(common, "h").withColumn("rank", rank)
    return ranked.where(F.col("rank") <= F.col("m") - F.ceil(F.col("m") * num / den) + 1).select("it", "n", "h").distinct()


def frames(listed: DataFrame, *keep: str) -> DataFrame:
    """keep, n and start of each window that might reach LEAST.

    listed has, for each text and length n of items, the sorted places of shingles that items of n words
    have (p) and the number of all shingles (s). With need = LEAST * m of m shingles at the least, a window's
    first such shingle is the j-th place only if place j + need - 1 is in it as well: this gives the starts.
    """
    num, den = LEAST
    m = F.greatest(F.col("n") - (SIZE - 1), F.lit(1))
    need = F.floor((m * num + den - 1) / den).cast("int")
    rows = listed.select(*keep, "n", "s", "p", m.alias("m"), need.alias("need")).where(F.size("p") >= F.col("need"))
    rows = rows.select("*", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.size("p") - F.col("need"), F.lit(0)))).alias("j"))
    before = F.when(F.col("j") > 0, F.get("p", F.col("j") - 1)).otherwise(-F.col("m"))
    low = F.greatest(F.get("p", F.col("j") + F.col("need") - 1) - F.col("m"), before) + 1
    rows = rows.select("*", low.alias("low"), F.get("p", "j").alias("high")).where("low <= high")
    rows = rows.select("*", F.explode_outer(F.sequence(F.col("low"), F.greatest("low", "high"))).alias("start"))
    t = F.size(F.filter(F.slice("p", F.col("j") + 1, F.col("m")), lambda x: x < F.col("start") + F.col("m")))
    c = F.least(F.col("start") + F.col("m"), F.col("s")) - F.greatest("start", F.lit(0))
    return rows.where(t * (num + den) >= (c + F.col("m")) * num).select(*keep, "n", "start")


def _found(docs: DataFrame, benchmark: DataFrame, id: str, text: str, item: str, item_text: str) -> DataFrame:
    """doc_id, copy (the text's hash), item_id and the best window b, for each contaminated text and item."""
    items = benchmark.select(F.col(item).alias("item_id"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    items = cut(items.select("item_id", F.size("w").alias("n"), shingles(F.col("w")).alias("hs"), F.monotonically_increasing_id().alias("it")))
    places = cut(items.select("n", F.explode("hs").alias("h")).distinct())
    texts = docs.select(F.col(id).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text")).where(F.length("text") > 0)
    hashed = texts.select("doc_id", "copy", words(F.col("text")).alias("w")).select("doc_id", "copy", shingles(F.col("w")).alias("hs"))

    # The outer form of explode: the plain one has Catalyst push a filter on the array's size below, where
    # the array's definition is put into its own lambda and evaluated for every element.
    # 1. Where a document has shingles of items, and the windows that have enough of them.
    hits = hashed.select("doc_id", "copy", F.size("hs").alias("s"), F.posexplode_outer("hs").alias("place", "h")).join(small(places), "h")
    listed = hits.groupBy("doc_id", "copy", "s", "n").agg(F.array_sort(F.collect_set("place")).alias("p"))
    windows = frames(cut(listed), "doc_id", "copy").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("n", "start")).alias("windows"))
    again = cut(windows.withColumnsRenamed({"doc_id": "d", "copy": "c"}))

    # 2. Their shingles and fingerprints: the few documents with windows meet their texts again.
    own = texts.join(again, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("copy") == F.col("c")))
    own = own.select("doc_id", "copy", "windows", words(F.col("text")).alias("w")).select("doc_id", "copy", "windows", shingles(F.col("w")).alias("hs"))
    found = own.select("doc_id", "copy", "hs", F.explode_outer("windows").alias("v")).where("v.n IS NOT NULL")
    first, end = F.greatest(F.col("v.start"), F.lit(0)), F.col("v.start") + F.greatest(F.col("v.n") - (SIZE - 1), F.lit(1))
    found = found.select("doc_id", "copy", "v.n", first.alias("start"), F.slice("hs", first + 1, end - first).alias("ws"))
    found = cut(found.select("*", F.xxhash64("ws").alias("k1"), F.xxhash64(F.lit(1), "ws").alias("k2")))
    key = ["n", "k1", "k2"]
    prints = found.groupBy(*key).agg(F.first("ws").alias("ws"))
    prints = cut(prints.select(*key, "ws", fingerprint(F.col("ws")).alias("fp")))

    # 3. Blocks: every pair of fingerprints within the radius meets in one of them, under ids alone.
    stored = cut(items.select("it", "n", "hs", fingerprint(F.col("hs")).alias("fp")))
    index = cut(filed(stored, STORED, "it"))
    held = prints.select(*key, "fp", F.explode_outer(F.array_distinct("ws")).alias("h")).join(small(cut(anchors(items))), ["n", "h"])
    asked = cut(held.select(*key, "fp", "it").distinct())
    pairs = cut(filed(asked, ASKED, *key, "it").join(small(index), ["it", "block", "value"]).select(*key, "it").distinct())

    # 4. The exact distance, then the weighted Jaccard similarity: occurrences in common by those in either.
    pairs = pairs.join(prints, key).join(stored.select("it", "hs", F.col("fp").alias("ifp")), "it")
    apart = sum((F.bit_count(F.get("fp", b).bitwiseXOR(F.get("ifp", b))) for b in range(BLOCKS)), F.lit(0))
    common = F.aggregate(F.array_intersect("ws", "hs"), F.lit(0), lambda acc, h: acc + F.least(F.size(F.filter("ws", lambda x: x == h)), F.size(F.filter("hs", lambda x: x == h))))
    whole = F.size("ws") + F.size("hs")
    verified = pairs.where(apart <= RADIUS).select(*key, "it", common.alias("both"), whole.alias("whole"))
    num, den = LEAST
    verified = verified.where(F.col("both") * (num + den) >= F.col("whole") * num).join(items.select("it", "item_id"), "it")
    verified = cut(verified.select(*key, "item_id", (F.col("both") / (F.col("whole") - F.col("both"))).alias("similarity")))
    out = found.drop("ws").join(small(verified), key)
    return out.groupBy("doc_id", "copy", "item_id").agg(_best(F.struct("similarity", (-F.col("start")).alias("s"), "n")))


def _best(window: Column) -> Column:
    """The window of the highest similarity, the first of them, the longest of these."""
    return F.max(window).alias("b")


def contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row a contaminated document and item: doc_id, item_id, similarity (of the best window, rounded to 6 places), start (of its first such window, in words from 0) and words."""
    out = _found(docs, benchmark, id, text, item, item_text).groupBy("doc_id", "item_id").agg(_best(F.col("b")))
    return out.select("doc_id", "item_id", F.round("b.similarity", 6).alias("similarity"), (-F.col("b.s")).alias("start"), F.col("b.n").alias("words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that are not contaminated; of rows that share an id only those of a contaminated text go."""
    own = "_" * (1 + max(map(len, docs.columns)))  # no column of docs has a name that long
    bad = _found(docs, benchmark, id, text, "item_id", "text").select(F.col("doc_id").alias(f"{own}id"), F.col("copy").alias(f"{own}copy")).distinct()
    return docs.join(cut(bad), F.col(f"`{id}`").eqNullSafe(F.col(f"{own}id")) & (F.xxhash64(F.col(f"`{text}`")) == F.col(f"{own}copy")), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
_SHINGLES_SQL = """
SELECT {id}, text, len(w) AS n, CASE
  WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  ELSE [array_to_string(w, ' ')] END AS hs
FROM (SELECT {id}, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM {rows})
WHERE len(w) > 0
"""
PAIRS_SQL = """
bench AS ({bench}), texts AS (SELECT row_number() OVER () AS r, * FROM ({texts})), items AS (SELECT row_number() OVER () AS i, * FROM bench),
shared AS (
  SELECT r, i, min(place) AS low, max(place) AS high
  FROM (SELECT r, unnest(hs) AS h, unnest(range(0, len(hs))) AS place FROM texts) t JOIN (SELECT DISTINCT i, len(hs) AS m, unnest(hs) AS h FROM items) b ON t.h = b.h
  GROUP BY r, i, m HAVING count(*) >= 0.8 * m
), windows AS (
  SELECT r, i, unnest(range(low - len(hs) + 1, high + 1)) AS start FROM shared JOIN items USING (i)
), cuts AS (
  SELECT doc_id, item_id, b.n, greatest(start, 0) AS start, t.hs[greatest(start, 0) + 1:start + len(b.hs)] AS ws, b.hs AS hs
  FROM windows w JOIN texts t USING (r) JOIN items b USING (i)
), scored AS (
  SELECT doc_id, item_id, n, start, len(ws) + len(hs) AS total,
    CAST(list_sum(list_transform(list_distinct(list_intersect(ws, hs)), lambda h: least(len(list_filter(ws, lambda x: x = h)), len(list_filter(hs, lambda x: x = h))))) AS DOUBLE) AS both_
  FROM cuts
), pairs AS (
  SELECT doc_id, item_id, n, start, both_ / (total - both_) AS similarity FROM scored WHERE both_ / (total - both_) >= 0.8
)
"""


def pairs_sql(rows: str = "documents") -> str:
    bench, texts = _SHINGLES_SQL.format(id="item_id", rows="benchmark"), _SHINGLES_SQL.format(id="doc_id", rows=rows)
    return PAIRS_SQL.replace("{bench}", bench).replace("{texts}", texts)


ORACLES = {
    "op3_decontaminate": "WITH " + pairs_sql() + """
SELECT doc_id, item_id, round(similarity, 6) AS similarity, CAST(start AS INTEGER) AS start, CAST(n AS INTEGER) AS words
FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start, n DESC) = 1
"""
}
