"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

A source's target is its share of the budget by weight, at most `most` times the words it has; what
goes beyond is reshared by weight. The level at which this ends is found in one pass over the sources
in the order of cap / weight instead of by rounds: with the first sources at their caps, the others
share what is left, and the first level that does not exceed the next source's own ratio holds.

Within a source every document draws an exponential key -ln(u) / quality, u from a hash of its id, so
documents of higher quality tend to come first, reruns agree and no order of rows matters. A target
of e whole epochs and a rest takes every document e times; then documents in the order of their keys
until the rest is used up, the last one in part.

The prefix sums are made in two steps, over buckets of the key and within a bucket, so that a source
that holds most rows is spread over as many tasks as it has buckets. Buckets are cut at equal steps of the
keys' distribution, which follows from a source's weights (a histogram of them), so they are about equally
full whatever the weights are; where they are cut changes no result.

Null and empty texts have size 0 and take 0; a null source is a source of its own, last in order. Texts
are counted whole, however long. Rows of one id are told apart by size, a row without an id draws by its
text; equal rows are interchangeable. An empty table gives no rows. Extra columns, whatever their names,
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm.common import cut, small, table

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a bucket of a source's keys has on average.
BUCKET_ROWS = 512


def quality_weight(text: Column | str) -> Column:
    """A document's weight without a model, 0.05 to 1: the share of ASCII letters, blanks and non-ASCII characters, squared."""
    text = F.col(text) if isinstance(text, str) else text
    n = F.length(text)
    plain = n - F.length(F.translate(text, "0123456789!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", ""))
    share = (n - plain) / n
    return F.when(n > 0, F.greatest(F.lit(0.05), share * share)).otherwise(F.lit(1.0))


def hashed_uniform(id: Column, seed: str) -> Column:
    """A number in (0, 1) from the id alone: 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), id.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0) -> DataFrame:
    """source, source_size, rows and target of each source; sizes has one row a document: source, size.

    One row a source is what the windows without a key run over.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    # UTF-8 bytes sort as code points do.
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn - 1, F.lit(len(weights))) + 1).cast("int"))
    own = sums.select("*", turn.alias("turn")).select("source", "source_size", "rows", "turn", weight.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy(F.col("cap") / F.col("w"), "turn").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(whole) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    levels = own.withColumn("level", level).withColumn("held", F.min(F.when(F.col("level") <= F.col("cap") / F.col("w"), F.struct(F.col("cap") / F.col("w"), "turn", "level"))).over(whole)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("held") * F.col("w"), F.col("cap").cast("double")))
    return levels.select("source", "source_size", "rows", F.round(target, 6).alias("target"))


def bucket_of(key: Column, classes: Column) -> Column:
    """The bucket of a key, which never falls as the key grows: how many documents are expected to have a smaller one, by BUCKET_ROWS."""
    less = F.aggregate(classes, F.lit(0.0), lambda sum_, c: sum_ + c["n"] * (1 - F.exp(-key * c["w"])))
    return F.floor(less / BUCKET_ROWS).cast("long")


def mix_sources(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", weight: Column | None = None, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, share: float = 1.0, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, and the key that ordered the documents, for every row of docs."""
    u = hashed_uniform(F.coalesce(F.col(id).cast("string"), F.col(text), F.lit("")), seed)
    rows = docs.select(
        F.col(id).cast("long").alias("doc_id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.col(source).cast("string").alias("source"),
        u.alias("u"),
        F.coalesce(weight if weight is not None else quality_weight(text), F.lit(1.0)).alias("weight"),
    )
    slim = cut(rows)
    # How many documents of a source have which weight, four classes to a factor of e.
    held = F.greatest("weight", F.lit(1e-6))
    classes = slim.groupBy(F.col("source").alias("s"), F.floor(F.log(held) * 4).alias("class")).agg(F.count("*").alias("n"), F.avg(held).alias("w"))
    classes = classes.groupBy("s").agg(F.collect_list(F.struct("n", "w")).alias("classes"))
    targets = source_targets(slim, weights, most, share)
    targets = cut(targets.join(classes, F.col("source").eqNullSafe(F.col("s"))).drop("s"))
    keyed = slim.join(small(targets), slim["source"].eqNullSafe(targets["source"])).drop(targets["source"])
    key = -F.log("u") / held
    bucket = bucket_of(F.col("key"), F.col("classes"))
    keyed = keyed.withColumn("key", key)
    keyed = keyed.select("doc_id", "size", "source", "source_size", "target", "rows", "key", bucket.alias("bucket"))
    sums = keyed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("rows").alias("rows"))
    # Buckets of a source in turn: one row for each few thousand documents, and by a second level above those.
    upper = F.floor(F.col("bucket") / 1024)
    tops = sums.groupBy("source", upper.alias("upper")).agg(F.sum("bucket_size").alias("upper_size"))
    tops = tops.select("source", "upper", F.coalesce(F.sum("upper_size").over(Window.partitionBy("source").orderBy("upper").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("upper_before"))
    inner = Window.partitionBy("source", "upper").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    befores = sums.withColumn("upper", upper).withColumn("inner_before", F.coalesce(F.sum("bucket_size").over(inner), F.lit(0)))
    befores = befores.alias("b").join(tops.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.upper") == F.col("t.upper")))
    befores = befores.select(F.col("b.source").alias("s"), F.col("b.bucket").alias("k"), (F.col("inner_before") + F.col("upper_before")).alias("before"))
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(befores, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("k")))
    # The target as whole words; epochs that are complete; the words of the rest.
    words = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).cast("long")
    rest = words - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before") - F.col("ahead")))
    return placed.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"), "key")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).drop("key")


QUERIES = {"op6_source_mix": op6_source_mix}
SIZES_SQL = r"""
SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size,
  (CAST(CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), text, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u,
  CASE WHEN length(text) > 0 THEN greatest(0.05, pow(length(translate(text, '0123456789!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', '')) / length(text), 2)) ELSE 1.0 END AS weight
FROM {docs}
"""
MIX_SQL = """
sizes AS ({sizes}
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, encode(source)) AS turn FROM sizes GROUP BY source
), own AS (
  SELECT *, source_size * 3 AS cap, [5, 2, 1][(turn - 1) % 3 + 1] AS w FROM sums
), levels AS (
  SELECT *, cap / w AS ratio,
    ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0)::DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::DOUBLE AS level
  FROM own WINDOW b AS (ORDER BY cap / w, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), held AS (SELECT level FROM levels WHERE level <= ratio ORDER BY ratio, turn LIMIT 1
), targets AS (
  SELECT source, source_size, round(least(cap::DOUBLE, coalesce((SELECT level FROM held) * w, cap::DOUBLE)), 6) AS target FROM levels
), keyed AS (
  SELECT doc_id, size, source_size, target, floor(target + 0.5)::BIGINT AS words,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY -ln(u) / greatest(weight, 1e-6), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS ahead
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), mixed AS (
  SELECT doc_id, size::BIGINT AS size, source_size, target,
    (CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * size
     + greatest(0, least(size, words - CASE WHEN source_size > 0 THEN words // source_size ELSE 0 END * source_size - ahead)))::BIGINT AS taken
  FROM keyed
)
"""
ORACLES = {"op6_source_mix": "WITH " + MIX_SQL.replace("{sizes}", SIZES_SQL.replace("{docs}", "documents")) + "SELECT * FROM mixed"}
