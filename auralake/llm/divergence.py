"""Source divergence audit: how differently the sources of a language use its frequent terms, in relations only.

Terms are the runs of ASCII letters and characters above U+007F, of which only A-Z are lower-cased. A term that
at least `least` documents of a language hold is kept for that language. Each (language, source), and each
language by itself, gives each kept term a smoothed share of a billion, in whole numbers throughout:
p = 1 + floor(10**9 * (count + 5) / (N + 5 * V)), N the occurrences of kept terms there and V their number.

Two reports: `pair`, for each two sources of a language the sum of |p - q| over its kept terms; `term`, for each
source the terms that it has and uses more than the language does, the `most` with the largest difference.

One pass over the texts: each document gives its matches and its distinct ones, which are counted by
(language, source, term) before they are shuffled, so a hot source, language or word costs a row for each
task. Zeros are made dense by a join of the sources of a language with its vocabulary; a language has few
rows of sources, so they are what is broadcast if they fit, and the join by language is shuffled if not. The
self-join is by (language, term), its sums are grouped before they are shuffled. Ranks of terms are limited in each
task before rows of a source meet.

Null texts, languages and sources read as ''. A source without terms has p of zero occurrences; a language
without kept terms has pairs with a value of 0 and no terms. Repeated rows count as documents of their own. Texts
are read whole. An empty table gives no rows, and extra columns are ignored. Sums are exact: shares are whole
numbers of up to 38 digits before they are divided, and a sum of a row's differences stays below 2**63 for up to
9 * 10**9 kept terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm.common import cut, small, table

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_DOCS, MOST_TERMS = 30, 50
_KEY = ["lang", "source"]


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and df (documents) of each term; docs' columns by name, nulls as ''."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    found = docs.select(blank(lang).alias("lang"), blank(source).alias("source"), terms(blank(text)).alias("terms"))
    # An occurrence counts for n, the same term among the distinct ones of its document for df.
    both = found.select(*_KEY, F.explode(F.array(F.struct(F.lit(1).alias("n"), F.lit(0).alias("df"), "terms"), F.struct(F.lit(0).alias("n"), F.lit(1).alias("df"), F.array_distinct("terms").alias("terms")))).alias("x"))
    each = both.select(*_KEY, "x.n", "x.df", F.explode("x.terms").alias("term"))
    return each.groupBy(*_KEY, "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(n: Column, total: Column, kinds: Column) -> Column:
    """p of n occurrences among `total` of `kinds` terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over, under = (F.lit(1_000_000_000).cast("decimal(10,0)") * wide(n + 5)), wide(total + 5 * kinds)
    return (1 + F.call_function("div", over, under)).cast("long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCS, most: int = MOST_TERMS) -> DataFrame:
    """lang, source, part, item, value and rank of both reports."""
    counts = cut(term_counts(docs, text, lang, source))
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    sources = cut(docs.select(blank(lang).alias("lang"), blank(source).alias("source")).distinct())
    kept = cut(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("df").alias("df")).where(F.col("df") >= least).drop("df"))
    own = cut(counts.drop("df").join(kept.select("lang", "term"), ["lang", "term"]))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    totals = own.groupBy(*_KEY).agg(F.sum("n").alias("total"))
    groups = cut(sources.join(totals, _KEY, "left").join(langs, "lang").select(*_KEY, F.coalesce("total", F.lit(0)).alias("total"), "v", "lang_total"))
    dense = kept.join(small(groups), "lang").join(own, [*_KEY, "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    shares = cut(dense.select(*_KEY, "term", "n", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q")))
    # Pairs of sources, each once, then in both directions; those of languages without kept terms are in `sources` alone.
    a, b = shares.alias("a"), shares.alias("b")
    met = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.term") == F.col("b.term")) & (F.col("a.source") < F.col("b.source")))
    sums = cut(met.groupBy(F.col("a.lang").alias("lang"), F.col("a.source").alias("source"), F.col("b.source").alias("item")).agg(F.sum(F.abs(F.col("a.p") - F.col("b.p"))).alias("value")))
    sums = sums.union(sums.select("lang", "item", "source", "value"))
    others = sources.join(small(sources).withColumnRenamed("source", "item"), "lang").where("source <> item")
    pairs = others.join(sums, [*_KEY, "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    more = shares.where("n > 0 AND p > q").select(*_KEY, F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy(*_KEY).orderBy(F.col("value").desc(), "item"))
    ranked = lambda rows, part: rows.select(*_KEY, F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(pairs, "pair").union(ranked(more, "term").where(F.col("rank") <= most))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {"op13_divergence": op13_divergence}
ORACLES = {
    "op13_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {LEAST_DOCS}),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT s.lang, s.source, coalesce(sum(n), 0) AS total FROM sources s LEFT JOIN own o ON s.lang = o.lang AND s.source = o.source GROUP BY ALL),
shares AS (SELECT s.lang, s.source, k.term, coalesce(o.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 5)) // (s.total + 5 * v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (lang_total + 5 * v)::HUGEINT AS q
  FROM totals s JOIN langs l ON s.lang = l.lang JOIN kept k ON s.lang = k.lang LEFT JOIN own o ON s.lang = o.lang AND s.source = o.source AND k.term = o.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
more AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM more))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {MOST_TERMS}"""
}
