"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into `groups`; the list of a group holds, for a query, every vector's partial
product over that group, and a score is the sum over the lists.

1. gather: from each group's list of each block of vectors the k best entries are taken; their scores
   are completed, and a query's k best of these, over all blocks, bound its k-th score from below: tau;
2. the safe cutoff tau / groups goes back to the blocks: a score of tau or more needs at least one
   entry that reaches it. Those entries are collected, and a vector whose bound (entries that reached
   the cutoff, and the cutoff for the others) stays under tau is dropped;
3. what is left is resolved exactly, and those of tau or more are ranked.

Entries meet in the block that holds a vector's whole row, so only gathered and resolved entries are
shuffled: at most k rows a query and block in either pass. Queries are packed into blocks of bounded
size, and a block of vectors meets each block of queries once: the stated query set against all rows.

Components are floor(scale * x) computed in doubles. A vector that is null, empty or holds null or
non-finite components takes no part, neither as query nor as candidate. Ties go to the smaller id; a
repeated id is as many candidates, none of them its own query's, and as many queries, each ranked by itself. Vectors of another length than the
query's do not match it. Products are summed in doubles while every partial sum is below 2**53, which
is exact, and else as Python integers, then held within 64 bits. Empty tables give no rows, and extra
columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auralake.llm.common import cut, table

#: Rows of a block of vectors and of a block of queries: what bounds a task's memory.
ROWS, QUERIES_A_BLOCK = 2048, 256
FOUND = "q long, at long, query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id: str, vector: str, scale: float) -> DataFrame:
    """id and the components as whole doubles, of the vectors that take part."""
    x = F.transform(F.col(vector), lambda v: F.floor(v.cast("double") * F.lit(float(scale))).cast("double"))
    fine = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vectors.where(F.col(id).isNotNull() & (F.size(vector) > 0) & fine).select(F.col(id).cast("long").alias("id"), x.alias("x"))


def packed(rows: DataFrame, most: int, name: str) -> DataFrame:
    """Blocks of at most `most` vectors of one length: name (an id of the block), ids, x (row-major doubles)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, col = batch.column("id").to_numpy(), batch.column("x")
            offs, flat = np.asarray(col.offsets), col.values.to_numpy()
            sizes = np.diff(offs)
            for d in np.unique(sizes):
                own = np.flatnonzero(sizes == d)
                for i in range(0, len(own), most):
                    some = own[i : i + most]
                    x = flat[offs[some][:, None] + np.arange(d)]
                    yield pa.RecordBatch.from_arrays([pa.array([int(ids[some[0]])]), pa.array([int(d)], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()]), pa.array([x.astype("<f8").tobytes()])], names=[name, "d", f"{name}_ids", f"{name}_x"])

    return rows.mapInArrow(pack, f"{name} long, d int, {name}_ids binary, {name}_x binary")


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact: as doubles, or as Python integers when these could round."""
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * q.shape[1] < 2.0**53:
        return q @ c.T
    return np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in c], object).T


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        floor = np.sort(scores)[-k] if scores.dtype == object else np.partition(scores, len(scores) - k)[-k]
        some = np.flatnonzero(scores >= floor)
    else:
        some = np.arange(len(scores))
    return np.array(sorted(some, key=lambda i: (-scores[i], ids[i]))[:k], int)


def _read(row: dict, name: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{name}_ids"], "<i8"), np.frombuffer(row[f"{name}_x"], "<f8").reshape(-1, row["d"])


def _parts(d: int, groups: int) -> list[slice]:
    edges = np.linspace(0, d, min(groups, d) + 1).astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _answer(found: list[tuple[int, int, int, int, int]]) -> pa.RecordBatch:
    held = [(b, at, q, c, min(max(int(s), -(1 << 63)), (1 << 63) - 1)) for b, at, q, c, s in found]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.int64()) for i in range(5)], names=["q", "at", "query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id: str = "vec_id", vector: str = "embedding", scale: float = 256.0, groups: int = 4) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows of vectors for each row of queries, but the query's own id."""
    spark = vectors.sparkSession
    blocks = cut(packed(quantised(vectors, id, vector, scale), ROWS, "c"))
    # A query is known by its block and its place there: ids may repeat.
    asked = cut(packed(quantised(queries, id, vector, scale).coalesce(4), QUERIES_A_BLOCK, "q").withColumn("q", F.monotonically_increasing_id()))
    # A block of vectors goes once to each block of queries; salting keeps a query block's pairs apart.
    n = max(1, spark.sparkContext.defaultParallelism)
    salt = F.pmod(F.xxhash64("c"), F.lit(n)).cast("int")
    meet = (
        blocks.select("*", salt.alias("salt"))
        .join(asked.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["salt", "d"])
        .drop("salt")
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (qs, q), (cs, c) = _read(row, "q"), _read(row, "c")
                parts, found = [products(q[:, s], c[:, s]) for s in _parts(row["d"], groups)], []
                for i, own in enumerate(qs):
                    near = np.unique(np.concatenate([best(np.where(cs == own, p[i].min() - 1, p[i]), cs, k) for p in parts]))
                    near = near[cs[near] != own]
                    scores, ids = sum(p[i][near] for p in parts), cs[near]
                    found += [(row["q"], i, own, ids[j], scores[j]) for j in best(np.asarray(scores), ids, k)]
                yield _answer(found)

    gathered = meet.mapInArrow(gather, FOUND)
    # The k-th best gathered score of each query; -2**63 while there are fewer than k.
    cutoff = F.when(F.count("*") >= k, F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)).otherwise(F.lit(-(1 << 63)))
    by_rank = Window.partitionBy("q", "at").orderBy(F.desc("score"), "vec_id")
    cutoffs = cut(gathered.withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= k).groupBy("q", "at").agg(cutoff.alias("tau")))
    # tau goes back to its block of queries as one array in the block's order.
    own = asked.select("q", F.explode(F.sequence(F.lit(0).cast("long"), (F.length("q_ids") / 8 - 1).cast("long"))).alias("at"))
    taus = own.join(cutoffs, ["q", "at"], "left").groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("tau", F.lit(-(1 << 63))).alias("tau")))), lambda s: s["tau"]).alias("taus"))

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (qs, q), (cs, c), taus = _read(row, "q"), _read(row, "c"), row["taus"]
                parts, found = [products(q[:, s], c[:, s]) for s in _parts(row["d"], groups)], []
                for i, own in enumerate(qs):
                    tau = taus[i]
                    safe = tau / len(parts)
                    reached = [p[i] >= safe for p in parts]
                    some = np.flatnonzero(np.logical_or.reduce(reached) & (cs != own))
                    # A bound in doubles may round down: a little is given back.
                    bound = sum(np.where(r[some], p[i][some], safe) for p, r in zip(parts, reached, strict=True))
                    some = some[bound >= tau - 1 - abs(tau) * 1e-12] if len(some) else some
                    scores = np.asarray(sum(p[i][some] for p in parts))
                    some, scores = some[scores >= tau], scores[scores >= tau]
                    found += [(row["q"], i, own, cs[some[j]], scores[j]) for j in best(scores, cs[some], k)]
                yield _answer(found)

    resolved = meet.join(taus, "q").mapInArrow(resolve, FOUND)
    ranked = resolved.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))


QUERIES = {"op10_top_k": op10_top_k}
ORACLES = {
    "op10_top_k": """
WITH fit AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), asked AS (SELECT *, row_number() OVER () AS r FROM fit WHERE vec_id % 50 = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM asked q JOIN fit c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
""",
}
