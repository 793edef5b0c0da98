"""Near-duplicate documents by DartMinHash signatures and a banded join, verified exactly.

A document is the multiset of its five-word shingles; two documents are linked if the weighted Jaccard
similarity of these is 0.8 or more, and a class is what links connect. The class id is the smallest
doc_id in it.

1. Documents of one sequence of words are copies: they share 128 bits of hash and are one node. Groups
   of copies of any size collapse in a map-side aggregate.
2. DartMinHash: every shingle, with its number of occurrences as weight, owns a strip of weight by
   rank. Darts fall on it as a Poisson process whose gaps and places are hashes of the shingle alone;
   those beyond the shingle's weight miss. A dart that hits belongs to one of DARTS coordinates, and a
   coordinate keeps its earliest. The rank up to which darts are thrown is raised until every
   coordinate has one; equal coordinates of two documents have the probability of their similarity.
3. Bands of ROWS coordinates: documents that agree on a band meet in its bucket. Each member of a
   bucket is compared with the bucket's leader, the member that meets most documents over all of its
   buckets: of a group of edited copies that is the one nearest to all others. The comparison is exact,
   over the whole texts.
4. Connected components over the links, by least neighbours and pointer jumping, written out each
   round. Within a component no pair needs comparing, so a group of near copies costs about as many
   comparisons as it has members.
5. Buckets that still hold several components: all pairs of their documents that are similar enough and
   of two components are found, by rarest shared shingles. With shingles in order of rising frequency,
   a pair whose first common shingle comes after weight q of a document of weight T has at most T - q in
   common, and 0.8 asks for 4/9 of the weights of both. So a document of weight T is worth joining at a
   shingle after q only with documents of weight (5 T - 9 q) / 4 or less: this bounds sizes and places at
   once, is part of the join, and takes rows out before it at shingles where no other component has a
   document that fits. What is left is verified exactly, and the components are joined up.

A null or empty text, or one without words, is a class of its own. A text of one to four words has
one shingle. Each row is a document: rows of one id and text are copies, rows of one id with different
texts are documents that share their id, and rows without an id take part like others; the id of a
class that has none is null. An empty table gives no rows. A text of any length is read whole, by itself
if it is long. Extra columns of docs, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm.common import chunks, columns_text, cut, small, table
from auralake.llm.wordhash import mix, text_shingles

BANDS, ROWS = 24, 5
DARTS = BANDS * ROWS
#: The least similarity, as a fraction.
NUM, DEN = 4, 5
LEAST = NUM / DEN
#: Expected darts of a cell: a strip of an element's weight by a slab of rank.
SLAB = 4.0


def multisets(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' hashes the text, hash and number of occurrences of each distinct one."""
    of = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((hashes, of))
    of, h = of[order], hashes[order]
    new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
    return of[new], h[new], np.diff(np.append(new, len(h)))


def dart_signatures(of: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, darts: int = DARTS) -> np.ndarray:
    """For each of n weighted sets and each coordinate the identity of the earliest dart that hits the set.

    of, hashes and weights name the elements, the weights being positive. An element's weight axis is
    cut at 1, 2, 4, 8, ... and the rank axis into slabs; in each cell darts arrive with exponential gaps
    at a rate of the piece's width, so that sets agree on all darts they both contain. All sets are thrown at side by side; those
    with a coordinate left empty are thrown at again up to twice the rank.
    """
    total = np.bincount(of, weights, n)
    limits = (np.log(darts) + 3) * darts / np.maximum(total, 1e-300)
    rank, ident = np.full((n, darts), np.inf), np.zeros((n, darts), np.uint64)
    todo = total > 0
    while todo.any():
        some = todo[of]
        where, when, what = [], [], []
        low, width = 0.0, 1.0
        while some.any():
            o, h, w = of[some], hashes[some], weights[some].astype(float)
            cells = np.ceil(limits[o] * width / SLAB).astype(np.int64)
            slab = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
            o, w = np.repeat(o, cells), np.repeat(w, cells)
            key = mix(np.repeat(h ^ mix(np.full(1, int(low) * 2 + 1, np.uint64)), cells) + slab.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            at, end = slab * (SLAB / width), np.minimum(limits[o], (slab + 1) * (SLAB / width))
            k = 0
            while len(o):
                k += 1
                dart = mix(key + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64)))
                at = at - np.log(((dart >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
                near = np.flatnonzero(at < end)
                o, w, at, end, key, dart = o[near], w[near], at[near], end[near], key[near], dart[near]
                spot = mix(dart ^ np.uint64(0xA5A5A5A55A5A5A5A))  # the upper half is the place in weight, the lower the coordinate
                hit = np.flatnonzero(low + ((spot >> np.uint64(32)).astype(np.float64) + 0.5) * 2.0**-32 * width < w)
                where.append(o[hit] * darts + ((spot[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(darts)).astype(np.int64))
                when.append(at[hit])
                what.append(dart[hit])
            low, width = (1.0, 1.0) if low == 0.0 else (2 * low, 2 * low)
            some = todo[of] & (weights > low)
        where, when, what = (np.concatenate(c) for c in (where, when, what))
        flat = rank.ravel()
        np.minimum.at(flat, where, when)
        first = when == flat[where]
        ident.ravel()[where[first]] = what[first]
        todo &= ~np.isfinite(rank).all(1)
        limits[todo] *= 2
    return ident


def bands(signatures: np.ndarray) -> np.ndarray:
    """For each signature a 64-bit key for each band."""
    rows = signatures.reshape(-1, BANDS, ROWS)
    key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), 1))
    for j in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, :, j])
    return key.view(np.int64)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two multisets of hashes: occurrences in common by those in either."""
    (x, n), (y, m) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    both = np.minimum(n[i], m[j]).sum()
    return float(both / (len(a) + len(b) - both)) if len(a) + len(b) else 1.0


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offs in chunks(columns_text(batch, "text")):
            words, at, found, bounds = text_shingles(data, offs)
            # The sequence of words as two sums of hashes of (word, place in its text).
            place = np.arange(len(words), dtype=np.uint64) - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
            sums = [np.concatenate([[np.uint64(0)], np.cumsum(mix(words ^ place * np.uint64(s)))]) for s in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
            none = np.diff(at) == 0
            c1, c2 = (pa.array((s[at[1:]] - s[at[:-1]]).view(np.int64), mask=none) for s in sums)
            keys = bands(dart_signatures(*multisets(found, bounds), j - i)[~none])
            ends = np.concatenate([[0], np.cumsum(~none * BANDS)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends, mask=np.append(none, False)), keys.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("th").slice(i, j - i), c1, c2, lists], names=["doc_id", "th", "c1", "c2", "bands"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, keep = columns_text(batch, "ta"), columns_text(batch, "tb"), []
        kept: dict[int, np.ndarray] = {}
        ids = batch.column("a").to_pylist()
        for i, j, data, offs in chunks(b):
            _, _, found, bounds = text_shingles(data, offs)
            for k in range(i, j):
                if ids[k] not in kept:
                    if len(kept) > 64:
                        kept.clear()
                    raw = np.frombuffer(a[k].as_buffer(), np.uint8) if len(a[k].as_py()) else np.zeros(0, np.uint8)
                    kept[ids[k]] = text_shingles(raw, np.array([0, len(raw)]))[2]
                keep.append(weighted_jaccard(kept[ids[k]], found[bounds[k - i] : bounds[k - i + 1]]) >= LEAST)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, labels = batch.column("node").to_numpy(), batch.column("label").to_numpy()
        for i, j, data, offs in chunks(columns_text(batch, "text")):
            _, _, found, bounds = text_shingles(data, offs)
            of, h, n = multisets(found, bounds)
            columns = (nodes[i:j][of], labels[i:j][of], np.diff(bounds)[of].astype(np.int64), h.view(np.int64), n.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["node", "label", "t", "h", "w"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of a document that may be the first one it has in common, and how far it reaches at each (see join())."""
    for batch in batches:
        listed = batch.column("l")
        values, ends = listed.flatten(), np.concatenate([[0], np.cumsum(np.diff(np.asarray(listed.offsets)))])
        df, h, w = (values.field(c).to_numpy().astype(np.int64) for c in ("df", "h", "w"))
        node, label, t, shared = (batch.column(c).to_numpy() for c in ("node", "label", "t", "shared"))
        of = np.repeat(np.arange(len(node)), np.diff(ends))
        order = np.lexsort((h, df, of))
        h, w = h[order], w[order]
        before = np.cumsum(w) - w
        # Shingles of no other document come first: their weight is all that counts of them.
        before += np.repeat(t - shared - (before[ends[:-1]] if len(w) else 0), np.diff(ends))
        keep = DEN * before <= (DEN - NUM) * t[of]
        of, h, before = of[keep], h[keep], before[keep]
        columns = (h, node[of], label[of], t[of], DEN * t[of] - (NUM + DEN) * before)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "node", "label", "t", "reach"])


def fitting(rows: DataFrame) -> DataFrame:
    """The rows (h, node, label, t, reach) whose shingle is also that of a row of another label they might pair with.

    The least t and the greatest reach of all other labels decide, so a shingle that most of a large group
    has is left out unless a document outside of the group fits one of it.
    """
    own = cut(rows.groupBy("h", "label").agg(F.min("t").alias("t"), F.max("reach").alias("reach")))
    best = own.groupBy("h").agg(F.min(F.struct("t", "label")).alias("lo"), F.max(F.struct("reach", "label")).alias("hi"), F.count("*").alias("n")).where("n > 1").drop("n")
    best = cut(best)
    other = own.join(best, "h").groupBy("h").agg(
        F.first("lo").alias("lo"), F.first("hi").alias("hi"),
        F.min(F.when(F.col("label") != F.col("lo.label"), F.col("t"))).alias("lo2"), F.max(F.when(F.col("label") != F.col("hi.label"), F.col("reach"))).alias("hi2"),
    )
    least = F.when(F.col("label") == F.col("lo.label"), F.col("lo2")).otherwise(F.col("lo.t"))
    most = F.when(F.col("label") == F.col("hi.label"), F.col("hi2")).otherwise(F.col("hi.reach"))
    return rows.join(cut(other), "h").where((NUM * least <= F.col("reach")) & (NUM * F.col("t") <= most)).select(rows.columns)


def rare_candidates(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of documents (node, label, text) of different labels that a shared rare shingle lets be similar enough."""
    rows = cut(mixed.mapInArrow(_shingled, "node long, label long, t long, h long, w long"))
    common = cut(rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1"))
    known = rows.join(common, "h").groupBy("node", "label", "t").agg(F.collect_list(F.struct("df", "h", "w")).alias("l"), F.sum("w").alias("shared"))
    prefix = cut(known.mapInArrow(_prefixes, "h long, node long, label long, t long, reach long"))
    left = cut(fitting(cut(fitting(prefix))))
    other = left.select("h", F.col("node").alias("b"), F.col("label").alias("label2"), F.col("t").alias("t2"), F.col("reach").alias("reach2"))
    fits = (F.col("node") < F.col("b")) & (F.col("label") != F.col("label2")) & (NUM * F.col("t2") <= F.col("reach")) & (NUM * F.col("t") <= F.col("reach2"))
    return left.join(other, "h").where(fits).select(F.col("node").alias("a"), "b").distinct()


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) have a similarity of LEAST or more."""
    tb = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    ta = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    return pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb").mapInArrow(_verified, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links connect a node with; only nodes with links appear.

    Each round a node takes the least label of itself and its neighbours, then what that label was
    labelled. Labels only fall, so the rounds end: after about as many as the logarithm of the longest chain.
    """
    both = cut(links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("x").alias("node")).agg(F.least(F.first("x"), F.min("y")).alias("label")))
    while True:
        near = both.join(labels, both["y"] == labels["node"]).groupBy(F.col("x").alias("node")).agg(F.min("label").alias("least"))
        step = labels.withColumnRenamed("label", "old").join(near, "node").select("node", "old", F.least("old", "least").alias("label"))
        # A label's own label is in the last round's table: the node it names has one.
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = cut(step.join(jump, "label", "left").select("node", "old", F.coalesce("root", "label").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").limit(1).count() == 0:
            return labels


def _heads(signed: DataFrame) -> DataFrame:
    """One row for each distinct sequence of words: c1, c2, id and th of its first row, bands, and a number of its own (node), from 0 up whatever the ids are."""
    same = signed.where("c1 IS NOT NULL").groupBy("c1", "c2").agg(F.min("doc_id").alias("id"), F.min(F.struct("doc_id", "th")).alias("m0"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("m"), F.first("bands", ignorenulls=True).alias("bands"))
    return cut(same.select("c1", "c2", "id", F.coalesce("m.th", "m0.th").alias("th"), "bands", F.monotonically_increasing_id().alias("node")))


def _classes(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """doc_id, th (the text's hash), class and class_id (the smallest doc_id of it) for every row of docs, class being null for a text without words; and the (doc_id, th) that several rows have."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    signed = cut(rows.mapInArrow(_signatures, "doc_id long, th long, c1 long, c2 long, bands array<long>"))
    again = cut(signed.where("c1 IS NOT NULL").groupBy("doc_id", "th").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    repeats = again.limit(1).count() > 0
    heads = _heads(signed)
    filed = heads.select("node", F.explode("bands").alias("band"))
    # Buckets of one document are gone after this.
    sizes = cut(filed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = cut(filed.join(sizes, "band"))
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    leaders = members.join(met, "node").groupBy("band").agg(F.max(F.struct("met", (-F.col("node")).alias("less"))).alias("m")).select("band", (-F.col("m.less")).alias("leader"))
    led = members.join(cut(leaders), "band").where("leader <> node")
    pairs = cut(led.select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())

    def texts_of(nodes: DataFrame) -> DataFrame:
        """node, text and the other columns of nodes (node, ...); a text that several rows have is taken once."""
        some = cut(nodes.join(heads.select("node", F.col("id").alias("i"), F.col("th").alias("h")), "node"))
        own = rows.join(small(some), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("h"))).drop("doc_id", "th", "i", "h")
        return cut(own.dropDuplicates(["node"]) if repeats else own)

    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    links = cut(verify(pairs, texts_of(met)))
    labels = components(links)
    # Buckets that still hold several components.
    placed = cut(members.join(labels, "node", "left").select("band", "node", F.coalesce("label", "node").alias("label")))
    mixed = cut(placed.groupBy("band").agg(F.min("label").alias("l1"), F.max("label").alias("l2")).where("l1 < l2").select("band"))
    many = texts_of(placed.join(mixed, "band").select("node", "label").distinct())
    more = cut(verify(cut(rare_candidates(many)), many))
    if more.limit(1).count():
        labels = components(cut(links.union(more)))
    found = heads.join(labels, "node", "left").select("c1", "c2", "node", "id", F.coalesce("label", "node").alias("class"), F.col("label").isNotNull().alias("linked"))
    least = found.where("linked").groupBy(F.col("class").alias("k")).agg(F.min("id").alias("least"))
    found = found.join(least, found["class"] == least["k"], "left").select(F.col("c1").alias("d1"), F.col("c2").alias("d2"), "class", F.when(F.col("linked"), F.col("least")).otherwise(F.col("id")).alias("class_id"))
    own = signed.drop("bands").join(cut(found), (F.col("c1") == F.col("d1")) & (F.col("c2") == F.col("d2")), "left")
    return own.select("doc_id", "th", "class", F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id")), again


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id for every row of docs."""
    return _classes(docs, id, text)[0].select("doc_id", "class_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs but for one of each class, the one of the smallest id; texts without words all stay."""
    found, again = _classes(docs, id, text)
    found = cut(found.where("class IS NOT NULL"))
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("th").alias("th"))
    stays = cut(found.groupBy(F.col("class").alias("k")).agg(F.min(rank).alias("m"), F.count("*").alias("n")).where("n > 1"))
    gone = found.join(stays, found["class"] == stays["k"]).where(~(F.col("doc_id").eqNullSafe(F.col("m.id")) & (F.col("th") == F.col("m.th"))))
    gone = cut(gone.select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct())
    again = again.withColumnsRenamed({"doc_id": "__id", "th": "__th"})
    same = lambda few: docs[id].cast("long").eqNullSafe(few["__id"]) & (F.xxhash64(docs[text]) == few["__th"])
    left = docs.join(small(gone), same(gone), "left_anti")
    # Of rows that repeat the one that stays, one stays.
    if not again.limit(1).count():
        return left
    twice = left.join(again, same(again), "left_semi").dropDuplicates([id, text])
    return left.join(again, same(again), "left_anti").unionByName(twice)


def op8_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_near_dups": op8_near_dups}
ORACLES: dict[str, str] = {}
