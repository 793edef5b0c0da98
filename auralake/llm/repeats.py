"""Removal of repeated strings: every byte covered by a string of `least` bytes that also starts earlier.

Earlier is a smaller doc_id, or an earlier start in the same document; strings are judged on the input,
and matches never cross documents. Where a hash is taken for the bytes it is of, it is two: 64 bits of a
polynomial modulo 2**64, and 62 bits of polynomials modulo two primes over the same bytes:

1. Every window of `least` bytes has one anchor (anchors.py); windows of one anchor and document are a
   block. Anchors whose gram occurs once hold no repeats and go no further: a count of the grams' hashes.
2. Blocks of equal bytes, told by both hashes, are copies: all but the earliest go whole. They meet in a
   map-side aggregate. Blocks with more than HOT copies learn of their earliest one without a shuffle,
   as there is at most one such for HOT blocks; the others by a join that can be split.
3. The earliest blocks that share a gram with other bytes differ somewhere. They are cut into strips of
   windows at most STRIP apart in their distance from the anchor, which share most of their bytes;
   strips of one such core are put through the Burrows-Wheeler expansion (bwt.py), a few thousand bytes
   to a few hundred thousand at a time; the core's bytes, which all their windows hold, are one symbol there. Windows of one interval are equal, and all but the earliest go.
4. A core with more than CORE strips, a passage that very many documents frame differently, would gather
   in one task: its windows are counted one by one instead, again by aggregate and join.

A null id stands before all others but the least of a long, with which it is in an order by hash; a null text is empty. Rows that repeat an id and its text are one
document; texts that share an id are told apart by their hash. Texts shorter than `least` bytes lose
nothing, and long ones are read in pieces that overlap by a window. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auralake.llm.anchors import Checks, Sums, anchors
from auralake.llm.bwt import repeated
from auralake.llm.common import CHUNK_BYTES, chunks, columns_text, cut, flat, small, table

GRAM, STRIP, CORE, HOT = 32, 16, 512, 1024
#: Bytes of strips that are expanded at once.
EXPAND_BYTES = 1 << 19

_KEY = ["d", "t"]


def _pieces(texts: pa.Array, least: int, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, place of the piece in its text, bytes, offsets): several texts of about `size` bytes, or part of a longer one."""
    for i, _, data, offs in chunks(texts, size):
        if len(data) <= 2 * size:
            yield i, 0, data, offs
        else:
            for a in range(0, len(data) - least + 1, size):
                part = data[a : a + size + least - 1]
                yield i, a, part, np.array([0, len(part)])


def _keyed(docs: DataFrame, id: str, text: str) -> DataFrame:
    """doc_id, d (the id, the least number for null), t (0, or the text's hash if texts share the id), text."""
    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.coalesce(F.col(id).cast("long"), F.lit(-(1 << 63))).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    hashed = F.xxhash64("text", F.col("doc_id").isNull())
    shared = cut(rows.groupBy("d").agg(F.min(hashed).alias("a"), F.max(hashed).alias("b")).where("a <> b").select(F.col("d").alias("shared")))
    return rows.join(small(shared), rows["d"] == shared["shared"], "left").select("doc_id", "d", F.when(F.col("shared").isNotNull(), hashed).otherwise(F.lit(0).cast("long")).alias("t"), "text")


def _grams(least: int, size: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offs in _pieces(columns_text(batch, "text"), least, size):
                h = anchors(Sums(data), offs, least, GRAM)[1]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    return found


def _blocks(least: int, size: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, t = batch.column("d").to_numpy(), batch.column("t").to_numpy()
            for row, base, data, offs in _pieces(columns_text(batch, "text"), least, size):
                sums = Sums(data)
                place, h, lo, hi = anchors(sums, offs, least, GRAM)
                g = sums.slices(lo, hi + least, place - lo)
                of = np.searchsorted(offs, lo, "right") - 1
                at = base + lo - offs[of]
                c = Checks(data).slices(lo, hi + least)
                columns = [h.view(np.int64), g.view(np.int64), c, d[row + of], t[row + of], at.astype(np.int32), (hi - lo).astype(np.int32), (place - lo).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], names=["h", "g", "c", "d", "t", "lo", "more", "rel"])

    return found


def _strips(least: int, size: int):
    """Of each listed block of a text its strips: k (a hash of gram, strip and core), bytes, place, and place of the core in them."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            d, t, listed, texts = batch.column("d").to_numpy(), batch.column("t").to_numpy(), batch.column("blocks"), columns_text(batch, "text")
            block, offs = listed.flatten(), np.concatenate([[0], np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False))])
            lo, more, rel, h = (block.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "more", "rel", "h"))
            # Only the part of a text around its blocks is summed: from a to b.
            a, b = np.minimum.reduceat(lo, offs[:-1]), np.maximum.reduceat(lo + more, offs[:-1]) + least
            whole, i = np.concatenate([[0], np.cumsum(b - a)]), 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(whole, whole[i] + size, "right")) - 1)
                own = slice(offs[i], offs[j])
                row = np.repeat(np.arange(i, j), np.diff(offs[i : j + 1]))
                data = b"".join(memoryview(texts[r].as_buffer())[x:y] for r, x, y in zip(range(i, j), a[i:j].tolist(), b[i:j].tolist(), strict=True))
                yield cores(data, d[row], t[row], (whole[row] - whole[i]) - a[row], lo[own], more[own], rel[own], h[own])
                i = j

    def cores(data: bytes, d: np.ndarray, t: np.ndarray, base: np.ndarray, lo: np.ndarray, more: np.ndarray, rel: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        """Strips of blocks whose texts begin at base in data."""
        # Distances of the windows' starts from the anchor run from rel down to rel - more.
        s_lo, s_hi = (rel - more) // STRIP, rel // STRIP
        n = s_hi - s_lo + 1
        of = np.repeat(np.arange(len(lo)), n)
        j = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + s_lo[of]
        anchor, base = (lo + rel)[of], base[of]
        first = anchor - np.minimum(j * STRIP + STRIP - 1, rel[of])
        last = anchor - np.maximum(j * STRIP, (rel - more)[of])
        core = anchor - j * STRIP + base
        k = Sums(np.frombuffer(data, np.uint8)).slices(core, core + least - STRIP + 1, h[of].astype(np.uint64) + j.astype(np.uint64))
        rows = [data[x:y] for x, y in zip((first + base).tolist(), (last + base + least).tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(d[of]), pa.array(t[of]), pa.array(first.astype(np.int32)), pa.array((core - base - first).astype(np.int32)), pa.array(rows, pa.binary())], names=["k", "d", "t", "lo", "core", "bytes"])

    return found


def _later(least: int):
    """Spans of windows that an earlier strip of the same core has as well; rows come sorted by core."""

    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        d, t, lo = (np.concatenate([r.column(c).to_numpy() for r in rows]).astype(np.int64) for c in ("d", "t", "lo"))
        parts = [flat(r.column("bytes").cast(pa.binary())) for r in rows]
        sizes = np.concatenate([np.diff(offs) for _, offs in parts])
        core = np.concatenate([r.column("core").to_numpy() for r in rows]).astype(np.int64)
        data, width = np.concatenate([raw[offs[0] : offs[-1]] for raw, offs in parts]), least - STRIP + 1
        # All windows of a strip hold its core, so that is one symbol for its bytes, and a window STRIP symbols.
        held = (core + np.cumsum(sizes) - sizes)[:, None] + np.arange(width)
        kinds = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(sizes), [None, pa.py_buffer(data[held])]).dictionary_encode().indices.to_numpy()
        symbols, rest = data.astype(np.int64) + 1, np.ones(len(data), bool)
        symbols[held[:, 0]], rest[held[:, 1:]] = 257 + kinds, False
        sizes = sizes - width + 1
        x = np.zeros(int(sizes.sum()) + len(sizes), np.int64)
        starts = np.cumsum(sizes + 1) - sizes - 1
        x[np.arange(sizes.sum()) + np.repeat(np.arange(len(sizes)), sizes)] = symbols[rest]
        at, group = repeated(x, STRIP)
        of = np.repeat(np.arange(len(sizes)), sizes + 1)[at]
        within = at - starts[of]
        fits = within + STRIP <= sizes[of]  # not a suffix that runs into the next strip
        of, within, group = of[fits], within[fits], group[fits]
        if not len(of):
            return None
        start = lo[of] + within
        # Documents by their place in the order; a window's place in it is one number, its start below.
        order = np.lexsort((t, d))
        rank = np.empty(len(d), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (d[order[1:]] != d[order[:-1]]) | (t[order[1:]] != t[order[:-1]])]))
        place = rank[of] << 32 | start
        # The earliest of a group stays, and so does any row that is that very place again. Groups come one after another.
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        gone = place != np.repeat(np.minimum.reduceat(place, head), np.diff(np.append(head, len(group))))
        if not gone.any():
            return None
        both = np.sort(of[gone] << 32 | start[gone])
        new = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1] + 1]))
        last = np.append(new[1:], len(both)) - 1
        of, low = both[new] >> 32, (1 << 32) - 1
        return pa.RecordBatch.from_arrays([pa.array(d[of]), pa.array(t[of]), pa.array((both[new] & low).astype(np.int32)), pa.array(((both[last] & low) + least).astype(np.int32))], names=["d", "t", "s", "e"])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, before = 0, None
        for batch in batches:
            if not len(batch):
                continue
            k, ends = batch.column("k").to_numpy(), np.cumsum(pc.binary_length(batch.column("bytes")).to_numpy(zero_copy_only=False), dtype=np.int64)
            # Rows at which another core begins, and the bytes before each.
            at = np.flatnonzero(np.concatenate([[before is not None and k[0] != before], k[1:] != k[:-1]]))
            done, i, before = np.concatenate([[0], ends])[at], 0, k[-1]
            while (n := int(np.searchsorted(done, EXPAND_BYTES - size + (ends[i - 1] if i else 0)))) < len(at):
                if at[n] > i:
                    held.append(batch.slice(i, at[n] - i))
                if (out := spans(held)) is not None:
                    yield out
                held, size, i = [], 0, int(at[n])
            held.append(batch.slice(i))
            size += int(ends[-1] - (ends[i - 1] if i else 0))
        if held and (out := spans(held)) is not None:
            yield out

    return found


def _windows(least: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, d, t, lo = (batch.column(c) for c in ("bytes", "d", "t", "lo"))
            out: tuple[list, ...] = ([], [], [], [], [])
            for i in range(len(data)):
                raw = np.frombuffer(data[i].as_buffer(), np.uint8)
                s = np.arange(len(raw) + 1 - least)
                for c, v in enumerate((Sums(raw).slices(s, s + least, s * 0).view(np.int64), Checks(raw).slices(s, s + least), np.full(len(s), d[i].as_py()), np.full(len(s), t[i].as_py()), (s + lo[i].as_py()).astype(np.int32))):
                    out[c].append(v)
            if len(data):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["w1", "w2", "d", "t", "lo"])

    return found


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, listed = columns_text(batch, "text"), batch.column("spans")
        n = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        counts, own = pc.fill_null(listed.value_lengths(), 0).to_numpy(zero_copy_only=False), listed.flatten()
        row = np.repeat(np.arange(len(texts)), counts)
        s, e = (own.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("s", "e"))
        order = np.argsort(row << 32 | s)
        s, e = s[order], e[order]
        # How far the spans up to each one reach: those of a later text reach beyond all others.
        far = np.maximum.accumulate(row << 32 | e)
        new = np.flatnonzero(np.concatenate([np.ones(min(1, len(s)), bool), (row[1:] << 32 | s[1:]) > far[:-1]]))
        of, starts, ends = row[new], s[new], far[np.append(new[1:], len(s))[: len(new)] - 1] & (1 << 32) - 1
        runs = np.bincount(of, minlength=len(texts))
        removed = np.bincount(of, ends - starts, len(texts)).astype(np.int64)
        first, hashes = np.concatenate([[0], np.cumsum(runs)]).tolist(), []
        starts, ends = starts.tolist(), ends.tolist()
        for i in range(len(texts)):
            raw, at, kept = memoryview(texts[i].as_buffer()), 0, hashlib.sha256()
            for r in range(first[i], first[i + 1]):
                kept.update(raw[at : starts[r]])
                at = ends[r]
            kept.update(raw[at:])
            hashes.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(removed), pa.array(runs.astype(np.int64)), pa.array(hashes, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _release(spark: SparkSession) -> None:
    """Have the driver drop what finished steps have shuffled: their results are written."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def repeated_spans(docs: DataFrame, least: int = 100, size: int = CHUNK_BYTES) -> DataFrame:
    """Spans to remove, d, t, s (from) and e (to, in bytes), which may overlap; docs as _keyed() gives them."""
    spark = docs.sparkSession
    texts = docs.where(F.octet_length("text") >= least)
    grams = cut(texts.select("text").mapInArrow(_grams(least, size), "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    _release(spark)
    blocks = texts.select("d", "t", "text").mapInArrow(_blocks(least, size), "h long, g long, c long, d long, t long, lo int, more int, rel int")
    blocks = cut(blocks.join(grams.hint("shuffle_hash"), "h"))  # each gram is once in few of the blocks: these need no order
    _release(spark)
    place, same = F.struct("d", "t", "lo"), ["h", "g", "c"]
    heads = cut(blocks.groupBy(*same).agg(F.min(place).alias("head"), F.min("more").alias("more"), F.min("rel").alias("rel"), F.count("*").alias("n")))
    hot = small(cut(heads.where(F.col("n") > HOT).select(*same, "head")))
    crowd = blocks.join(hot, same)
    rest = blocks.join(hot, same, "left_anti").join(heads.where(F.col("n").between(2, HOT)).select(*same, "head"), same)
    copies = crowd.unionByName(rest).where(place != F.col("head"))
    copies = copies.select("d", "t", F.col("lo").alias("s"), (F.col("lo") + F.col("more") + least).alias("e"))

    framed = cut(heads.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1").select("h"))
    listed = heads.join(framed, "h").select("head.d", "head.t", F.struct(F.col("head.lo").alias("lo"), "more", "rel", "h").alias("block"))
    listed = cut(listed.groupBy("d", "t").agg(F.collect_list("block").alias("blocks")))
    _release(spark)
    strips = cut(texts.select("d", "t", "text").join(listed, _KEY).mapInArrow(_strips(least, size), "k long, d long, t long, lo int, core int, bytes binary"))
    _release(spark)
    cores = cut(strips.groupBy("k").agg(F.count("*").alias("n")).where("n > 1"))
    shared = cut(strips.join(cores, "k"))
    few = shared.where(F.col("n") <= CORE).select("k", "d", "t", "lo", "core", "bytes")
    later = few.repartition("k").sortWithinPartitions("k").mapInArrow(_later(least), "d long, t long, s int, e int")
    single = cut(shared.where(F.col("n") > CORE).select("d", "t", "lo", "bytes").mapInArrow(_windows(least), "w1 long, w2 long, d long, t long, lo int"))
    firsts = cut(single.groupBy("w1", "w2").agg(F.min(place).alias("head"), F.count("*").alias("n")).where("n > 1").drop("n"))
    alone = single.join(firsts, ["w1", "w2"]).where(place != F.col("head")).select("d", "t", F.col("lo").alias("s"), (F.col("lo") + least).alias("e"))
    return copies.union(later).union(alone)


def remove_repeats(docs: DataFrame, least: int = 100, id: str = "doc_id", text: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for every row of docs; texts of more than 2 * size bytes are read in pieces."""
    keyed = _keyed(docs, id, text)
    spans = repeated_spans(keyed, least, size).groupBy(*_KEY).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    spans = cut(spans)
    _release(docs.sparkSession)
    return keyed.join(spans, _KEY, "left").select("doc_id", "text", "spans").mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op5_repeats": op5_repeats}
ORACLES: dict[str, str] = {}
