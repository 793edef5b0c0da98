"""Long sequences in pieces, and their pieces put together again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auralake.functions.arrays import indices, let
from auralake.operators.numbering import numbered


def chunk_starts(n: Column, most: int, overlap: int = 0, early_stop: bool = True) -> Column:
    """Starts every most - overlap elements; with early_stop none after a chunk that ran past the end.

    A chunk that ends exactly at the end does not stop the rest: one more, all overlap, follows.
    """
    stride = most - overlap
    starts = indices(n, stride)
    return F.filter(starts, lambda i: (i == 0) | (i - stride + most <= n)) if early_stop else starts


def chunks(a: Column, most: int, overlap: int = 0, early_stop: bool = True) -> Column:
    """Slices of at most `most` elements, each repeating the last `overlap` of the one before."""
    return let(a, lambda x: F.transform(chunk_starts(F.size(x), most, overlap, early_stop), lambda i: F.slice(x, i + 1, F.lit(most))))


def chunk_rows(rows: DataFrame, array: str, most: int, overlap: int = 0, early_stop: bool = True) -> DataFrame:
    """A row for each chunk: its number from 0 as `chunk`, and its elements in place of the array."""
    cut = rows.withColumn("__chunks", chunks(F.col(array), most, overlap, early_stop)).drop(array)
    return cut.select("*", F.posexplode("__chunks").alias("chunk", array)).drop("__chunks")


def prefixes(rows: DataFrame, array: str, lengths: list[int]) -> DataFrame:
    """A row for each length: the array's first elements and the length as `n`."""
    return rows.withColumn("n", F.explode(F.array(*map(F.lit, lengths)))).withColumn(array, F.slice(array, F.lit(1), F.col("n")))


def target_overlap(source_overlap: int, new_target: Column, source_length: Column, first: Column) -> Column:
    """How many target elements repeat `source_overlap` source ones, made even.

    The share is of the source elements that were new: all of the first chunk, all but the overlap of others.
    """
    fresh = source_length - F.when(first, 0).otherwise(source_overlap)
    n = F.ceil(F.lit(source_overlap) * new_target / fresh)
    return (n + F.pmod(n, F.lit(2))).cast("int")


def growing_prompts(rows: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """prompt: all texts of the key up to and with the row's, joined by blanks. The window is as long as a key."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("prompt", F.array_join(F.collect_list(text).over(w), " "))


def chat(rows: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", before: str = "<|", after: str = "|>", end: str = "\n", opening: str = "<|assistant|>") -> DataFrame:
    """One prompt a conversation: each turn as before + role + after + text + end, then the opening of the answer."""
    turns = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("r"), F.col(text).alias("t"))))
    said = F.transform(turns, lambda t: F.concat(F.lit(before), t["r"], F.lit(after), t["t"], F.lit(end)))
    return rows.groupBy(key).agg(F.concat(F.array_join(said, ""), F.lit(opening)).alias("prompt"))


def concat_in_order(rows: DataFrame, key: str, order: str, array: str) -> DataFrame:
    """The key's arrays in order as one array."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(array).alias("a"))))
    return rows.groupBy(key).agg(F.flatten(F.transform(pieces, lambda p: p["a"])).alias(array))


def join_books_in_order(rows: DataFrame, key: str, order: str, books: str) -> DataFrame:
    """The key's matrices in order joined along time, codebook by codebook."""
    pieces = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(books).alias("m"))))
    ordered = F.transform(pieces, lambda p: p["m"])
    return rows.groupBy(key).agg(ordered.alias("__all")).select(key, F.transform(F.get("__all", 0), lambda _, c: F.flatten(F.transform("__all", lambda m: F.get(m, c)))).alias(books))


def run_starts(rows: DataFrame, key: list[str], order: list[str], value: str) -> DataFrame:
    """The rows of each key at which a run of one value begins, in an order without ties within the key.

    Rows are numbered over (key, order) and each meets the one before by its number, so a key that holds most rows is
    spread like any other; no window and no array has all rows of a key.
    """
    found = numbered(rows, [*key, *order], "__at", unique=True)
    before = found.select((F.col("__at") + 1).alias("__at"), *(F.col(c).alias(f"__{i}") for i, c in enumerate([*key, value])))
    same = [F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate([*key, value])]
    met = found.join(before.withColumn("__met", F.lit(True)), "__at", "left")
    return met.where(F.col("__met").isNull() | ~reduce(lambda a, b: a & b, same)).select(*rows.columns)
