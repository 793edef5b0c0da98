"""Dense numbers for rows in an order, without a task that sees all of them.

Rows are dealt to ranges of the order and sorted within, each range is counted, the counts' running sum is
handed to the ranges, and rows are numbered within. The ranges are written once: their borders come
from a sample, and reading them twice from the source could move rows across.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auralake.scratch import written

_PLACE, _AT, _PART, _BEFORE = "__numbering_place", "__numbering_at", "__numbering_part", "__numbering_before"


def numbered(rows: DataFrame, order: list[Column | str], name: str = "number", start: int = 0, unique: bool = False) -> DataFrame:
    """rows with `name`: start, start + 1, ... in an order; ties are in any order, but each row has a number of its own.

    unique: no two rows are alike in `order`. Else rows are written with a place of their own first, so that
    one value that holds a third of all rows is spread over many ranges. Nulls come first, as in Spark's
    ascending order. Only one count for each range comes to the driver.
    """
    if not unique:
        rows = written(rows.withColumn(_PLACE, F.monotonically_increasing_id()))
        order = [*order, _PLACE]
    # An ascending id holds the range in its upper 31 bits and the place within in its lower 33.
    ranged = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(_AT, F.monotonically_increasing_id()))
    part = F.shiftright(_AT, 33)
    counts = sorted(ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = [(r.part, n) for r, n in zip(counts, accumulate((r.n for r in counts), initial=start), strict=False)]
    offsets = rows.sparkSession.createDataFrame(before, f"{_PART} long, {_BEFORE} long")
    placed = ranged.join(F.broadcast(offsets), part == F.col(_PART))
    number = F.col(_BEFORE) + F.col(_AT).bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn(name, number).drop(_PLACE, _AT, _PART, _BEFORE)


def batches(rows: DataFrame, order: list[Column | str], n: int = 256, unique: bool = False) -> DataFrame:
    """batch and the rows in it as an array: exactly n rows each but for the last, whatever gaps and ties the order has."""
    found = numbered(rows, order, "__number", unique=unique)
    own = F.struct("__number", *[f"`{c}`" for c in rows.columns])
    kept = F.transform(F.array_sort(F.collect_list(own)), lambda r: r.dropFields("__number"))
    return found.groupBy(F.floor(F.col("__number") / n).alias("batch")).agg(kept.alias("rows"))
