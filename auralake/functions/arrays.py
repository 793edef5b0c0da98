"""Array building blocks.

Inside a lambda an expression is evaluated again for every element, and a helper column that is used
once may be put there by the optimiser. let() binds a value once, whatever the optimiser does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def indices(n: Column, step: Column | int = 1) -> Column:
    """0, step, 2 * step, ... below n; empty for n <= 0, where sequence() would count down."""
    step = F.lit(step) if isinstance(step, int) else step
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"), step)).otherwise(F.array().cast("array<int>"))


def empty_like(a: Column) -> Column:
    return F.slice(a, 1, 0)


def take(a: Column, n: Column | int) -> Column:
    """The first n elements; none for n <= 0."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, F.lit(1), F.greatest(n, F.lit(0)))


def drop(a: Column, n: Column | int) -> Column:
    """All but the first n elements."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(a, n + 1, F.greatest(F.size(a) - n, F.lit(0)))


def drop_last(a: Column, n: int) -> Column:
    return take(a, F.size(a) - n)


def tail(a: Column, n: int) -> Column:
    """The last n elements as a[-n:] gives them: all of them for n = 0, and for n beyond the length."""
    if n == 0:
        return a
    return F.when(F.size(a) > 0, F.slice(a, -F.least(F.lit(n), F.size(a)), F.lit(n))).otherwise(a)


def between(a: Column, lo: int, hi: int) -> Column:
    """a[lo:hi], clipped to what is there."""
    return F.slice(a, lo + 1, max(hi - lo, 0))


def odd_length(a: Column) -> Column:
    """Whether the number of elements is odd: two codebooks that are interleaved have lost step."""
    return F.pmod(F.size(a), F.lit(2)) == 1


def even_length(a: Column) -> Column:
    """Without the last element if their number is odd."""
    return take(a, F.size(a) - F.pmod(F.size(a), F.lit(2)))


def distinct_count(a: Column) -> Column:
    return F.size(F.array_distinct(a))


def crop_seconds(wave: Column, rate: Column | int, seconds: int) -> Column:
    """The first seconds of every channel."""
    rate = F.lit(rate) if isinstance(rate, int) else rate
    return F.transform(wave, lambda channel: F.slice(channel, F.lit(1), (rate * seconds).cast("int")))


def merge_settings(base: Column, update: Column) -> Column:
    """A map with the entries of update over those of base, under any policy for repeated keys."""
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(update, k))
    return F.map_concat(kept, update)
