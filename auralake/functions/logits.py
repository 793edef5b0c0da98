"""Masks and choices over a logits vector."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from auralake.functions.arrays import let


def _masked() -> Column:
    return F.lit("-Infinity").cast("double")


def mask_other_books(logits: Column, past: Column, books: int, size: int, offset: int, stop: int | list[int]) -> Column:
    """Only the ids of the codebook whose turn it is, and the stop ids, keep their logits.

    past is the number of ids generated so far. A negative stop counts from the end.
    """
    lo = offset + F.pmod(past, F.lit(books)) * size

    def of(s: Column) -> Column:
        stops = [stop] if isinstance(stop, int) else list(stop)
        n = F.size(s["l"])
        ends = F.array(*(F.lit(x) if x >= 0 else n + x for x in stops))
        return let(F.struct(s["l"].alias("l"), ends.alias("e"), s["b"].alias("b")), lambda r: F.transform(r["l"], lambda x, i: F.when(((i >= r["b"]) & (i < r["b"] + size)) | F.array_contains(r["e"], i), x).otherwise(_masked())))

    return let(F.struct(logits.alias("l"), lo.cast("int").alias("b")), of)


def masker(**fixed) -> Callable[[Column, Column], Column]:
    """mask_other_books with its layout fixed."""
    return lambda past, logits: mask_other_books(logits, past, **fixed)


def keep_top(logits: Column, k: int) -> Column:
    """Logits below the k-th highest are masked; ties with it stay."""
    cut = F.get(F.sort_array(logits, False), F.least(F.lit(k), F.size(logits)) - 1)
    return let(F.struct(logits.alias("l"), cut.alias("c")), lambda s: F.transform(s["l"], lambda x: F.when(x >= s["c"], x).otherwise(_masked())))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Probabilities at a temperature; masked logits have 0. Greatest and sum are bound outside the lambdas."""

    def weights(s: Column) -> Column:
        return F.transform(s["l"], lambda x: F.exp((x - s["m"]) / F.lit(temperature)))

    def shares(e: Column) -> Column:
        total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
        return let(F.struct(e.alias("e"), total.alias("t")), lambda s: F.transform(s["e"], lambda x: x / s["t"]))

    return let(let(F.struct(logits.alias("l"), F.array_max(logits).alias("m")), weights), shares)


def greedy(logits: Column) -> Column:
    """The id of the highest logit, the first on ties; null for none."""
    at = F.array_position(logits, F.array_max(logits)) - 1
    return F.when(at >= 0, at).cast("int")


def draw(probabilities: Column, u: Column) -> Column:
    """The id at which the running sum passes u (0 to 1): sampling with a number of the caller's."""
    step = F.aggregate(
        probabilities,
        F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("id")),
        lambda a, p: F.struct((a["sum"] + p).alias("sum"), (a["id"] + (a["sum"] + p <= u).cast("int")).alias("id")),
    )
    return F.least(step["id"], F.size(probabilities) - 1)


def uniform(seed: int | str, *key: Column) -> Column:
    """A number in (0, 1) from a seed and a key alone: 52 bits of a hash, the same on any run and in any order."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in key))
    bits = F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def gumbel_top(logits: Column, key: Column, k: int = 1, temperature: float = 1.0, seed: int | str = 0) -> Column:
    """k ids drawn without replacement by the softmax of logits at a temperature, in the order of the draws.

    Each logit is raised by a Gumbel number of (seed, key, place), and the k highest are the draws; key tells rows and
    steps apart, so a rerun draws the same. Masked logits (-inf, null) are never drawn; fewer than k ids if fewer can be. At a
    temperature of 0 the k highest logits are taken, the first on ties.
    """

    def raised(own: Column, i: Column) -> Column:
        if not temperature:
            return own.cast("double")
        return own.cast("double") / F.lit(float(temperature)) - F.log(-F.log(uniform(seed, key, i)))

    scored = F.transform(logits, lambda x, i: F.struct(raised(x, i).alias("s"), (-i).alias("i")))
    able = F.filter(scored, lambda x: x["s"].isNotNull() & ~F.isnan(x["s"]) & (x["s"] > F.lit(float("-inf"))))
    return F.transform(F.slice(F.sort_array(able, False), 1, k), lambda x: (-x["i"]).cast("int"))


def sample(logits: Column, key: Column, top: int | None = None, temperature: float = 1.0, seed: int | str = 0) -> Column:
    """One id drawn by the softmax of the `top` highest logits; null if none can be."""
    kept = keep_top(logits, top) if top else logits
    return F.get(gumbel_top(kept, key, 1, temperature, seed), 0)
