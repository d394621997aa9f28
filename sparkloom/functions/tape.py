"""Deterministic randomness: a hash of (seed, step, keys) that any SQL engine computes alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tape(seed: int, step: int | str, *keys: str | Column) -> Column:
    """Hex md5 of "seed:step:key:..."; ordering by it is a seeded shuffle. Null keys read as "null"."""
    parts = [F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("null")) for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), *parts).cast("binary"))


def uniform(hexes: Column) -> Column:
    """32 leading bits of the tape as a number in [0, 1)."""
    return F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def weighted_key(hexes: Column, weight: Column, mode: str = "exponential") -> Column:
    """Ascending key of a weighted sample without replacement.

    `exponential` is -ln(u) / weight (exact weighted order); `ratio` is
    u / weight, the simpler key some samplers are specified with. Rows without
    positive weight have no key.
    """
    u = uniform(hexes) + F.lit(2.0**-33)
    key = -F.log(u) if mode == "exponential" else uniform(hexes)
    return F.when(weight > 0, key / weight)
