"""Random numbers that depend on a row's key alone, not on partitions, runs or machines."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(*parts: Column | str | int) -> Column:
    return F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])


def key_bits(*parts: Column | str | int) -> Column:
    """48 bits of the md5 of the key, as bigint."""
    return F.conv(F.substring(F.md5(_key(*parts)), 1, 12), 16, 10).cast("bigint")


def uniform(*parts: Column | str | int) -> Column:
    """Uniform in [0, 1) for a key."""
    return key_bits(*parts) / F.lit(float(2**48))


def integer(low: int, high: int, *parts: Column | str | int) -> Column:
    """Uniform integer from ``low`` up to, but without, ``high``."""
    return (F.lit(low) + F.floor(uniform(*parts) * (high - low))).cast("int")


def choice(options: list, *parts: Column | str | int) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), F.lit(1) + integer(0, len(options), *parts))


def bernoulli(p: Column, *parts: Column | str | int) -> Column:
    return uniform(*parts) < p


def gaussian(*parts: Column | str | int) -> Column:
    """Standard normal (Box-Muller) for a key."""
    u = (key_bits(*parts, "u") + 1) / F.lit(float(2**48))
    v = uniform(*parts, "v")
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
