"""Uniform draws that depend on their keys alone, not on partitions, retries or row order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: Column, method: str = "xxhash64") -> Column:
    """A number in [0, 1) from the seed and the keys.

    ``md5`` takes the leading 32 bits of md5(key|key|...), which other engines
    can compute too; ``xxhash64`` is faster.
    """
    if method == "md5":
        text = F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys])
        return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    if method != "xxhash64":
        raise ValueError(f"unknown draw method: {method}")
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[k.cast("string") for k in keys]), 11)
    return bits.cast("double") / F.lit(float(1 << 53))


def draw_index(u: Column, n: Column) -> Column:
    """1 .. n, uniformly."""
    return (F.floor(u * n) + 1).cast("long")
