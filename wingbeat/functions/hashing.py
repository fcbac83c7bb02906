"""Repeatable choices: an order and a uniform number for every key, the same on any cluster and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def order_key(seed: int | str, *keys: str | Column) -> Column:
    """md5 of seed and key: ordering by it shuffles rows repeatably."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def uniform(seed: int | str, *keys: str | Column) -> Column:
    """A number in [0, 1) from the same hash."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_fine(seed: int | str, *keys: str | Column) -> Column:
    """As uniform(), of 52 bits: for more rows than 32 bits tell apart."""
    return F.conv(F.substring(order_key(seed, *keys), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
