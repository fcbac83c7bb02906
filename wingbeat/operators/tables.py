"""Tables between steps, and joins by measured size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.io import scratch

#: Bytes of one side of a join that may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it is computed once, and outlives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(big: DataFrame, small: DataFrame, on: str | list[str], how: str, bytes_of: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a materialised side: broadcast if the measured sum of bytes_of is within the limit, else by shuffle."""
    size = small.agg(F.coalesce(F.sum(bytes_of), F.lit(0)).cast("long")).first()[0]
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join by columns of both sides, which match where both are null too; the left side's stay."""
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    out = left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_right_{c}")) for c in on], how)
    return out.drop(*[f"_right_{c}" for c in on])
