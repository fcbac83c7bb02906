"""Running sums over a whole table without a single-task window.

Rows get an explicit bucket that follows the order: the first digits of a hash, or ranges of a number or a string. Sums by
bucket are a small table, windows run inside buckets, and the buckets before are added by join. Ranges come from the rows
themselves and, of a number, from the rows of each group, so that a group whose values lie close together is cut as well
as any other. Groups may be null; a null value stands before all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import join_null_safe

#: Leading hex digits that make a bucket: 16^3 of them, so the table of buckets is always small.
DIGITS = 3
#: A group of at most RANGE_ROWS rows is one bucket, a larger one has PARTS of them.
RANGE_ROWS, PARTS = 50_000, 200
#: Names sampled for each cut of a range of strings.
SAMPLES = 16


def running(df: DataFrame, bucket: Column, order: list[Column], sums: dict[str, Column], by: list[str] | None = None) -> DataFrame:
    """Adds each named running sum up to and with the row (exclusive sums: subtract the row's own). Rows of null groups stay."""
    by = by or []
    rows = df.withColumn("_bucket", bucket)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    group = W.partitionBy(*[F.col(b) for b in by]) if by else W
    before = group.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums])
    inside = W.partitionBy(*[F.col(b) for b in by], F.col("_bucket")).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # without groups there is one row for each bucket, so that rows needn't be shuffled for it
    rows = join_null_safe(rows, totals if by else F.broadcast(totals), [*by, "_bucket"])
    for n, c in sums.items():
        rows = rows.withColumn(n, F.sum(c).over(inside) + F.col(f"_b_{n}"))
    return rows.drop("_bucket", *[f"_b_{n}" for n in sums])


def hash_bucket(key: Column) -> Column:
    return F.substring(key, 1, DIGITS)


def _place(cuts: Column, value: Column) -> Column:
    return F.coalesce(F.size(F.filter(cuts, lambda c: c < value)), F.lit(0))


def in_ranges(df: DataFrame, column: str, by: list[str] | None = None, descending: bool = False) -> tuple[DataFrame, Column]:
    """df with the cuts of each group's values (_cuts), and the bucket of a row: ranges of a number, from a quantile sketch of each group."""
    by = by or []
    shares = ", ".join(f"{i / PARTS}D" for i in range(1, PARTS))
    cuts = F.expr(f"CASE WHEN count(1) > {RANGE_ROWS} THEN array_distinct(percentile_approx(`{column}`, array({shares}), {10 * PARTS})) END AS _cuts")
    if by:
        rows = join_null_safe(df, df.groupBy(*by).agg(cuts), by)
    else:
        rows = df.withColumn("_cuts", df.agg(cuts).scalar())
    bucket = F.coalesce(_place(F.col("_cuts"), F.col(column)), F.lit(0))
    return rows, -bucket if descending else bucket


def in_name_ranges(df: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """As in_ranges, of a string and over all groups: cuts come from a sample of the rows by hash, of bounded size."""
    some = df.select(F.col(column).alias("_name")).where("_name is not null").orderBy(F.xxhash64("_name"), "_name").limit(PARTS * SAMPLES)
    names = some.agg(F.sort_array(F.collect_list("_name")).alias("names")).select(F.expr(f"filter(names, (x, i) -> i % {SAMPLES} = {SAMPLES - 1})"))
    many = df.agg(F.count(F.lit(1)) > RANGE_ROWS)
    rows = df.withColumn("_cuts", F.when(many.scalar(), names.scalar()))
    return rows, F.coalesce(_place(F.col("_cuts"), F.col(column)), F.lit(0))
