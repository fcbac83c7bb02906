"""Sampling and balancing by repeatable hash order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform_fine
from .prefix import hash_bucket
from .tables import join_null_safe, staged

SALTS = 64
#: Rows of a cell of cumulative weight, on average.
CELL = 4
#: Parts of the largest weight that sampling tells apart; running sums of 2^39 rows still fit.
WEIGHT_PARTS = 1 << 24


def limit_classes(df: DataFrame, label: str, key: str, limit: int, seed: int = 0) -> DataFrame:
    """At most `limit` random rows of a class. Two steps, so that a frequent class isn't ranked in one task: the best of
    each salt hold the best of all."""
    rows = df.withColumn("_o", order_key(seed, key)).withColumn("_s", F.pmod(F.crc32(F.col("_o").cast("binary")), F.lit(SALTS)))
    for by in (["_s"], []):
        w = W.partitionBy(label, *by).orderBy("_o", key)
        rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    return rows.drop("_o", "_s", "_r")


def level_caps(df: DataFrame, class_limit: int | None, event_limit: int | None) -> DataFrame:
    """(label, cap): with distinct group sizes v1 > v2 > ... of a class and T(v) the sum of min(size, v), the first
    size that equals event_limit, is 1, is the last, or after which T would fall under class_limit."""
    sizes = df.groupBy("label", "filepath").agg(F.count(F.lit(1)).alias("v")).groupBy("label", "v").agg(F.count(F.lit(1)).alias("m"))
    down, up = W.partitionBy("label").orderBy(F.desc("v")), W.partitionBy("label").orderBy("v")
    sizes = sizes.withColumn("total", F.sum(F.col("v") * F.col("m")).over(up.rowsBetween(W.unboundedPreceding, 0)) + F.col("v") * F.coalesce(F.sum("m").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    sizes = sizes.withColumn("next", F.lead("total").over(down))
    stop = (F.col("v") == 1) | F.col("next").isNull()
    stop = stop if event_limit is None else stop | (F.col("v") == event_limit)
    stop = stop if class_limit is None else stop | (F.col("next") < class_limit)
    return sizes.where(stop).groupBy("label").agg(F.max("v").alias("cap"))


def level_events(df: DataFrame, class_limit: int | None, event_limit: int | None, key: str = "event_id", seed: int = 0) -> DataFrame:
    """Keep min(size, cap) random rows of every (file, label) group."""
    w = W.partitionBy("label", "filepath").orderBy(order_key(seed, key), key)
    ranked = df.withColumn("_r", F.row_number().over(w))
    return join_null_safe(ranked, level_caps(df, class_limit, event_limit), ["label"]).where("_r <= cap").drop("_r", "cap")


def balance(df: DataFrame, class_limit: int | None, event_limit: int | None, task: str, key: str = "event_id", seed: int = 0) -> DataFrame:
    if class_limit is None and event_limit is None:
        return df
    if task == "multiclass" and event_limit is None:
        return limit_classes(df, "label", key, class_limit, seed)
    return level_events(df, class_limit, event_limit, key, seed)


def weighted_sample(df: DataFrame, weight: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n draws with replacement, by weight: (draw, key). Weights are whole parts of the largest, WEIGHT_PARTS of it at
    most and one at least, so that running sums are exact and each draw meets one row.

    Draws go to a hash bucket first, by the buckets' totals, and then to a row in it: only rows of buckets that are
    drawn are sorted. Both range joins are equi-joins on cells of cumulative weight; what reaches over several cells
    stands in each, and there are as many cells as rows, but for CELL.
    """
    rows = df.where(F.col(weight) > 0)
    rows = rows.withColumn("_most", rows.agg(F.max(weight)).scalar())
    rows = rows.select(key, F.greatest(F.lit(1), F.round(F.col(weight) / F.col("_most") * WEIGHT_PARTS)).cast("long").alias("_w"), order_key(seed, key).alias("_o")).withColumn("_bucket", hash_bucket(F.col("_o")))
    rows = staged(rows, "weighed")  # what makes the rows runs once
    # one row for each of 16 ** DIGITS buckets at most: windows and broadcasts of them are bounded
    buckets = rows.groupBy("_bucket").agg(F.sum("_w").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    buckets = staged(buckets.withColumn("_high", F.sum("_total").over(W.orderBy("_bucket"))), "buckets")
    size = buckets.agg(F.ceil(F.sum("_total") / F.count(F.lit(1))).cast("long"))
    total = buckets.agg(F.sum("_total"))
    cell = lambda x: F.floor(x / F.col("_size")).cast("long")
    cells = F.explode(F.sequence(cell(F.col("_low")), cell(F.col("_high") - 1)))
    spans = buckets.withColumn("_size", size.scalar()).withColumn("_low", F.col("_high") - F.col("_total")).withColumn("_cell", cells).drop("_size")
    draws = df.sparkSession.range(n).withColumn("_t", total.scalar()).withColumn("_size", size.scalar()).where("_t > 0")
    draws = draws.select(F.col("id").alias("draw"), "_size", F.least(F.floor(uniform_fine(f"{seed}-draw", "id") * F.col("_t")), F.col("_t") - 1).alias("_at"))
    draws = draws.withColumn("_cell", cell(F.col("_at"))).join(F.broadcast(spans), "_cell").where("_at >= _low and _at < _high")
    draws = draws.select("draw", "_bucket", (F.col("_at") - F.col("_low")).alias("_at"), F.greatest(F.lit(1), F.ceil(F.col("_total") * CELL / F.col("_rows"))).cast("long").alias("_size"))
    draws = draws.withColumn("_cell", cell(F.col("_at")))
    drawn = draws.groupBy("_bucket").agg(F.first("_size").alias("_size"))
    inside = W.partitionBy("_bucket").orderBy("_o", key).rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(drawn), "_bucket").withColumn("_high", F.sum("_w").over(inside)).withColumn("_low", F.col("_high") - F.col("_w")).withColumn("_cell", cells)
    return draws.join(rows.select(key, "_bucket", "_low", "_high", "_cell"), ["_bucket", "_cell"]).where("_at >= _low and _at < _high").select("draw", key)


def random_subset(df: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """`size` random rows: a distributed top-k, not a sort."""
    return df.orderBy(order_key(seed, key), key).limit(size)
