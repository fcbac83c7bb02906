"""Counts, weights and statistics of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def count_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n) for every id from 0 to the largest."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).count()
    ids = counts.agg(F.max("label").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(0), F.col("m"))).alias("label"))
    return ids.join(counts, "label", "left").select("label", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def class_weights(counts: DataFrame, on_zero: float = 0.0) -> DataFrame:
    """(label, n) to weight (n / total) ** -0.5; classes without rows get on_zero."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", F.when(F.col("n") > 0, F.pow(F.col("n") / F.col("total"), F.lit(-0.5))).otherwise(on_zero).alias("weight"))


def row_weights(df: DataFrame, weights: DataFrame, key: str, multilabel: bool = False) -> DataFrame:
    """Weight of the label, or the sum over the labels of a row."""
    if not multilabel:
        return df.join(weights.withColumnRenamed("weight", "row_weight"), "label")
    flat = df.select(key, F.explode_outer("labels").alias("label")).join(weights, "label", "left")
    return df.join(flat.groupBy(key).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("row_weight")), key)


def label_stats(df: DataFrame, splits: list[str], labels: str = "labels") -> DataFrame:
    """Occurrences of every label in each split, 0 where absent."""
    flat = df.select("split", F.explode(labels).alias("label"))
    return flat.groupBy("label").agg(*[F.count(F.when(F.col("split") == s, 1)).alias(s) for s in splits])


def label_shares(stats: DataFrame, splits: list[str]) -> DataFrame:
    total = sum((F.col(s) for s in splits[1:]), F.col(splits[0]))
    return stats.select("label", *[(F.col(s) / total).alias(f"{s}_share") for s in splits])


def distinct_labels(df: DataFrame, labels: str = "labels") -> DataFrame:
    """Number of distinct labels of each split and over all (split null)."""
    flat = df.select("split", F.explode(labels).alias("label")).distinct()
    return flat.groupBy("split").agg(F.count("label").alias("n")).unionByName(flat.select("label").distinct().agg(F.lit(None).cast("string").alias("split"), F.count("label").alias("n")))


def dataset_summary(df: DataFrame, by: str, label: str) -> DataFrame:
    """Rows, species and Pielou's evenness J = H / ln S of each dataset."""
    counts = df.groupBy(by, label).agg(F.count(F.lit(1)).alias("n"))
    h = counts.groupBy(by).agg(F.sum("n").alias("rows"), F.count(label).alias("species"), (F.log(F.sum("n")) - F.sum(F.col("n") * F.log("n")) / F.sum("n")).alias("h"))
    return h.select(by, "rows", "species", F.when(F.col("species") > 1, F.col("h") / F.log("species")).alias("evenness"))


def mean_std(df: DataFrame, values: str) -> DataFrame:
    """Mean and population deviation over all elements of all arrays, by three sums for each row."""
    a = F.col(values)
    add = lambda f: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    rows = df.where(a.isNotNull()).select(add(lambda x: x).alias("s"), add(lambda x: x * x).alias("q"), F.size(a).alias("n"))
    out = rows.agg(F.sum("s").alias("s"), F.sum("q").alias("q"), F.sum("n").alias("n"))
    mean = F.try_divide(F.col("s"), F.col("n"))
    return out.select(mean.alias("mean"), F.sqrt(F.try_divide(F.col("q"), F.col("n")) - mean * mean).alias("std"))


def best_value(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("name").agg(F.max("value").alias("best"))


def keep_label(clusters: DataFrame, keep: str = "BIGGEST") -> DataFrame:
    """Adds keep_label: 1 for rows of a recording's most frequent cluster >= 0 (ties: smallest), or of any cluster >= 0."""
    if keep == "ALL":
        return clusters.withColumn("keep_label", (F.col("cluster") >= 0).cast("int"))
    counts = clusters.where("cluster >= 0").groupBy("recording", "cluster").count()
    best = counts.groupBy("recording").agg(F.max(F.struct(F.col("count"), (-F.col("cluster")).alias("neg"))).alias("b")).select("recording", (-F.col("b.neg")).alias("_best"))
    return clusters.join(best, "recording", "left").withColumn("keep_label", F.coalesce(F.col("cluster") == F.col("_best"), F.lit(False)).cast("int")).drop("_best")


def first_rows(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("_r") <= n).drop("_r")
