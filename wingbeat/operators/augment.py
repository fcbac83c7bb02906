"""Offline augmentation: partners are planned on ids alone, so that each waveform moves once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import order_key, uniform
from .prefix import in_ranges, running

BUCKET_DIGITS = 3


def _rms(a: Column) -> Column:
    return F.sqrt(F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x), F.size(a)))


def rms_normalised(a: Column) -> Column:
    return F.flatten(F.transform(F.array(_rms(a)), lambda r: F.transform(a, lambda x: F.when(r > 0, x / r).otherwise(x.cast("double")))))


def plan_pairs(df: DataFrame, key: str = "row_id", seed: int = 0) -> DataFrame:
    """(key, partner): the next row in hash order, the first after the last; a row alone has itself.

    Rows are ordered inside buckets of the hash; a bucket's last row gets the first of the next bucket, from a table of
    at most 16 ** BUCKET_DIGITS rows.
    """
    ids = df.select(key).withColumn("_o", order_key(seed, key)).withColumn("_b", F.substring("_o", 1, BUCKET_DIGITS))
    firsts = ids.groupBy("_b").agg(F.min_by(key, F.struct("_o", key)).alias("_f"))
    w = W.orderBy("_b")
    after = firsts.select("_b", F.coalesce(F.lead("_f").over(w), F.first("_f").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("_f"))
    inside = F.lead(key).over(W.partitionBy("_b").orderBy("_o", key))
    return ids.withColumn("partner", inside).join(F.broadcast(after), "_b").select(key, F.coalesce("partner", "_f").alias("partner"))


def mix_pairs(df: DataFrame, p: float = 0.7, snr_min: float = 3.0, snr_max: float = 30.0, mix: str = "union", key: str = "row_id", seed: int = 0) -> DataFrame:
    """With probability p add the partner's waveform, shifted in a circle, at a random signal-to-noise ratio."""
    plan = plan_pairs(df, key, seed).where(F.col("partner") != F.col(key)).where(uniform(f"{seed}-p", key) < p)
    other = df.select(F.col(key).alias("partner"), F.col("samples").alias("_s"), F.col("labels").alias("_l"))
    rows = df.join(plan, key, "left").join(other, "partner", "left")
    n = F.size("_s")
    offset = F.floor(uniform(f"{seed}-o", key) * n).cast("int")
    snr = F.lit(snr_min) + (snr_max - snr_min) * uniform(f"{seed}-snr", key)
    shifted = F.concat(F.slice("_s", F.greatest(n - offset, F.lit(0)) + 1, offset), F.slice("_s", F.lit(1), F.greatest(n - offset, F.lit(0))))
    level = F.try_divide(_rms(F.col("samples")), F.pow(F.lit(10.0), snr / 20))
    noise = F.flatten(F.transform(F.array(F.struct(rms_normalised(shifted).alias("a"), level.alias("g"))), lambda t: F.transform(t["a"], lambda x: x * t["g"])))
    added = F.zip_with(F.col("samples"), noise, lambda x, y: x + F.coalesce(y, F.lit(0.0)))
    out = rows.withColumn("samples", F.when(F.col("_s").isNotNull(), F.slice(added, F.lit(1), F.size("samples"))).otherwise(F.col("samples").cast("array<double>")))
    if mix == "union":
        out = out.withColumn("labels", F.when(F.col("_l").isNotNull(), F.zip_with("labels", "_l", lambda a, b: F.greatest(a, b))).otherwise(F.col("labels")))
    return out.drop("_s", "_l")


def _with_clips(df: DataFrame, noise: DataFrame, p: float, key: str, seed: int, number: str) -> tuple[DataFrame, DataFrame]:
    """The rows picked with probability p, each with a random noise clip (_s), and the others, which aren't moved.

    Clips are numbered here, without gaps, in order of the column `number`; without clips no row is picked.
    """
    draw = F.coalesce(uniform(f"{seed}-p", key) < p, F.lit(False))
    ranges, bucket = in_ranges(noise.select(F.col(number).alias("_order")).where("_order is not null"), "_order")
    ranks = running(ranges, bucket, [F.col("_order")], {"_rank": F.lit(1)}).select("_order", (F.col("_rank") - 1).alias("_no"))
    clips = noise.select(F.col(number).alias("_order"), F.col("samples").alias("_s")).join(ranks, "_order").select("_no", "_s")
    count = noise.where(F.col(number).isNotNull()).agg(F.count(F.lit(1)))
    rows = df.withColumn("_n", count.scalar())
    picked = rows.where(draw & (F.col("_n") > 0)).withColumn("_no", F.floor(uniform(f"{seed}-no", key) * F.col("_n")).cast("long"))
    return picked.join(clips, "_no").drop("_no", "_n"), rows.where(~(draw & (F.col("_n") > 0))).drop("_n")


def inject_nocall(df: DataFrame, noise: DataFrame, p: float = 0.075, key: str = "row_id", seed: int = 0, number: str = "noise_no") -> DataFrame:
    """With probability p replace the waveform by a noise clip, cut or padded to its length, and set all labels to 0.

    A clip without samples (null) leaves the row as it is.
    """
    rows, others = _with_clips(df, noise, p, key, seed, number)
    n, m = F.size("samples"), F.size("_s")
    start = F.floor(uniform(f"{seed}-cut", key) * (F.greatest(m - n, F.lit(0)) + 1)).cast("int")
    clip = F.slice(F.concat(F.slice("_s", start + 1, n), F.array_repeat(F.lit(0.0).cast("float"), n)), F.lit(1), n)
    hit = F.col("_s").isNotNull()
    rows = rows.withColumn("labels", F.when(hit, F.transform("labels", lambda x: x * 0)).otherwise(F.col("labels"))).withColumn("samples", F.when(hit, clip).otherwise(F.col("samples"))).drop("_s")
    return rows.unionByName(others)


def add_noise(df: DataFrame, noise: DataFrame, p: float = 0.5, snr_min: float = 3.0, snr_max: float = 30.0, key: str = "row_id", seed: int = 0, number: str = "noise_no") -> DataFrame:
    """With probability p add background noise at a random ratio; a short clip is repeated until long enough, an empty one adds nothing."""
    rows, others = _with_clips(df, noise, p, key, seed, number)
    n = F.size("samples")
    piece = rms_normalised(F.col("_s"))
    long = F.slice(F.flatten(F.array_repeat(piece, F.ceil(n / F.size("_s")).cast("int"))), F.lit(1), n)
    snr = F.lit(snr_min) + (snr_max - snr_min) * uniform(f"{seed}-snr", key)
    level = F.try_divide(_rms(F.col("samples")), F.pow(F.lit(10.0), snr / 20))
    scaled = F.flatten(F.transform(F.array(F.struct(rms_normalised(long).alias("a"), level.alias("g"))), lambda t: F.transform(t["a"], lambda x: x * t["g"])))
    own = F.col("samples").cast("array<double>")
    rows = rows.withColumn("samples", F.when(F.size("_s") > 0, F.zip_with("samples", scaled, lambda a, b: a + b)).otherwise(own)).drop("_s")
    return rows.unionByName(others.withColumn("samples", own))
