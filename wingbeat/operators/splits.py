"""Splits: random ones of exact size, and contiguous ones that never cut a file.

Random ranks are prefix sums over hash buckets. File-wise splits work on a table with one row for each
file, in ranges of names, and are joined back by file. Rows without a filepath are one file, which stands before
all others; so no row is lost.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys
from ..functions.hashing import order_key
from .prefix import hash_bucket, in_name_ranges, running
from .tables import join_null_safe, staged


def ranked(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Adds _rank (from 1, in hash order) and _n."""
    rows = running(df.withColumn("_o", order_key(seed, key)), hash_bucket(F.col("_o")), [F.col("_o"), F.col(key)], {"_rank": F.lit(1)})
    return rows.drop("_o").withColumn("_n", df.agg(F.count(F.lit(1))).scalar())


def train_test_split(df: DataFrame, frac: float, key: str, seed: int = 0) -> DataFrame:
    """Adds split: ceil(n * frac) rows are test."""
    rows = ranked(df, key, seed)
    return rows.withColumn("split", F.when(F.col("_rank") <= F.ceil(F.col("_n") * frac), "test").otherwise("train")).drop("_rank", "_n")


def train_valid_test_split(df: DataFrame, val: float, test: float, key: str, seed: int = 0) -> DataFrame:
    """ceil(n (val + test)) rows are cut off, ceil of the test part of these is test, the rest valid."""
    rows = ranked(df, key, seed).withColumn("_c", F.ceil(F.col("_n") * (val + test)))
    part = F.ceil(F.col("_c") * F.lit(test / (val + test) if val + test else 0.0))
    return rows.withColumn("split", F.when(F.col("_rank") <= part, "test").when(F.col("_rank") <= F.col("_c"), "valid").otherwise("train")).drop("_rank", "_n", "_c")


def ensure_splits(splits: dict[str, DataFrame], key: str, val_split: float = 0.2, test_split: float = 0.2, seed: int = 0) -> dict[str, DataFrame]:
    if "train" in splits and "valid" in splits:
        return splits
    if "train" in splits and "test" in splits:
        if not val_split:
            raise ValueError("val_split is 0 and there is no validation split")
        cut = train_test_split(splits["train"], val_split, key, seed)
        return splits | {"train": cut.where("split = 'train'").drop("split"), "valid": cut.where("split = 'test'").drop("split")}
    cut = train_valid_test_split(next(iter(splits.values())), val_split, test_split, key, seed)
    return {s: cut.where(F.col("split") == s).drop("split") for s in ("train", "valid", "test")}


def split_sites(df: DataFrame) -> DataFrame:
    return df.withColumn("site", keys.site_key(F.col("filepath")))


def _files(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, file, s, e, n): each file's run [s, e) of the n rows of its group, in order of file."""
    counts = rows.groupBy(*by, "file").agg(F.count(F.lit(1)).alias("c"))
    files = running(*in_name_ranges(counts, "file"), [F.col("file")], {"e": F.col("c")}, by=by).drop("_cuts")
    total = counts.groupBy(*by).agg(F.sum("c").alias("n"))
    files = join_null_safe(files, total, by) if by else files.withColumn("n", total.scalar())
    return files.withColumn("s", F.col("e") - F.col("c")).drop("c")


def _with(files: DataFrame, found: DataFrame, by: list[str], column: str) -> DataFrame:
    """files with what was found of each group (one row)."""
    return join_null_safe(files, found, by) if by else files.withColumn(column, found.scalar())


def _holding(place: Callable[[Column], Column], wanted: Column) -> Column:
    """Of an array of places, those within the file's rows."""
    return F.explode(F.filter(wanted, lambda w: (F.col("s") <= place(w)) & (place(w) < F.col("e"))))


def _blocks(df: DataFrame, by: list[str], starts: Column, frac: float) -> DataFrame:
    """All rows once for each fold, with `split`. starts: wanted first rows of the folds, from n.

    A file knows which wanted rows it holds, so that files are searched without a join: the start of a fold's block is
    the nearest boundary of the file that holds its first row, the stop that of the file that holds its last.
    """
    rows = df.withColumn("file", keys.file_key(F.col("filepath")))
    files = staged(_files(rows, by), "files")
    hit = files.select(*by, "s", "e", "n", _holding(lambda w: w["i"], F.transform(starts, lambda i, fold: F.struct(fold.alias("fold"), i.alias("i")))).alias("w"))
    start = F.when(F.col("e") == F.col("n"), F.col("s")).when(F.col("w.i") - F.col("s") > F.col("e") - F.col("w.i"), F.col("e")).otherwise(F.col("s"))
    hit = hit.select(*by, "n", F.col("w.fold").alias("fold"), start.alias("start"))
    last = F.least(F.col("start") + (F.col("n") * F.lit(frac)).cast("long"), F.col("n") - 1)
    ends = hit.groupBy(*by).agg(F.collect_list(F.struct("fold", "start", last.alias("d"))).alias("ends"))  # one entry a fold
    hit = _with(files, ends, by, "ends").select(*by, "s", "e", "n", _holding(lambda w: w["d"], F.col("ends")).alias("w")).select(*by, "s", "e", "n", "w.fold", "w.start")
    bottom = F.when(F.col("s") <= F.col("start") + 1, F.col("start")).otherwise(F.col("s"))
    stop = F.when(F.lit(frac) - (bottom - F.col("start")) / F.col("n") > (F.col("e") - F.col("start")) / F.col("n") - F.lit(frac), F.col("e")).otherwise(bottom)
    bounds = hit.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("fold", "start", stop.alias("stop")))).alias("bounds"))
    inside = lambda b: (F.col("s") >= b["start"]) & (F.col("s") < b["stop"])
    folds = F.transform("bounds", lambda b: F.struct(b["fold"].alias("fold"), F.when(inside(b), "test").otherwise("train").alias("split")))
    parts = _with(files, bounds, by, "bounds").select(*by, "file", folds.alias("_folds"))
    out = join_null_safe(rows, parts, [*by, "file"]).drop("file").withColumn("_fold", F.explode("_folds"))
    return out.withColumns({"fold": F.col("_fold.fold"), "split": F.col("_fold.split")}).drop("_folds", "_fold")


def split_by_file(df: DataFrame, from_idx: int, frac: float) -> DataFrame:
    """A contiguous test block of about frac of the rows, from the file boundary nearest to from_idx."""
    return _blocks(df, [], F.array(F.least(F.lit(from_idx), F.col("n") - 1).cast("long")), frac).drop("fold")


def _fold_starts(k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor(F.col("n") * i / k).cast("long"))


def kfold_by_file(df: DataFrame, k: int) -> DataFrame:
    return _blocks(df, [], _fold_starts(k), 1 / k)


def kfold_by_site(df: DataFrame, k: int) -> DataFrame:
    return _blocks(split_sites(df), ["site"], _fold_starts(k), 1 / k)


def tail_split(df: DataFrame, frac: float, by_site: bool = False) -> DataFrame:
    """The last frac of the rows, from the nearest file boundary, is test."""
    rows, by = (split_sites(df), ["site"]) if by_site else (df, [])
    rows = rows.withColumn("file", keys.file_key(F.col("filepath")))
    files = staged(_files(rows, by), "files").withColumn("i", F.col("n") - (F.col("n") * F.lit(frac)).cast("long"))
    # the boundary is a file's start: the one nearest to i, the earlier of two
    near = files.groupBy(*by).agg(F.min(F.struct(F.abs(F.col("s") - F.col("i")).alias("d"), F.col("s").alias("s"))).alias("b"))
    parts = _with(files, near.select(*by, F.col("b.s").alias("start")), by, "start").select(*by, "file", F.when(F.col("s") >= F.col("start"), "test").otherwise("train").alias("split"))
    return join_null_safe(rows, parts, [*by, "file"]).drop("file")


def last_days_split(df: DataFrame, days: int) -> DataFrame:
    """Test: rows of the last `days` days."""
    rows = df.withColumn("_day", keys.day_key(F.col("filepath")))
    last = rows.select("_day").distinct().orderBy(F.desc("_day")).limit(days).withColumn("split", F.lit("test"))
    return rows.join(F.broadcast(last), "_day", "left").withColumn("split", F.coalesce("split", F.lit("train"))).drop("_day")
