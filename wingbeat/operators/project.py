"""Projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PREPARED = ["filepath", "labels", "detected_events", "start_time", "end_time"]


def select_task_splits(splits: dict[str, DataFrame], task: str, keep: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """multiclass: train and test with ebird_code; multilabel: train and test_5s (as test) with ebird_code_multilabel.
    keep: columns that a later step needs beside the prepared ones."""
    names, label = {"multiclass": ({"train": "train", "test": "test"}, "ebird_code"), "multilabel": ({"train": "train", "test_5s": "test"}, "ebird_code_multilabel")}[task]
    return {new: splits[old].drop("labels").withColumnRenamed(label, "labels").select(*[c if c in splits[old].columns or c == "labels" else F.lit(None).alias(c) for c in [*PREPARED, *keep]]) for old, new in names.items() if old in splits}


def select_inference(df: DataFrame, num_classes: int) -> DataFrame:
    """The test_5s rows with one-hot labels."""
    from ..functions.arrays import one_hot

    return df.where("split = 'test_5s'").select("filepath", one_hot(F.col("labels"), num_classes).alias("labels"))


def fold_filter(df: DataFrame, train_folds: tuple[int, ...] = (0, 1, 2, 3), test_folds: tuple[int, ...] = (4,)) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("fold").isin(*train_folds)), df.where(F.col("fold").isin(*test_folds))


def roi_filter(rois: DataFrame, max_ratio: float = 7.0, min_duration: float = 0.5, min_area: float | None = None, max_area: float | None = None) -> DataFrame:
    dx, dy = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    out = rois.where((dx > 0) & (dy > 0)).where((dy < max_ratio * dx) & (F.col("max_t") - F.col("min_t") > min_duration))
    out = out if min_area is None else out.where(dx * dy >= min_area)
    return out if max_area is None else out.where(dx * dy <= max_area)
