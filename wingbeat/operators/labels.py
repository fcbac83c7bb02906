"""Label algebra: vocabularies are joined by measured size; logits are reordered by one index array of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import join_sized


def map_codes(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """names (pos, name) with the code of each; where a name has several codes the last one wins."""
    by_name = taxonomy.groupBy("name").agg(F.max_by("code", "pos").alias("code"))
    return names.join(by_name, "name").select("pos", "name", "code")


def unmatched_codes(names: DataFrame, taxonomy: DataFrame) -> DataFrame:
    return names.join(taxonomy.select("name"), "name", "left_anti")


def known_codes(dataset_vocab: DataFrame, model_vocab: DataFrame) -> DataFrame:
    return dataset_vocab.join(model_vocab.select("code"), "code", "left_semi")


def _indexed(df: DataFrame, matched: DataFrame) -> DataFrame:
    """df with _index: for each dataset class, in order, the model's class of the same code. The array is shared by all rows
    as one value, with one number for each class that the row's own logits have one for: it is never larger than a row."""
    index = matched.agg(F.transform(F.sort_array(F.collect_list(F.struct("label_id", "model_id"))), lambda x: x["model_id"]))
    return df.withColumn("_index", index.scalar())


def _matched(model_vocab: DataFrame, dataset_vocab: DataFrame) -> DataFrame:
    """(label_id, model_id) of the dataset's classes, null where the model lacks one."""
    return dataset_vocab.join(model_vocab.select("code", F.col("label_id").alias("model_id")), "code", "left").select("label_id", "model_id")


def _picked(values: str, otherwise: Column) -> Column:
    # both arrays ride along as one argument: computed ones are computed once a row, not once a class
    both = F.array(F.struct(F.col("_index").alias("index"), F.col(values).alias("values")))
    return F.flatten(F.transform(both, lambda t: F.transform(t["index"], lambda i: F.coalesce(F.get(t["values"], i), otherwise))))


def class_mask(df: DataFrame, model_vocab: DataFrame, dataset_vocab: DataFrame) -> DataFrame:
    """Pick and reorder logits (and labels of the same width) to the dataset's classes, all of which must exist."""
    matched = _matched(model_vocab, dataset_vocab)
    if not matched.where("model_id is null").isEmpty():
        raise ValueError("a dataset class is unknown to the model")
    out = _indexed(df, matched).withColumn("logits", _picked("logits", F.lit(None)))
    if "labels" in df.columns:
        width = model_vocab.agg(F.count(F.lit(1)))
        out = out.withColumn("_width", width.scalar()).withColumn("labels", F.when(F.size("labels") == F.col("_width"), _picked("labels", F.lit(None))).otherwise(F.col("labels"))).drop("_width")
    return out.drop("_index")


def restrict_logits(df: DataFrame, model_vocab: DataFrame, dataset_vocab: DataFrame, fill: float = -10.0) -> DataFrame:
    """As class_mask, but classes that the model lacks get `fill`."""
    return _indexed(df, _matched(model_vocab, dataset_vocab)).withColumn("logits", _picked("logits", F.lit(fill)).cast("array<double>")).drop("_index")


def attach_features(rois: DataFrame, features: DataFrame) -> DataFrame:
    """Boxes and features by (recording, roi_no), either may be missing; of columns that both have the boxes' win."""
    keys = ["recording", "roi_no"]
    return rois.join(features.drop(*[c for c in features.columns if c in rois.columns and c not in keys]), keys, "full")


def id_to_code(df: DataFrame, vocab: DataFrame, column: str = "predicted") -> DataFrame:
    return join_sized(df, vocab.select(F.col("label_id").alias(column), "code"), column, "left", F.length("code") + 16)
