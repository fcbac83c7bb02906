"""From a dataset's splits to a prepared table on disk: events, levelling, labels, a validation split, the five columns, one write."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import one_hot
from ..sources.io import write_prepared
from . import balance, events, project, splits, stats
from .tables import staged


@dataclass(frozen=True)
class Settings:
    """What a prepared table depends on; a table is found again by it."""

    name: str
    task: str
    num_classes: int
    class_limit: int | None = None
    event_limit: int | None = None
    val_split: float = 0.2
    seed: int = 0
    biggest: bool = True


def training_rows(known: dict[str, DataFrame], how: Settings) -> dict[str, DataFrame]:
    """Train and test with the prepared columns, `ebird_code` for levelling and `event_id`, a key of the row.

    Only train is mapped to events and levelled. The key is the file and the event's number in it.
    """
    keyed = {s: df.withColumn("_code", F.col("ebird_code")) for s, df in known.items()}
    parts = project.select_task_splits(keyed, how.task, keep=("_code", "event_cluster"))
    train = events.explode_events(parts["train"], how.biggest)
    at = lambda i: F.coalesce(F.col("detected_events")[i].cast("string"), F.lit(""))
    train = train.withColumn("event_id", F.concat_ws("_", "filepath", at(0), at(1)))
    levelled = balance.balance(train.withColumn("label", F.col("_code")), how.class_limit, how.event_limit, how.task, "event_id", how.seed)
    return parts | {"train": levelled.drop("label", "event_cluster")}


def prepare(known: dict[str, DataFrame], how: Settings, root: str) -> str:
    """The path of the prepared table (the five columns and split), which is written unless it is there already.

    The levelled rows are computed once, and ranked once for both sides of the validation split. Multilabel labels
    become one-hot vectors.
    """
    rows = training_rows(known, how)
    train = staged(rows["train"], "levelled")
    ranked = splits.train_test_split(train, how.val_split, "event_id", how.seed)
    parts = [ranked.withColumn("split", F.when(F.col("split") == "test", "valid").otherwise("train"))]
    if "test" in rows:
        parts.append(rows["test"].withColumn("split", F.lit("test")))
    if how.task == "multilabel":
        parts = [p.withColumn("labels", one_hot(F.col("labels"), how.num_classes)) for p in parts]
    out = [p.select(*project.PREPARED, "split") for p in parts]
    whole = out[0] if len(out) == 1 else out[0].unionByName(_as_first(out[1], out[0]))
    return write_prepared(whole, root, how.name, how.seed, asdict(how))


def _as_first(df: DataFrame, first: DataFrame) -> DataFrame:
    """Columns that a split lacks are null in it, of the type that the other has."""
    return df.select(*[F.col(f.name) if df.schema[f.name].dataType == f.dataType else F.col(f.name).cast(f.dataType) if df.schema[f.name].dataType.typeName() != "array" else F.lit(None).cast(f.dataType).alias(f.name) for f in first.schema])


def weighted(prepared: DataFrame) -> DataFrame:
    """Rows of a multiclass table with the weight of their class among them, for sampling."""
    counts = staged(stats.count_labels(prepared, "labels"), "counts")
    return stats.row_weights(prepared.withColumnRenamed("labels", "label"), stats.class_weights(counts), "filepath").withColumnRenamed("label", "labels")
