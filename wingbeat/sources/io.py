"""Sources and sinks."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_vocabulary(spark: SparkSession, json_path: str, task: str) -> DataFrame:
    """(label_id, code) from a dataset's metadata."""
    fields = {"multiclass": "features.labels.names", "multilabel": "features.labels.feature.names"}
    if task not in fields:
        raise ValueError(f"unknown task {task!r}")
    return spark.read.json(json_path, multiLine=True).select(F.posexplode(fields[task]).alias("label_id", "code"))


def num_classes(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("num_classes"))


def read_code_list(spark: SparkSession, csv_path: str, column: str) -> DataFrame:
    """(label_id, code) in file order. A multi-line file is never split, so one task numbers its rows."""
    table = spark.read.csv(csv_path, header=True, multiLine=True, escape='"').coalesce(1)
    return table.select(F.monotonically_increasing_id().cast("int").alias("label_id"), F.trim(F.col(f"`{column}`")).alias("code"))


def list_noise_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths alone: files aren't opened."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")


def fingerprint(cfg: dict) -> str:
    return hashlib.sha256(json.dumps(cfg, sort_keys=True, default=str).encode()).hexdigest()[:16]


#: Beside a prepared table's parts, under the fingerprint of the configuration that made it: its schema. Written last of all.
MARK = "_PREPARED"


def _committed(spark: SparkSession, path: str, mark: str) -> bool:
    """Whether the folder was written to its end, by this configuration."""
    jvm = spark._jvm
    at = [jvm.org.apache.hadoop.fs.Path(f"{path}/{name}") for name in ("_SUCCESS", f"{MARK}-{mark}")]
    return all(a.getFileSystem(spark._jsc.hadoopConfiguration()).exists(a) for a in at)


def write_prepared(df: DataFrame, root: str, name: str, seed: int, cfg: dict) -> str:
    """Write by split unless that very configuration has been written; the path.

    The rows are written beside the path and moved to it at the end. A folder that a failed write left there, or that
    holds another mark, is replaced; of several writers at once one moves its folder in, and the others leave theirs out.
    """
    spark, mark = df.sparkSession, fingerprint(cfg)
    path = f"{root}/{name}_processed_{seed}_{mark}"
    if _committed(spark, path, mark):
        return path
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    own, goal = f"{root}/.{name}-{uuid.uuid4().hex}", jvm.org.apache.hadoop.fs.Path(path)
    df.write.partitionBy("split").parquet(own)
    files = goal.getFileSystem(conf)
    out = files.create(jvm.org.apache.hadoop.fs.Path(f"{own}/{MARK}-{mark}"))
    out.write(bytearray(df.schema.json().encode()))
    out.close()
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    source, overwrite = jvm.org.apache.hadoop.fs.Path(own), spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    for _ in range(3):  # a move fails where the folder exists: it is then another's whole one, or a broken one
        try:
            files.rename(source, goal, overwrite)
            return path
        except Py4JJavaError:
            if _committed(spark, path, mark):
                files.delete(source, True)
                return path
            if files.util().exists(goal):
                files.delete(goal, True)
    raise OSError(f"{path} can't be written")


def read_prepared(spark: SparkSession, path: str, split: str) -> DataFrame:
    """The rows of a split of a table that write_prepared() wrote, also of an empty one."""
    jvm = spark._jvm
    found = jvm.org.apache.hadoop.fs.Path(f"{path}/{MARK}-*")
    files = found.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = files.globStatus(found)
    if not marks:
        raise FileNotFoundError(f"{path} was not written to its end")
    text = jvm.org.apache.commons.io.IOUtils.toString(files.open(marks[0].getPath()), "UTF-8")
    return spark.read.schema(T.StructType.fromJson(json.loads(text))).parquet(path).where(F.col("split") == split)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.select("name", "value").write.mode("overwrite").json(path)


def write_codes(df: DataFrame, path: str, column: str) -> None:
    df.select(column).write.mode("overwrite").csv(path, header=True, escape='"')


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (spark.checkpoint.dir); where it is unset and all runs in one process, a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"
