"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of one Arrow batch handed to Python; texts are long, so batches are short.
ARROW_ROWS = 1000
#: Bytes of one side of a join that may be sent to every executor.
BROADCAST_BYTES = 64 << 20


def arrow_rows(spark: SparkSession) -> None:
    """One size for all operators, as queries run later than they are made."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs in one process (tests) a local one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: it is computed once, and outlives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t.written_to)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def rows_of(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The named columns alone, cast; what else the table holds is left out, and so can't clash with names used here."""
    return table.select(*[table[c].cast(kind).alias(c) for c, kind in columns.items()])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(doc_id: str | Column, folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves the given remainder; a null id is held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(folds)) == fold, F.lit(True))


def sample_by_hash(table: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """The `rows` rows of smallest key hash: a repeatable bounded sample, taken as a distributed top-k."""
    return table.orderBy(F.xxhash64(F.lit(seed), F.col(key)), F.col(key)).limit(rows)


def join_sized(big: DataFrame, small: DataFrame, on: str | list[str], how: str, bytes_of: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join with a materialised side: broadcast if the measured sum of bytes_of is within the limit, else by shuffle."""
    size = small.agg(F.coalesce(F.sum(bytes_of), F.lit(0)).cast("long")).first()[0]
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)
