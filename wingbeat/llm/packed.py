"""Sums of long number arrays over partitions: each task sends its array in a few binary slices, which are added up in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICES = 32


def pack(values: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(slice, part) rows of an array whose length is a multiple of SLICES; slices of zeros aren't sent."""
    parts = values.reshape(SLICES, -1)
    some = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([parts[i].tobytes() for i in some], pa.binary())], names=["slice", "part"])


def unpacked_sum(rows: DataFrame, size: int, kind: type, salts: int = 8) -> np.ndarray:
    """Add up the tasks' slices: first within salted groups, so that no group grows with the number of tasks."""

    def added(table: pa.Table) -> pa.Table:
        total = np.zeros(size // SLICES, kind)
        for x in table["part"]:
            total += np.frombuffer(x.as_buffer(), kind)
        return pa.table({"slice": table["slice"][:1], "part": pa.array([total.tobytes()], pa.binary())})

    salted = rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    once = salted.groupBy("slice", "salt").applyInArrow(added, "slice int, part binary")
    out = np.zeros((SLICES, size // SLICES), kind)
    for r in once.groupBy("slice").applyInArrow(added, "slice int, part binary").collect():  # `size` numbers in all
        out[r["slice"]] = np.frombuffer(r["part"], kind)
    return out.reshape(-1)
