"""Keys parsed from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _cut(path: Column, parts: int) -> Column:
    return F.regexp_replace(path, f"(_[^_]*){{{parts}}}$", "")


def file_key(path: Column) -> Column:
    """Without its last two parts (start and end), and without folders. A name with fewer parts stays as it is."""
    return F.substring_index(_cut(path, 2), "\\", -1)


def site_key(path: Column) -> Column:
    return F.right(_cut(path, 4), F.lit(3))


def day_key(path: Column) -> Column:
    return F.right(_cut(path, 3), F.lit(8))
