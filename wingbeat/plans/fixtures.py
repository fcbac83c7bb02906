"""Views over the given tables in the schemas that the operators take; the SQL text runs alike in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EV = """SELECT concat('f', CAST(l_orderkey AS STRING)) AS filepath, CAST(l_orderkey % 10 AS INT) AS label, CAST(pos AS INT) AS pos,
  CAST(10*pos + l_linenumber AS DOUBLE) AS s, CAST(10*pos + l_linenumber AS DOUBLE) + CAST(l_quantity AS DOUBLE)/10 AS e, cl,
  concat('f', CAST(l_orderkey AS STRING), '_', CAST(pos AS STRING)) AS event_id
 FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1 AS pos,
  CAST(l_suppkey % 4 AS INT) - 1 AS cl FROM {lineitem}) x"""

SEG = """SELECT concat(base, '_', CAST(5*rn AS STRING), '_', CAST(5*rn+5 AS STRING)) AS filepath, CAST(5*rn AS DOUBLE) AS start_time, CAST(5*rn+5 AS DOUBLE) AS end_time, event_type
 FROM (SELECT base, event_type, row_number() OVER (PARTITION BY base ORDER BY ts, event_id) - 1 AS rn
  FROM (SELECT *, concat('REC_S0', CAST(user_id % 4 AS STRING), '_', replace(CAST(CAST(ts AS DATE) AS STRING), '-', ''), '_',
   lpad(CAST(CAST(floor(extract(hour FROM ts)/6)*6 AS INT) AS STRING), 2, '0'), '0000') AS base FROM {events}) a) b"""

_PRED = """SELECT vec_id AS row_id, c AS class, CAST(score AS DOUBLE) AS score,
 CAST(CASE WHEN vec_id % 5 = 0 THEN 0 WHEN label = c OR (vec_id + c) % 11 = 0 THEN 1 ELSE 0 END AS INT) AS target FROM {logits}"""
PRED_DUCK = _PRED.replace("{logits}", "(SELECT vec_id, label, c, embedding[c+1] AS score FROM embeddings, range(10) t(c)) l")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EV, lineitem=table(spark, sf_dir, "lineitem"))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ev(spark, sf_dir).groupBy("filepath", "label").agg(F.sort_array(F.collect_list(F.struct("pos", "s", "e", "cl"))).alias("x"))
    return g.select("filepath", "label", F.transform("x", lambda t: F.array(t["s"], t["e"])).alias("detected_events"), F.transform("x", lambda t: t["cl"]).alias("event_cluster"), (F.size("x") * 10.0 + 5).alias("length"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SEG, events=table(spark, sf_dir, "events"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.slice("embedding", 1, 10)).alias("c", "score"))


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_PRED, logits=logits(spark, sf_dir))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pred with one row for each row_id: scores, targets."""
    target = lambda x, i: F.when(F.col("vec_id") % 5 == 0, 0).when((F.col("label") == i) | ((F.col("vec_id") + i) % 11 == 0), 1).otherwise(0)
    first = F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), first.alias("scores"), F.transform(first, target).alias("targets"), F.col("label").alias("true"))


def waveforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.arrays import one_hot

    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("samples"), one_hot(F.array("label"), 10).alias("labels"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label_id, code): the distinct event types in order, ranked in ranges of names."""
    from ..operators.prefix import in_name_ranges, running

    codes = table(spark, sf_dir, "events").select(F.col("event_type").alias("code")).distinct()
    ranked = running(*in_name_ranges(codes, "code"), [F.col("code")], {"rank": F.lit(1)})
    return ranked.select((F.col("rank") - 1).cast("int").alias("label_id"), "code")
