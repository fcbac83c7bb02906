"""Mixing sources to target weights: Sainte-Lague apportionment, in DataFrame operations alone.

The mix has as many words as the input. Sources in code-point order (null last) weigh 5, 2, 1, 5, 2,
1, ...; a source's target stops at `max_repeats` times its size and the excess goes to the others by
weight. The mix is cut into equal blocks of `block` words; Sainte-Lague's method (seats go to the
highest quotients weight / (2 * seats + 1)) gives every source a whole number of blocks and then, by
the same method, every shard of the source its own whole quota. A shard is a seeded hash class of
about `shard_words` words; in it documents stand in seeded order, its words are cut into blocks, and
the quota takes blocks from the front, going round again when the quota exceeds the shard. So no
sort or window covers more than one shard, and a source with a third of all words has many shards.

Quotas don't loop over seats: rounding weight / divisor at divisor = weights / seats is Sainte-Lague's
result for a seat count off by at most half a seat for each party, and only that difference is dealt
out by ranking quotients.

Defined results: a null text has size 0 and is never taken; an empty table gives an empty result; of
repeated doc_ids each row counts. A source whose text is all empty has target 0. Extra columns are
ignored by mixed() and kept by take().
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5.0, 2.0, 1.0)
MAX_REPEATS = 3
BLOCK, SHARD_WORDS, SEED = 16, 1_000_000, "7"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seats(parties: DataFrame, by: list[str], key: list[str], weight: str, total: str) -> DataFrame:
    """Adds `quota`: Sainte-Lague seats of each party by its weight, of the `total` seats of its group. Ties: by key."""
    group = W.partitionBy(*[F.col(c) for c in by]) if by else W.partitionBy(F.lit(0))
    out = parties.withColumn("__sum", F.sum(weight).over(group))
    share = F.when(F.col("__sum") > 0, F.col(weight) * F.col(total) / F.col("__sum")).otherwise(0.0)
    out = out.withColumn("__seats", F.floor(share + 0.5).cast("long"))
    out = out.withColumn("__left", F.when(F.col("__sum") > 0, F.col(total)).otherwise(0) - F.sum("__seats").over(group))
    # of |left| seats a party of share p gets or gives about p * |left|; two more are ranked with them
    most = F.ceil(F.abs("__left") * F.when(F.col("__sum") > 0, F.col(weight) / F.col("__sum")).otherwise(0.0)).cast("int") + 1
    steps = out.where((F.col("__left") != 0) & (F.col(weight) > 0)).withColumn("__k", F.explode(F.sequence(F.lit(0), most)))
    more = F.col("__left") > 0
    seat = F.when(more, F.col("__seats") + F.col("__k")).otherwise(F.col("__seats") - 1 - F.col("__k"))
    steps = steps.withColumn("__seat", seat).where("__seat >= 0").withColumn("__quotient", F.col(weight) / (2 * F.col("__seat") + 1))
    order = group.orderBy(F.when(more, -F.col("__quotient")).otherwise(F.col("__quotient")), *[F.col(c) for c in key])
    steps = steps.withColumn("__rank", F.row_number().over(order)).where("__rank <= abs(__left)")
    changed = steps.groupBy(*by, *key).agg(F.sum(F.signum("__left")).cast("long").alias("__change"))
    both = out.join(changed.withColumnsRenamed({c: f"__{c}" for c in [*by, *key]}), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in [*by, *key]], "left")
    return both.withColumn("quota", F.col("__seats") + F.coalesce("__change", F.lit(0))).select(*parties.columns, "quota")


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size) with `target` words. One row for each source: windows cover the list of sources, not their rows."""
    all_rows = W.partitionBy(F.lit(0))
    out = sources.withColumn("__no", F.row_number().over(all_rows.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("__no") % len(weights) + 1).cast("int"))
    out = out.withColumn("__weight", weight).withColumn("__cap", F.lit(float(max_repeats)) * F.col("source_size"))
    # the caps that are met are those of lowest cap / weight: water rises until the total is reached
    order = all_rows.orderBy(F.col("__cap") / F.col("__weight"), "__no")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))
    open_weight = F.sum("__weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing))
    out = out.withColumn("__level", left / open_weight).withColumn("__capped", F.col("__cap") / F.col("__weight") <= F.col("__level"))
    level = F.max(F.when(~F.col("__capped"), F.col("__level"))).over(all_rows)
    return out.withColumn("target", F.when(F.col("__capped") | level.isNull(), F.col("__cap")).otherwise(level * F.col("__weight"))).select("source", "source_size", "target")


def mixed(sized: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, place) to the same with source_size, target and taken; place tells repeated rows apart."""
    sources = sized.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    sources = C.staged(targets(sources), "targets")
    blocks = sources.agg(F.sum("source_size")).first()[0]
    sources = seats(sources.withColumn("__blocks", F.lit(round((blocks or 0) / block))), [], ["source"], "target", "__blocks")
    sources = sources.withColumn("__shards", F.ceil(F.col("source_size") / shard_words).cast("long"))
    sources = C.staged(sources.withColumnsRenamed({"quota": "__total", "source": "__source"}), "quotas")
    rows = C.join_sized(sized.withColumn("__key", F.coalesce(F.col("source"), F.lit(""))).withColumn("__null", F.col("source").isNull()), sources.select(F.coalesce("__source", F.lit("")).alias("__key"), F.col("__source").isNull().alias("__null"), "source_size", "target", "__total", "__shards"), ["__key", "__null"], "inner", F.length("__key") + 64)
    rows = rows.withColumn("__hash", F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("place")))
    rows = rows.withColumn("__shard", F.pmod(F.col("__hash"), F.greatest(F.col("__shards"), F.lit(1)))).drop("__shards")
    shards = rows.groupBy("__key", "__null", "__shard", "__total").agg(F.sum("size").alias("__words"))
    shards = C.staged(seats(shards.withColumn("__words", F.col("__words").cast("double")), ["__key", "__null"], ["__shard"], "__words", "__total"), "shards")
    shards = shards.select("__key", "__null", "__shard", F.col("__words").cast("long").alias("__words"), "quota")
    rows = C.join_sized(rows.drop("__total"), shards, ["__key", "__null", "__shard"], "inner", F.length("__key") + 32)
    order = W.partitionBy("__key", "__null", "__shard").orderBy(F.xxhash64(F.lit("order"), F.col("__hash")), "doc_id", "place").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    wanted = F.least(F.col("quota") * block, F.col("__words") * MAX_REPEATS)
    rounds = F.floor(wanted / F.greatest(F.col("__words"), F.lit(1)))
    part = F.greatest(F.lit(0), F.least(F.col("size"), wanted - rounds * F.col("__words") - F.col("__before")))
    return rows.withColumn("taken", (rounds * F.col("size") + part).cast("long")).select("doc_id", "source", "place", "size", "source_size", "target", "taken")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, place), staged: texts are read once."""
    texts = C.rows_of(docs, {"doc_id": "long", "source": "string", "text": "string"})
    return C.staged(texts.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.xxhash64("text").alias("place")), "sizes")


def take(docs: DataFrame) -> DataFrame:
    """The documents with `taken`: how many of its words the mix takes, repeats counted (a column of that name is replaced).

    Rows equal in id, source and text share what is taken of them: each gets an equal part, some one word more.
    """
    key = ["doc_id", "source", "place"]
    out = mixed(sizes(docs)).groupBy(*key).agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("copies"))
    mine = [docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), F.xxhash64(docs["text"].cast("string")).alias("place")]
    kept = [c for c in docs.columns if c != "taken"]
    rows = docs.select(F.struct(*[docs[c] for c in kept]).alias("row"), *mine)
    both = rows.join(out.withColumnsRenamed({c: f"__{c}" for c in key}), [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key], "left")
    once = both.where("copies = 1").withColumn("__no", F.lit(1))
    again = both.where("copies > 1").withColumn("__no", F.row_number().over(W.partitionBy(*key).orderBy(F.lit(0))))
    part = F.floor(F.col("taken") / F.col("copies")) + (F.col("__no") <= F.col("taken") % F.col("copies")).cast("long")
    return once.unionByName(again).select("row.*", part.cast("long").alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(sizes(C.documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable] = {"op10_mixing": op10_mixing}
