"""All registered queries and their SQL. Doubles are rounded to 6 digits, since sums differ by order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, keys
from ..operators import augment, balance, batches, cluster, events, labels, metrics, prepare, project, splits, stats
from ..operators.tables import staged
from ..sources import io
from ..streaming import streams
from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_EV = "ev AS (" + X.EV.replace("{lineitem}", "lineitem") + ")"
_SEG = "seg AS (" + X.SEG.replace("{events}", "events") + ")"
_PRED = "pred AS (" + X.PRED_DUCK + ")"
#: Events left after noise is dropped and after the biggest cluster is kept.
_KEPT = (
    _EV + ", c AS (SELECT *, count(*) OVER (PARTITION BY filepath) AS total FROM ev), d AS (SELECT * FROM c WHERE cl <> -1 OR total = 1),"
    " m AS (SELECT filepath, cl, count(*) AS n FROM d GROUP BY filepath, cl), b AS (SELECT filepath, cl, row_number() OVER (PARTITION BY filepath ORDER BY n DESC, cl) AS r FROM m),"
    " k AS (SELECT d.* FROM d JOIN b ON d.filepath = b.filepath AND d.cl = b.cl WHERE r = 1)"
)
_ROWS = (
    _KEPT + ", x AS (SELECT filepath, label, s, e, cl FROM k UNION ALL SELECT filepath, label, 0.0, 5.0, NULL FROM (SELECT DISTINCT filepath, label FROM ev WHERE filepath NOT IN (SELECT filepath FROM k)) z)"
)
_U = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0)"
R = lambda c: F.round(c, 6)


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def flat(df: DataFrame) -> DataFrame:
    """Exploded rows with the interval as two columns."""
    return df.select("filepath", "label", R(F.col("detected_events")[0]).alias("s"), R(F.col("detected_events")[1]).alias("e"), F.get("event_cluster", F.lit(0)).alias("cl"))


def event_list(df: DataFrame) -> DataFrame:
    return df.select("filepath", F.posexplode(F.arrays_zip("detected_events", "event_cluster")).alias("no", "z")).select("filepath", R(F.col("z.detected_events")[0]).alias("s"), F.col("z.event_cluster").alias("cl"))


# ---- events ----


_PREPARED = f"""WITH {_ROWS}, k0 AS (SELECT *, filepath || '_' || CAST(s AS VARCHAR) || '_' || CAST(e AS VARCHAR) AS k FROM (SELECT filepath, label, s::DOUBLE AS s, e::DOUBLE AS e, cl FROM x)), g AS (SELECT label, filepath, count(*) AS c FROM k0 GROUP BY 1, 2), v AS (SELECT DISTINCT label, c AS v FROM g),
 t AS (SELECT v.label, v.v, sum(least(g.c, v.v)) AS total FROM v JOIN g ON v.label = g.label GROUP BY 1, 2), n AS (SELECT *, lead(total) OVER (PARTITION BY label ORDER BY v DESC) AS next FROM t),
 cap AS (SELECT label, max(v) AS cap FROM n WHERE v = 2 OR v = 1 OR next IS NULL OR next < 500 GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY label, filepath ORDER BY md5('0|' || k), k) AS r FROM k0), kept AS (SELECT r.* FROM r JOIN cap ON r.label = cap.label WHERE r.r <= cap),
 w AS (SELECT label, count(*) AS n FROM kept GROUP BY 1), z AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || k), k) AS place, count(*) OVER () AS rows FROM kept)
 SELECT z.filepath, z.label AS labels, round(s, 6) AS s, round(e, 6) AS e, NULL::DOUBLE AS start_time, NULL::DOUBLE AS end_time, CASE WHEN place <= ceil(rows * 0.2) THEN 'valid' ELSE 'train' END AS split, round(pow(w.n / (SELECT sum(n) FROM w), -0.5), 6) AS row_weight FROM z JOIN w ON z.label = w.label
 UNION ALL SELECT filepath, label, NULL, NULL, pos * 5.0::DOUBLE, pos * 5.0::DOUBLE + 5, 'test', NULL FROM ev"""


@query("prepare_training_set", _PREPARED)
def prepare_training_set(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings to training rows and segments to test rows: task columns, events, levelling, a validation split, written and read back; weights."""
    train = X.recordings(spark, sf).withColumnsRenamed({"label": "ebird_code"}).drop("length")
    test = X.ev(spark, sf).select("filepath", F.col("label").alias("ebird_code"), (F.col("pos") * 5.0).alias("start_time"), (F.col("pos") * 5.0 + 5).alias("end_time"))
    train = train.withColumns({"start_time": F.lit(None).cast("double"), "end_time": F.lit(None).cast("double")})
    how = prepare.Settings("ev", "multiclass", 10, 500, 2)
    path = prepare.prepare({"train": train, "test": test}, how, io.scratch(spark, "prepared"))
    known = prepare.weighted(spark.read.parquet(path).where("split <> 'test'"))
    out = known.unionByName(io.read_prepared(spark, path, "test").withColumn("row_weight", F.lit(None).cast("double")))
    at = lambda i: R(F.get("detected_events", F.lit(i)))
    return out.select("filepath", "labels", at(0).alias("s"), at(1).alias("e"), "start_time", "end_time", "split", R(F.col("row_weight")).alias("row_weight"))


@query("prepare_multilabel", f"""WITH {_ROWS}, h AS (SELECT filepath, s::DOUBLE AS s, e::DOUBLE AS e, filepath || '_' || CAST(s::DOUBLE AS VARCHAR) || '_' || CAST(e::DOUBLE AS VARCHAR) AS k, label FROM x),
 z AS (SELECT *, row_number() OVER (ORDER BY md5('3|' || k), k) AS place, count(*) OVER () AS rows FROM h), j AS (SELECT filepath, s, e, label, CASE WHEN place <= ceil(rows * 0.25) THEN 'valid' ELSE 'train' END AS split FROM z
  UNION ALL SELECT filepath, NULL, NULL, label, 'test' FROM (SELECT DISTINCT filepath, label FROM ev) q)
 SELECT filepath, round(s, 6) AS s, round(e, 6) AS e, split, i AS class, (i = label OR i = (label + 1) % 10)::INT::FLOAT AS hot FROM j, range(10) t(i)""")
def prepare_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    """The multilabel branch, without limits: one-hot vectors of the labels that a recording has."""
    rows = X.recordings(spark, sf).withColumnsRenamed({"label": "ebird_code"}).drop("length")
    rows = rows.withColumn("ebird_code_multilabel", F.array("ebird_code", ((F.col("ebird_code") + 1) % 10).cast("int"))).withColumns({"start_time": F.lit(None).cast("double"), "end_time": F.lit(None).cast("double")})
    segments = rows.select("filepath", "ebird_code", "ebird_code_multilabel", "start_time", "end_time")
    path = prepare.prepare({"train": rows, "test_5s": segments}, prepare.Settings("ev", "multilabel", 10, val_split=0.25, seed=3), io.scratch(spark, "prepared"))
    out = spark.read.parquet(path)
    at = lambda i: R(F.get("detected_events", F.lit(i)))
    return out.select("filepath", at(0).alias("s"), at(1).alias("e"), F.col("split").cast("string").alias("split"), F.posexplode("labels").alias("class", "hot")).withColumn("class", F.col("class").cast("long"))


@query("count_labels", f"WITH {_EV}, n AS (SELECT label * 2 AS label, count(*) AS n FROM ev GROUP BY 1) SELECT CAST(g.i AS INT) AS label, coalesce(n.n, 0)::BIGINT AS n FROM (SELECT unnest(range((SELECT max(label) + 1 FROM n)::BIGINT)) AS i) g LEFT JOIN n ON n.label = g.i")
def count_labels(spark: SparkSession, sf: str) -> DataFrame:
    return stats.count_labels(X.ev(spark, sf).select((F.col("label") * 2).alias("label")))


@query("select_task_splits", f"WITH {_EV}, r AS (SELECT filepath, label, count(*) AS n FROM ev GROUP BY 1, 2) SELECT filepath, CASE k WHEN 0 THEN 'multiclass train' WHEN 1 THEN 'multiclass test' WHEN 2 THEN 'multilabel train' ELSE 'multilabel test' END AS part, CASE k WHEN 0 THEN label WHEN 1 THEN label WHEN 2 THEN -label ELSE -label - 1 END AS labels, CASE WHEN k < 3 THEN n ELSE NULL END AS n FROM r, range(4) t(k)")
def select_task_splits(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.recordings(spark, sf).withColumn("ebird_code_multilabel", -F.col("label")).withColumnRenamed("label", "ebird_code")
    segments = rows.drop("detected_events").withColumn("ebird_code_multilabel", F.col("ebird_code_multilabel") - 1)
    out = None
    for task in ("multiclass", "multilabel"):
        for name, part in project.select_task_splits({"train": rows, "test": rows, "test_5s": segments}, task).items():
            part = part.select("filepath", F.lit(f"{task} {name}").alias("part"), "labels", (F.size("detected_events").cast("long") if part.schema["detected_events"].dataType.typeName() == "array" else F.lit(None).cast("long")).alias("n"))
            out = part if out is None else out.unionByName(part)
    return out


@query("drop_noise_events", f"WITH {_KEPT} SELECT filepath, round(s, 6) AS s, cl FROM d")
def drop_noise_events(spark: SparkSession, sf: str) -> DataFrame:
    return event_list(events.drop_noise_events(X.recordings(spark, sf)))


@query("biggest_cluster", f"WITH {_KEPT} SELECT filepath, round(s, 6) AS s, cl FROM k")
def biggest_cluster(spark: SparkSession, sf: str) -> DataFrame:
    return event_list(events.biggest_cluster(events.drop_noise_events(X.recordings(spark, sf))))


@query("explode_events", f"WITH {_ROWS} SELECT filepath, label, round(s, 6) AS s, round(e, 6) AS e, cl FROM x")
def explode_events(spark: SparkSession, sf: str) -> DataFrame:
    return flat(events.explode_events(X.recordings(spark, sf)))


@query("event_rows", ORACLES["explode_events"])
def event_rows(spark: SparkSession, sf: str) -> DataFrame:
    return flat(batches.event_rows(X.recordings(spark, sf)))


@query("event_rows_sql", f"WITH {_KEPT}, x AS (SELECT filepath, s, e, cl FROM d UNION ALL SELECT DISTINCT filepath, 0.0, 5.0, NULL::INT FROM ev WHERE filepath NOT IN (SELECT filepath FROM d)) SELECT filepath, count(*) AS n, round(sum(e - s), 4) AS seconds, count(cl) AS events FROM x GROUP BY 1")
def event_rows_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The table function in a SQL query, with all clusters but noise."""
    batches.register_event_rows(spark)
    return spark.sql(
        "SELECT filepath, count(*) AS n, round(sum(t.detected_events[1] - t.detected_events[0]), 4) AS seconds, count_if(size(t.event_cluster) > 0) AS events"
        " FROM {recordings} r, LATERAL event_rows(r.detected_events, r.event_cluster, false) t GROUP BY filepath",
        recordings=X.recordings(spark, sf),
    )


_GAPS = f"""WITH {_EV}, g AS (SELECT filepath, coalesce(lag(e) OVER w, 0.0) AS a, s AS b FROM ev WINDOW w AS (PARTITION BY filepath ORDER BY pos)
 UNION ALL SELECT filepath, max_by(e, pos), count(*) * 10.0 + 5 FROM ev GROUP BY filepath) SELECT filepath, round(a, 6) AS gap_start, round(b, 6) AS gap_end FROM g WHERE a < b"""


@query("nocall_gaps", _GAPS)
def nocall_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return events.nocall_gaps(X.recordings(spark, sf)).select("filepath", F.explode("gaps").alias("g")).select("filepath", R(F.col("g")[0]).alias("gap_start"), R(F.col("g")[1]).alias("gap_end"))


@query("choose_interval", f"WITH {_EV} SELECT event_id, round(CASE WHEN pos % 3 = 0 THEN s WHEN pos % 3 = 1 THEN 1.5 END, 6) AS a, round(CASE WHEN pos % 3 = 0 THEN e WHEN pos % 3 = 1 THEN 6.5 END, 6) AS b FROM ev")
def choose_interval(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf).select("event_id", F.when(F.col("pos") % 3 == 0, F.array("s", "e")).alias("detected_events"), F.when(F.col("pos") % 3 == 1, 1.5).alias("start_time"), F.when(F.col("pos") % 3 == 1, 6.5).alias("end_time"))
    return events.choose_interval(rows).select("event_id", R(F.get("interval", F.lit(0))).alias("a"), R(F.get("interval", F.lit(1))).alias("b"))


@query("shift_window", f"""WITH {_EV}, a AS (SELECT event_id, s, e, 60.0 AS d, {_U.format("'3|' || event_id")} AS u, (8.0 - (e - s)) / 2 AS m FROM ev),
 b AS (SELECT *, CASE WHEN e - s >= 8 THEN s WHEN s - m < 0 THEN 0.0 WHEN e + m > d THEN greatest(0.0, d - 8) ELSE s - m END AS lo,
  CASE WHEN e - s >= 8 THEN e WHEN s - m < 0 THEN least(8.0, d) WHEN e + m > d THEN d ELSE e + m END AS hi FROM a)
 SELECT event_id, round(lo + (greatest(0.0, hi - 5) - lo) * u, 6) AS cut_start, round(lo + (greatest(0.0, hi - 5) - lo) * u + 5, 6) AS cut_end FROM b""")
def shift_window(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf).withColumn("duration", F.lit(60.0))
    return events.shift_window(rows, "event_id", seed=3).select("event_id", R(F.col("cut_start")).alias("cut_start"), R(F.col("cut_end")).alias("cut_end"))


@query("clamp_interval", f"WITH {_EV} SELECT event_id, round(s, 6) AS new_start, round(CASE WHEN e - s < 1 THEN s + 1 WHEN e - s > 2 THEN s + 2 ELSE e END, 6) AS new_end, CAST(s * 100 AS INT) AS first_sample FROM ev")
def clamp_interval(spark: SparkSession, sf: str) -> DataFrame:
    return events.clamp_interval(X.ev(spark, sf), 1.0, 2.0, 100).select("event_id", R(F.col("new_start")).alias("new_start"), R(F.col("new_end")).alias("new_end"), "first_sample")


@query("center_window", f"""WITH {_EV}, a AS (SELECT event_id, s - greatest(0.0, 5 - (e - s)) / 2 AS lo, e + greatest(0.0, 5 - (e - s)) / 2 AS hi, 60.0 AS d FROM ev),
 b AS (SELECT event_id, CASE WHEN lo < 0 THEN 0.0 WHEN hi > d THEN greatest(0.0, lo - (hi - d)) ELSE lo END AS x, CASE WHEN lo < 0 THEN least(d, hi - lo) WHEN hi > d THEN d ELSE hi END AS y FROM a)
 SELECT event_id, round(x, 6) AS new_start, round(least(y, x + 5), 6) AS new_end FROM b""")
def center_window(spark: SparkSession, sf: str) -> DataFrame:
    return events.center_window(X.ev(spark, sf).withColumn("duration", F.lit(60.0))).select("event_id", R(F.col("new_start")).alias("new_start"), R(F.col("new_end")).alias("new_end"))


_GRID = f"""WITH {_EV}, r AS (SELECT filepath, count(*) * 10.0 + 5 AS length FROM ev GROUP BY filepath), g AS (SELECT filepath, unnest(range(ceil(length / 5)::BIGINT)) AS no FROM r),
 h AS (SELECT g.filepath, g.no, ev.cl FROM g JOIN ev ON g.filepath = ev.filepath AND ev.s < (g.no + 1) * 5.0 AND ev.e > g.no * 5.0)
 SELECT g.filepath, g.no * 5.0::DOUBLE AS start_time, coalesce((SELECT string_agg(DISTINCT CAST(cl AS VARCHAR), ',' ORDER BY CAST(cl AS VARCHAR)) FROM h WHERE h.filepath = g.filepath AND h.no = g.no), '') AS labels FROM g"""


@query("grid_labels", _GRID)
def grid_labels(spark: SparkSession, sf: str) -> DataFrame:
    ann = X.ev(spark, sf).select("filepath", F.col("cl").alias("label"), F.col("s").alias("start_time"), F.col("e").alias("end_time"))
    out = events.grid_labels(ann, X.recordings(spark, sf).select("filepath", "length"))
    return out.select("filepath", "start_time", F.array_join(F.array_sort(F.transform("labels", lambda x: x.cast("string"))), ",").alias("labels"))


@query("split_windows", "SELECT vec_id AS row_id, w AS window_no, round(embedding[CASE w WHEN 0 THEN 1 ELSE 31 END]::DOUBLE, 6) AS first, CASE w WHEN 0 THEN 40 ELSE 34 END AS n FROM embeddings, range(2) t(w)")
def split_windows(spark: SparkSession, sf: str) -> DataFrame:
    return events.split_windows(X.waveforms(spark, sf), "samples", 40, 10).select("row_id", F.col("window_no").cast("long").alias("window_no"), R(F.col("window")[0]).alias("first"), F.size("window").alias("n"))


@query("merge_windows", f"WITH {_PRED} SELECT row_id % 50 AS k, class AS pos, round(max(score), 6) AS x FROM pred GROUP BY 1, 2")
def merge_windows(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.wide(spark, sf).select((F.col("row_id") % 50).alias("k"), F.col("scores").alias("logits"))
    return events.merge_windows(rows, "k").select("k", F.posexplode("logits").alias("pos", "x")).select("k", F.col("pos").cast("long").alias("pos"), R(F.col("x")).alias("x"))


@query("slice_samples", "SELECT vec_id AS row_id, i, round(embedding[i + 6]::DOUBLE, 6) AS x FROM embeddings, range(10) t(i)")
def slice_samples(spark: SparkSession, sf: str) -> DataFrame:
    out = X.waveforms(spark, sf).select("row_id", F.posexplode(arrays.slice_samples(F.col("samples"), F.lit(5), F.lit(15))).alias("i", "x"))
    return out.select("row_id", F.col("i").cast("long").alias("i"), R(F.col("x")).alias("x"))


# ---- keys, filters ----


@query("file_site_day_keys", f"WITH {_SEG} SELECT filepath, regexp_replace(filepath, '(_[^_]*){{2}}$', '') AS file, right(regexp_replace(filepath, '(_[^_]*){{4}}$', ''), 3) AS site, right(regexp_replace(filepath, '(_[^_]*){{3}}$', ''), 8) AS day FROM seg")
def file_site_day_keys(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("filepath")
    return X.seg(spark, sf).select(p, keys.file_key(p).alias("file"), keys.site_key(p).alias("site"), keys.day_key(p).alias("day"))


@query("fold_filter", "SELECT p_partkey, CAST(p_partkey % 5 AS INT) AS fold, CASE WHEN p_partkey % 5 = 4 THEN 'test' ELSE 'train' END AS split FROM part")
def fold_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("fold"))
    train, test = project.fold_filter(rows)
    return train.withColumn("split", F.lit("train")).unionByName(test.withColumn("split", F.lit("test")))


@query("roi_filter", f"WITH {_EV} SELECT event_id FROM ev WHERE 3 + pos > 0 AND (2 + label) < 7.0 * (3 + pos) AND e - s > 0.5 AND (3 + pos) * (2 + label) >= 20")
def roi_filter(spark: SparkSession, sf: str) -> DataFrame:
    rois = X.ev(spark, sf).select("event_id", F.lit(0).alias("min_x"), F.lit(0).alias("min_y"), (3 + F.col("pos")).alias("max_x"), (2 + F.col("label")).alias("max_y"), F.col("s").alias("min_t"), F.col("e").alias("max_t"))
    return project.roi_filter(rois, min_area=20).select("event_id")


@query("select_inference", f"WITH {_SEG} SELECT filepath, CAST((length(event_type) = i)::INT AS FLOAT) AS hot, i FROM seg, range(12) t(i)")
def select_inference(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.seg(spark, sf).select("filepath", F.array(F.length("event_type")).alias("labels"), F.lit("test_5s").alias("split"))
    return project.select_inference(rows, 12).select("filepath", F.posexplode("labels").alias("i", "hot")).select("filepath", F.col("i").cast("long").alias("i"), "hot")


# ---- labels ----


@query("one_hot", "SELECT vec_id AS row_id, i, CAST((label = i)::INT AS FLOAT) AS x FROM embeddings, range(10) t(i)")
def one_hot(spark: SparkSession, sf: str) -> DataFrame:
    return X.waveforms(spark, sf).select("row_id", F.posexplode("labels").alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), "x")


def _codes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Parts by number, and a code for each order by its customer's number: many names have several, those beyond the customers none."""
    names = X.table(spark, sf, "part").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("c"), "p_partkey").alias("name"))
    return names, X.table(spark, sf, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("name"), F.col("o_orderkey").cast("string").alias("code"), F.col("o_orderkey").alias("pos"))


@query("map_codes", "WITH t AS (SELECT o_custkey, max_by(CAST(o_orderkey AS VARCHAR), o_orderkey) AS code FROM orders GROUP BY 1) SELECT p_partkey AS pos, 'c' || p_partkey AS name, code FROM part JOIN t ON p_partkey = o_custkey")
def map_codes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.map_codes(*_codes(spark, sf))


@query("unmatched_codes", "SELECT p_partkey AS pos, 'c' || p_partkey AS name FROM part WHERE p_partkey NOT IN (SELECT o_custkey FROM orders)")
def unmatched_codes(spark: SparkSession, sf: str) -> DataFrame:
    return labels.unmatched_codes(*_codes(spark, sf)).select("pos", "name")


@query("known_codes", "SELECT p_partkey AS label_id, 'c' || p_partkey AS code FROM part WHERE p_partkey IN (SELECT o_custkey FROM orders)")
def known_codes(spark: SparkSession, sf: str) -> DataFrame:
    names, orders = _codes(spark, sf)
    return labels.known_codes(names.withColumnsRenamed({"pos": "label_id", "name": "code"}), orders.select(F.col("name").alias("code"))).select("label_id", "code")


def _vocabularies(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Model classes c0..c9 (label ids 0..9) and dataset classes c9, c7, c5 and, for the second, c11."""
    model = X.table(spark, sf, "embeddings").select("label").distinct().where("label between 0 and 9").select(F.col("label").alias("label_id"), F.concat(F.lit("c"), "label").alias("code"))
    data = X.table(spark, sf, "embeddings").select("label").distinct().where("label in (1, 2, 3)").select((F.col("label") - 1).alias("label_id"), F.concat(F.lit("c"), 11 - 2 * F.col("label")).alias("code"))
    return model, data


@query("class_mask", "SELECT vec_id AS row_id, i, round(embedding[10 - 2 * i]::DOUBLE, 6) AS x FROM embeddings, range(3) t(i)")
def class_mask(spark: SparkSession, sf: str) -> DataFrame:
    out = labels.class_mask(X.wide(spark, sf).select("row_id", F.col("scores").alias("logits")), *_vocabularies(spark, sf))
    return out.select("row_id", F.posexplode("logits").alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), R(F.col("x")).alias("x"))


@query("restrict_logits", "SELECT vec_id AS row_id, i, CASE WHEN i = 1 THEN -10.0 ELSE round(embedding[10 - 2 * i]::DOUBLE, 6) END AS x FROM embeddings, range(3) t(i)")
def restrict_logits(spark: SparkSession, sf: str) -> DataFrame:
    model, data = _vocabularies(spark, sf)
    out = labels.restrict_logits(X.wide(spark, sf).select("row_id", F.col("scores").alias("logits")), model, data.withColumn("code", F.when(F.col("label_id") == 1, "none").otherwise(F.col("code"))))
    return out.select("row_id", F.posexplode("logits").alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), R(F.col("x")).alias("x"))


@query("attach_features", f"WITH {_EV}, a AS (SELECT * FROM ev WHERE pos < 4), b AS (SELECT * FROM ev WHERE pos > 1) SELECT coalesce(a.filepath, b.filepath) AS recording, coalesce(a.pos, b.pos) AS roi_no, round(a.s, 6) AS min_t, b.cl AS shp FROM a FULL JOIN b ON a.filepath = b.filepath AND a.pos = b.pos")
def attach_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf).withColumnsRenamed({"filepath": "recording", "pos": "roi_no"})
    return labels.attach_features(rows.where("roi_no < 4").select("recording", "roi_no", R(F.col("s")).alias("min_t")), rows.where("roi_no > 1").select("recording", "roi_no", F.col("cl").alias("shp"), F.col("e").alias("min_t")))


@query("id_to_code", "WITH v AS (SELECT event_type AS code, row_number() OVER (ORDER BY event_type) - 1 AS label_id FROM (SELECT DISTINCT event_type FROM events)) SELECT vec_id AS row_id, label AS predicted, code FROM embeddings LEFT JOIN v ON label = label_id")
def id_to_code(spark: SparkSession, sf: str) -> DataFrame:
    return labels.id_to_code(X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("predicted")), X.vocabulary(spark, sf)).select("row_id", "predicted", "code")


# ---- statistics ----


@query("class_weights", f"WITH {_EV}, n AS (SELECT label, count(*) AS n FROM ev GROUP BY label) SELECT label, round(pow(n / (SELECT sum(n) FROM n), -0.5), 6) AS weight FROM n")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_weights(stats.count_labels(X.ev(spark, sf))).select("label", R(F.col("weight")).alias("weight"))


@query("row_weights", f"WITH {_EV}, n AS (SELECT label, count(*) AS n FROM ev GROUP BY label) SELECT event_id, round(pow(n / (SELECT sum(n) FROM n), -0.5), 6) AS row_weight FROM ev JOIN n ON ev.label = n.label")
def row_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf)
    return stats.row_weights(rows, stats.class_weights(stats.count_labels(rows)), "event_id").select("event_id", R(F.col("row_weight")).alias("row_weight"))


@query("row_weights_multilabel", f"WITH {_EV}, n AS (SELECT cl AS label, count(*) AS n FROM ev WHERE cl >= 0 GROUP BY cl), w AS (SELECT label, pow(n / (SELECT sum(n) FROM n), -0.5) AS weight FROM n) SELECT filepath, round(sum(coalesce(weight, 0)), 6) AS row_weight FROM ev LEFT JOIN w ON ev.cl = w.label GROUP BY filepath")
def row_weights_multilabel(spark: SparkSession, sf: str) -> DataFrame:
    weights = stats.class_weights(stats.count_labels(X.ev(spark, sf).where("cl >= 0"), "cl"))
    rows = X.recordings(spark, sf).select("filepath", F.col("event_cluster").alias("labels"))
    return stats.row_weights(rows, weights, "filepath", multilabel=True).select("filepath", R(F.col("row_weight")).alias("row_weight"))


def _split_labels(spark: SparkSession, sf: str) -> DataFrame:
    return X.recordings(spark, sf).select(F.when(F.crc32(F.col("filepath").cast("binary")) >= 0, F.when(F.col("label") % 3 == 0, "test").otherwise("train")).alias("split"), F.col("event_cluster").alias("labels"))


_LS = f"WITH {_EV}, t AS (SELECT cl AS label, count(*) FILTER (label % 3 <> 0) AS train, count(*) FILTER (label % 3 = 0) AS test FROM ev GROUP BY cl)"


@query("label_stats", f"{_LS} SELECT * FROM t")
def label_stats(spark: SparkSession, sf: str) -> DataFrame:
    return stats.label_stats(_split_labels(spark, sf), ["train", "test"])


@query("label_shares", f"{_LS} SELECT label, round(train / (train + test), 6) AS train_share, round(test / (train + test), 6) AS test_share FROM t")
def label_shares(spark: SparkSession, sf: str) -> DataFrame:
    out = stats.label_shares(stats.label_stats(_split_labels(spark, sf), ["train", "test"]), ["train", "test"])
    return out.select("label", R(F.col("train_share")).alias("train_share"), R(F.col("test_share")).alias("test_share"))


@query("distinct_labels", f"WITH {_EV} SELECT CASE WHEN label % 3 = 0 THEN 'test' ELSE 'train' END AS split, count(DISTINCT cl) AS n FROM ev GROUP BY 1 UNION ALL SELECT NULL, count(DISTINCT cl) FROM ev")
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return stats.distinct_labels(_split_labels(spark, sf))


@query("dataset_summary", f"WITH {_EV}, c AS (SELECT cl, label, count(*) AS n FROM ev GROUP BY 1, 2), h AS (SELECT cl, sum(n) AS r, count(*) AS s, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY cl) SELECT cl, r::BIGINT AS rows, s AS species, round(h / ln(s), 6) AS evenness FROM h")
def dataset_summary(spark: SparkSession, sf: str) -> DataFrame:
    return stats.dataset_summary(X.ev(spark, sf), "cl", "label").select("cl", "rows", "species", R(F.col("evenness")).alias("evenness"))


@query("mean_std", "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
def mean_std(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mean_std(X.waveforms(spark, sf), "samples").select(R(F.col("mean")).alias("mean"), R(F.col("std")).alias("std"))


@query("best_value", "SELECT event_type AS name, round(max(value), 6) AS best FROM events GROUP BY 1")
def best_value(spark: SparkSession, sf: str) -> DataFrame:
    return stats.best_value(X.table(spark, sf, "events").select(F.col("event_type").alias("name"), "value")).select("name", R(F.col("best")).alias("best"))


@query("keep_label", f"WITH {_EV}, c AS (SELECT filepath, cl, count(*) AS n FROM ev WHERE cl >= 0 GROUP BY 1, 2), b AS (SELECT filepath, cl, row_number() OVER (PARTITION BY filepath ORDER BY n DESC, cl) AS r FROM c) SELECT event_id, CASE WHEN b.cl = ev.cl THEN 1 ELSE 0 END AS keep_label FROM ev LEFT JOIN b ON ev.filepath = b.filepath AND r = 1")
def keep_label(spark: SparkSession, sf: str) -> DataFrame:
    return stats.keep_label(X.ev(spark, sf).select("event_id", F.col("filepath").alias("recording"), F.col("cl").alias("cluster"))).select("event_id", "keep_label")


@query("keep_label_all", f"WITH {_EV} SELECT event_id, (cl >= 0)::INT AS keep_label FROM ev")
def keep_label_all(spark: SparkSession, sf: str) -> DataFrame:
    return stats.keep_label(X.ev(spark, sf).select("event_id", F.col("filepath").alias("recording"), F.col("cl").alias("cluster")), "ALL").select("event_id", "keep_label")


# ---- balancing ----


@query("limit_classes", f"WITH {_EV} SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('1|' || event_id), event_id) AS r FROM ev) WHERE r <= 100")
def limit_classes(spark: SparkSession, sf: str) -> DataFrame:
    return balance.limit_classes(X.ev(spark, sf), "label", "event_id", 100, 1).select("event_id", "label")


_LEVEL = f"""WITH {_EV}, g AS (SELECT label, filepath, count(*) AS c FROM ev GROUP BY 1, 2), v AS (SELECT DISTINCT label, c AS v FROM g),
 t AS (SELECT v.label, v.v, sum(least(g.c, v.v)) AS total FROM v JOIN g ON v.label = g.label GROUP BY 1, 2), n AS (SELECT *, lead(total) OVER (PARTITION BY label ORDER BY v DESC) AS next FROM t),
 cap AS (SELECT label, max(v) AS cap FROM n WHERE v = 4 OR v = 1 OR next IS NULL OR next < 3000 GROUP BY 1),
 r AS (SELECT *, row_number() OVER (PARTITION BY label, filepath ORDER BY md5('2|' || event_id), event_id) AS r FROM ev) SELECT event_id, r.label FROM r JOIN cap ON r.label = cap.label WHERE r.r <= cap"""


@query("level_events", _LEVEL)
def level_events(spark: SparkSession, sf: str) -> DataFrame:
    return balance.level_events(X.ev(spark, sf), 3000, 4, "event_id", 2).select("event_id", "label")


_LIMITED = f"WITH {_EV} SELECT event_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('2|' || event_id), event_id) AS r FROM ev) WHERE r <= 300"


@query("balance", f"SELECT event_id, label, 'levelled' AS how FROM ({_LEVEL}) a UNION ALL SELECT event_id, label, 'limited' FROM ({_LIMITED}) b UNION ALL (WITH {_EV} SELECT event_id, label, 'whole' FROM ev)")
def balanced(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf)
    cases = {"levelled": (3000, 4, "multilabel"), "limited": (300, None, "multiclass"), "whole": (None, None, "multiclass")}
    out = None
    for how, limits in cases.items():
        part = balance.balance(rows, *limits, "event_id", 2).select("event_id", "label", F.lit(how).alias("how"))
        out = part if out is None else out.unionByName(part)
    return out


_SAMPLE = f"""WITH {_EV}, w AS (SELECT event_id, greatest(1, round((label + 1)::DOUBLE / (SELECT max(label) + 1 FROM ev) * 16777216))::BIGINT AS w FROM ev),
 r AS (SELECT event_id, w, sum(w) OVER (ORDER BY md5('5|' || event_id), event_id)::BIGINT AS high FROM w), t AS (SELECT sum(w)::DOUBLE AS t, count(*) AS n FROM w), l AS (SELECT event_id, high - w AS low FROM r),
 d AS (SELECT range AS draw, least(floor(('0x' || substr(md5('5-draw|' || range), 1, 13))::BIGINT::DOUBLE / 4503599627370496 * (SELECT t FROM t)), (SELECT t FROM t) - 1)::BIGINT AS pos FROM range((SELECT n FROM t)::BIGINT))
 SELECT draw, event_id FROM d ASOF JOIN l ON d.pos >= l.low"""


@query("weighted_sample", _SAMPLE)
def weighted_sample(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf).withColumn("w", (F.col("label") + 1).cast("double"))
    return balance.weighted_sample(rows, "w", X.table(spark, sf, "lineitem").count(), "event_id", 5)


@query("random_subset", f"WITH {_EV} SELECT event_id FROM ev ORDER BY md5('4|' || event_id), event_id LIMIT 500")
def random_subset(spark: SparkSession, sf: str) -> DataFrame:
    return balance.random_subset(X.ev(spark, sf), 500, "event_id", 4).select("event_id")


# ---- splits ----

_RANK = f"WITH {_EV}, r AS (SELECT event_id, row_number() OVER (ORDER BY md5('6|' || event_id), event_id) AS r, count(*) OVER () AS n FROM ev)"


@query("train_test_split", f"{_RANK} SELECT event_id, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM r")
def train_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_test_split(X.ev(spark, sf), 0.2, "event_id", 6).select("event_id", "split")


_TVT = f"{_RANK} SELECT event_id, CASE WHEN r <= ceil(ceil(n * 0.5) * 0.5) THEN 'test' WHEN r <= ceil(n * 0.5) THEN 'valid' ELSE 'train' END AS split FROM r"


@query("train_valid_test_split", _TVT)
def train_valid_test_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.train_valid_test_split(X.ev(spark, sf), 0.25, 0.25, "event_id", 6).select("event_id", "split")


@query("ensure_splits", _TVT)
def ensure_splits(spark: SparkSession, sf: str) -> DataFrame:
    parts = splits.ensure_splits({"train": X.ev(spark, sf)}, "event_id", 0.25, 0.25, 6)
    out = None
    for name, part in parts.items():
        part = part.select("event_id", F.lit(name).alias("split"))
        out = part if out is None else out.unionByName(part)
    return out


@query("ensure_splits_others", f"{_RANK} SELECT event_id, CASE WHEN r <= ceil(n * 0.25) THEN 'valid' ELSE 'train' END AS split, 'cut' AS how FROM r UNION ALL SELECT event_id, 'test', 'cut' FROM r UNION ALL SELECT event_id, unnest(['train', 'valid']), 'kept' FROM r")
def ensure_splits_others(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf).select("event_id")
    out = None
    for how, given in {"cut": {"train": rows, "test": rows}, "kept": {"train": rows, "valid": rows}}.items():
        for name, part in splits.ensure_splits(given, "event_id", 0.25, 0.25, 6).items():
            part = part.select("event_id", F.lit(name).alias("split"), F.lit(how).alias("how"))
            out = part if out is None else out.unionByName(part)
    return out


@query("split_sites", f"WITH {_SEG} SELECT filepath, right(regexp_replace(filepath, '(_[^_]*){{4}}$', ''), 3) AS site FROM seg")
def split_sites(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_sites(X.seg(spark, sf)).select("filepath", "site")


def _blocks_sql(by: str, starts: str, frac: str) -> str:
    """File-wise blocks in SQL; by: '' or 'site'; starts: (fold, i) rows from n; all folds."""
    site = "right(regexp_replace(filepath, '(_[^_]*){4}$', ''), 3)" if by else "''"
    return f"""WITH {_SEG}, a AS (SELECT filepath, regexp_replace(filepath, '(_[^_]*){{2}}$', '') AS file, {site} AS site FROM seg),
 c AS (SELECT site, file, count(*) AS c FROM a GROUP BY 1, 2), f AS (SELECT site, file, sum(c) OVER (PARTITION BY site ORDER BY file) AS e, sum(c) OVER (PARTITION BY site) AS n, c FROM c),
 r AS (SELECT site, file, (e - c)::BIGINT AS s, e::BIGINT AS e, n::BIGINT AS n FROM f), w AS (SELECT site, n, fold, {starts} AS i FROM (SELECT DISTINCT site, n FROM r), range(4) t(fold)),
 h AS (SELECT r.site, fold, r.n, CASE WHEN e = r.n THEN s WHEN i - s > e - i THEN e ELSE s END AS st FROM r JOIN w ON r.site = w.site AND s <= i AND i < e),
 d AS (SELECT *, least(st + CAST(floor(n * {frac}) AS BIGINT), n - 1) AS d FROM h),
 b AS (SELECT d.site, fold, st, CASE WHEN s <= st + 1 THEN st ELSE s END AS bottom, e, d.n FROM d JOIN r ON d.site = r.site AND s <= d AND d < e),
 k AS (SELECT site, fold, st, CASE WHEN {frac} - (bottom - st) / n > (e - st) / n - {frac} THEN e ELSE bottom END AS stop FROM b)
 SELECT filepath, CAST(fold AS INT) AS fold, CASE WHEN s >= st AND s < stop THEN 'test' ELSE 'train' END AS split FROM a JOIN r ON a.site = r.site AND a.file = r.file JOIN k ON k.site = r.site"""


@query("split_by_file", f"SELECT filepath, split FROM ({_blocks_sql('', '(least(1200, n - 1))::BIGINT', '0.25::DOUBLE')}) WHERE fold = 0")
def split_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return splits.split_by_file(X.seg(spark, sf), 1200, 0.25).select("filepath", "split")


@query("kfold_by_file", _blocks_sql("", "CAST(floor(n * fold / 4) AS BIGINT)", "0.25::DOUBLE"))
def kfold_by_file(spark: SparkSession, sf: str) -> DataFrame:
    return splits.kfold_by_file(X.seg(spark, sf), 4).select("filepath", "fold", "split")


@query("kfold_by_site", _blocks_sql("site", "CAST(floor(n * fold / 4) AS BIGINT)", "0.25::DOUBLE"))
def kfold_by_site(spark: SparkSession, sf: str) -> DataFrame:
    return splits.kfold_by_site(X.seg(spark, sf), 4).select("filepath", "fold", "split")


@query("tail_split", f"""WITH {_SEG}, a AS (SELECT filepath, regexp_replace(filepath, '(_[^_]*){{2}}$', '') AS file FROM seg), c AS (SELECT file, count(*) AS c FROM a GROUP BY 1),
 r AS (SELECT file, sum(c) OVER (ORDER BY file) - c AS s, sum(c) OVER () AS n FROM c), p AS (SELECT s FROM r ORDER BY abs(s - (n - floor(n * 0.2::DOUBLE))), s LIMIT 1)
 SELECT filepath, CASE WHEN r.s >= (SELECT s FROM p) THEN 'test' ELSE 'train' END AS split FROM a JOIN r ON a.file = r.file""")
def tail_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tail_split(X.seg(spark, sf), 0.2).select("filepath", "split")


@query("tail_split_by_site", f"""WITH {_SEG}, a AS (SELECT filepath, right(regexp_replace(filepath, '(_[^_]*){{4}}$', ''), 3) AS site, regexp_replace(filepath, '(_[^_]*){{2}}$', '') AS file FROM seg), c AS (SELECT site, file, count(*) AS c FROM a GROUP BY 1, 2),
 r AS (SELECT site, file, sum(c) OVER (PARTITION BY site ORDER BY file) - c AS s, sum(c) OVER (PARTITION BY site) AS n FROM c), p AS (SELECT site, arg_min(s, abs(s - (n - floor(n * 0.2::DOUBLE))) * 1e9 + s) AS s FROM r GROUP BY site)
 SELECT filepath, CASE WHEN r.s >= p.s THEN 'test' ELSE 'train' END AS split FROM a JOIN r ON a.site = r.site AND a.file = r.file JOIN p ON r.site = p.site""")
def tail_split_by_site(spark: SparkSession, sf: str) -> DataFrame:
    return splits.tail_split(X.seg(spark, sf), 0.2, by_site=True).select("filepath", "split")


@query("last_days_split", f"WITH {_SEG}, a AS (SELECT filepath, right(regexp_replace(filepath, '(_[^_]*){{3}}$', ''), 8) AS day FROM seg) SELECT filepath, CASE WHEN dense_rank() OVER (ORDER BY day DESC) <= 2 THEN 'test' ELSE 'train' END AS split FROM a")
def last_days_split(spark: SparkSession, sf: str) -> DataFrame:
    return splits.last_days_split(X.seg(spark, sf), 2).select("filepath", "split")


# ---- metrics ----

_AP = f"{_PRED}, g AS (SELECT class, score, sum(target)::DOUBLE AS p, count(*)::DOUBLE AS n FROM pred GROUP BY 1, 2), t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)), ap AS (SELECT class, sum(p) AS positives, sum(p * tp / seen) / sum(p) AS ap FROM t GROUP BY class)"
_AUC = f"{_PRED}, g AS (SELECT class, score, sum(target)::DOUBLE AS p, count(*)::DOUBLE AS n FROM pred GROUP BY 1, 2), t AS (SELECT *, coalesce(sum(n - p) OVER (PARTITION BY class ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g), auc AS (SELECT class, sum(p * (below + (n - p) / 2)) / (sum(p) * sum(n - p)) AS auroc FROM t GROUP BY class)"


@query("average_precision", f"WITH {_AP} SELECT class, positives, round(ap, 6) AS ap FROM ap")
def average_precision(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.average_precision(X.pred(spark, sf)).select(F.col("class").cast("long").alias("class"), "positives", R(F.col("ap")).alias("ap"))


@query("cmap", f"WITH {_AP} SELECT round(avg(ap), 6) AS cmap FROM ap")
def cmap(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cmap(X.pred(spark, sf)).select(R(F.col("cmap")).alias("cmap"))


@query("cmap_min_support", f"WITH {_AP} SELECT round(avg(ap), 6) AS cmap FROM ap WHERE positives >= 70")
def cmap_min_support(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.cmap_min_support(X.pred(spark, sf), 70).select(R(F.col("cmap")).alias("cmap"))


@query("padded_cmap", "WITH " + _AP.replace("FROM pred GROUP BY 1, 2)", "FROM (SELECT class, score, target FROM pred UNION ALL SELECT c, 1.0, 1 FROM range(10) t(c), range(5) u(k)) z GROUP BY 1, 2)") + " SELECT round(avg(ap), 6) AS cmap FROM ap")
def padded_cmap(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.padded_cmap(X.pred(spark, sf)).select(R(F.col("cmap")).alias("cmap"))


@query("map_micro", f"WITH {_PRED}, g AS (SELECT score, sum(target)::DOUBLE AS p, count(*)::DOUBLE AS n FROM pred GROUP BY 1), t AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(p * tp / seen) / sum(p), 6) AS map FROM t")
def map_micro(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.map_micro(X.pred(spark, sf)).select(R(F.col("map")).alias("map"))


@query("auroc_macro", f"WITH {_AUC} SELECT round(avg(auroc), 6) AS auroc FROM auc")
def auroc_macro(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.auroc_macro(X.pred(spark, sf)).select(R(F.col("auroc")).alias("auroc"))


@query("metric_set", f"WITH {_AP}, b AS (WITH {_AUC} SELECT avg(auroc) AS v FROM auc) SELECT 'cmap' AS name, round(avg(ap), 6) AS value FROM ap UNION ALL SELECT 'cmap5', round(avg(ap) FILTER (positives >= 5), 6) FROM ap UNION ALL SELECT 'auroc', round(v, 6) FROM b")
def metric_set(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.metric_set(X.pred(spark, sf)).select("name", R(F.col("value")).alias("value"))


_NAMED = (
    f"WITH {_AP}, b AS (WITH {_AUC} SELECT avg(auroc) AS v FROM auc), m AS (SELECT score, sum(p) AS p, sum(n) AS n FROM g GROUP BY 1), mt AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM m WINDOW w AS (ORDER BY score DESC)),"
    " pg AS (SELECT class, score, sum(p) AS p, sum(n) AS n FROM (SELECT class, score, p, n FROM g UNION ALL SELECT DISTINCT class, 1.0, 5.0, 5.0 FROM g) z GROUP BY 1, 2), pt AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS seen FROM pg WINDOW w AS (PARTITION BY class ORDER BY score DESC)), pa AS (SELECT class, sum(p * tp / seen) / sum(p) AS ap FROM pt GROUP BY 1),"
    " top AS (SELECT row_id, target, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, class) AS r, max(target) OVER (PARTITION BY row_id) AS any_target FROM pred), hit AS (SELECT k, row_id, max(target) AS hit FROM top, (SELECT unnest([1, 3]) AS k) u WHERE r <= k AND any_target = 1 GROUP BY 1, 2)"
    " SELECT 'cmAP' AS name, round(avg(ap), 6) AS value FROM ap UNION ALL SELECT 'cmAP5', round(avg(ap) FILTER (positives >= 5), 6) FROM ap UNION ALL SELECT 'MultilabelAUROC', round(v, 6) FROM b"
    " UNION ALL SELECT 'mAP', round(sum(p * tp / seen) / sum(p), 6) FROM mt UNION ALL SELECT 'pcmAP', round(avg(ap), 6) FROM pa UNION ALL SELECT 'T' || k || 'Accuracy', round(avg(hit), 6) FROM hit GROUP BY k"
)


@query("metric_states", _NAMED)
def metric_states(spark: SparkSession, sf: str) -> DataFrame:
    """All registered metrics from states of two parts of the rows, written apart and merged."""
    path, rows = io.scratch(spark, "states"), X.wide(spark, sf)
    for part in (0, 1):
        metrics.metric_state(rows.where(F.col("row_id") % 2 == part)).write.mode("append").parquet(path)
    merged = staged(metrics.merge_states(spark.read.schema(metrics.STATE).parquet(path)), "merged")
    return metrics.finish_metrics(merged).select("name", R(F.col("value")).alias("value"))


_TOP = f"WITH {_PRED}, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, class) AS r, max(target) OVER (PARTITION BY row_id) AS any_target FROM pred)"
for _k in (1, 3):

    @query(f"top{_k}_accuracy", f"{_TOP}, h AS (SELECT row_id, max(target) AS hit FROM r WHERE r <= {_k} AND any_target = 1 GROUP BY 1) SELECT round(avg(hit), 6) AS accuracy FROM h")
    def topk(spark: SparkSession, sf: str, k: int = _k) -> DataFrame:
        return metrics.topk_accuracy(X.wide(spark, sf), k).select(R(F.col("accuracy")).alias("accuracy"))


@query("topk_accuracy_nocalls", f"{_TOP}, h AS (SELECT row_id, CASE WHEN any_target = 1 THEN max(target) ELSE CASE WHEN max(score) < 0.15 THEN 1 ELSE 0 END END AS hit FROM r WHERE r <= 1 GROUP BY row_id, any_target) SELECT round(avg(hit), 6) AS accuracy FROM h")
def topk_nocalls(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.topk_accuracy(X.wide(spark, sf), 1, True, 0.15).select(R(F.col("accuracy")).alias("accuracy"))


@query("top5_accuracy", f"{_TOP} SELECT round(avg(CASE WHEN class = label THEN 1 ELSE 0 END) * 5, 6) AS accuracy FROM r JOIN embeddings ON row_id = vec_id WHERE r <= 5")
def top5(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.top5_accuracy(X.wide(spark, sf)).select(R(F.col("accuracy")).alias("accuracy"))


@query("multiclass_accuracy_f1", f"{_TOP} SELECT round(avg((class = label)::INT), 6) AS accuracy, round(avg((class = label)::INT), 6) AS f1 FROM r JOIN embeddings ON row_id = vec_id WHERE r = 1")
def multiclass_accuracy_f1(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.multiclass_accuracy_f1(X.wide(spark, sf)).select(R(F.col("accuracy")).alias("accuracy"), R(F.col("f1")).alias("f1"))


for _axis, _col in (("pred", "class"), ("true", "label")):

    @query(f"balanced_accuracy_{_axis}", f"{_TOP}, s AS (SELECT {_col} AS c, avg((class = label)::INT) AS a FROM r JOIN embeddings ON row_id = vec_id WHERE r = 1 GROUP BY 1) SELECT round(avg(a), 6) AS accuracy FROM s")
    def balanced_accuracy(spark: SparkSession, sf: str, axis: str = _axis) -> DataFrame:
        rows = X.wide(spark, sf).select(metrics.top_classes(F.col("scores"), 1)[0].alias("pred"), "true")
        return metrics.balanced_accuracy(rows, 10, axis=axis).select(R(F.col("accuracy")).alias("accuracy"))


@query("balanced_accuracy_adjusted", f"{_TOP}, s AS (SELECT label AS c, avg((class = label)::INT) AS a FROM r JOIN embeddings ON row_id = vec_id WHERE r = 1 GROUP BY 1) SELECT round((avg(a) - 0.1) / 0.9, 6) AS accuracy FROM s")
def balanced_accuracy_adjusted(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.wide(spark, sf).select(metrics.top_classes(F.col("scores"), 1)[0].alias("pred"), "true")
    return metrics.balanced_accuracy(rows, 10, adjusted=True, axis="true").select(R(F.col("accuracy")).alias("accuracy"))


@query("asymmetric_loss_single", f"WITH {_PRED}, a AS (SELECT row_id, class, (class = label)::INT AS hit, score - ln(sum(exp(score)) OVER (PARTITION BY row_id)) AS lp FROM pred JOIN embeddings ON row_id = vec_id), b AS (SELECT row_id, sum(-(hit * 0.9 + 0.01) * lp * CASE WHEN hit = 1 THEN 1 - exp(lp) ELSE pow(exp(lp), 4) END) AS loss FROM a GROUP BY 1) SELECT round(avg(loss), 6) AS loss FROM b")
def asymmetric_loss_single(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.asymmetric_loss_single(X.wide(spark, sf).select(F.col("scores").alias("logits"), "true")).select(R(F.col("loss")).alias("loss"))


@query("prediction_table", f"{_TOP} SELECT row_id, string_agg(class::VARCHAR, ', ' ORDER BY r) FILTER (r <= 5) AS predicted, coalesce(string_agg(class::VARCHAR, ', ' ORDER BY class) FILTER (target = 1), '') AS positive FROM r GROUP BY row_id")
def prediction_table(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.prediction_table(X.wide(spark, sf))


_B = "greatest(score, 0.0) - score * target + ln(1 + exp(-abs(score)))"


@query("bce_loss", f"WITH {_PRED} SELECT round(avg({_B}), 6) AS loss FROM pred")
def bce_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.bce_loss(X.pred(spark, sf).withColumnRenamed("score", "logit")).select(R(F.col("loss")).alias("loss"))


@query("focal_loss", f"WITH {_PRED}, b AS (SELECT {_B} AS b FROM pred) SELECT round(avg(0.25 * pow(1 - exp(-b), 2) * b), 6) AS loss FROM b")
def focal_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.focal_loss(X.pred(spark, sf).withColumnRenamed("score", "logit")).select(R(F.col("loss")).alias("loss"))


@query("asymmetric_loss", f"WITH {_PRED}, a AS (SELECT target AS t, 1 / (1 + exp(-score)) AS p FROM pred), b AS (SELECT t, p, least(1 - p + 0.05, 1.0) AS q FROM a) SELECT round(-sum((t * ln(p) + (1 - t) * ln(q)) * pow(1 - p * t - q * (1 - t), t + 4 * (1 - t))), 4) AS loss FROM b")
def asymmetric_loss(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.asymmetric_loss(X.pred(spark, sf).withColumnRenamed("score", "logit")).select(F.round("loss", 4).alias("loss"))


@query("activate", f"WITH {_PRED} SELECT row_id, class, round(1 / (1 + exp(-score)), 6) AS p, round(exp(score) / sum(exp(score)) OVER (PARTITION BY row_id), 6) AS q FROM pred")
def activate(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.wide(spark, sf).select("row_id", F.col("scores").alias("logits"))
    both = metrics.activate(rows).withColumnRenamed("scores", "p").select("row_id", "logits", "p")
    both = metrics.activate(both, "multiclass").select("row_id", F.posexplode(F.arrays_zip("p", "scores")).alias("class", "z"))
    return both.select("row_id", F.col("class").cast("long").alias("class"), R(F.col("z.p")).alias("p"), R(F.col("z.scores")).alias("q"))


# ---- arrays ----


def _values(df: DataFrame, column: str) -> DataFrame:
    return df.select("row_id", F.posexplode(column).alias("i", "x")).select("row_id", F.col("i").cast("long").alias("i"), R(F.col("x").cast("double")).alias("x"))


_FLAT = "f AS (SELECT vec_id AS row_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i))"


def _array_query(name: str, oracle: str, f: Callable) -> None:
    QUERIES[name] = lambda spark, sf: _values(X.waveforms(spark, sf).select("row_id", f(F.col("samples")).alias("v")), "v")
    ORACLES[name] = f"WITH {_FLAT} {oracle}"


_array_query("pad_truncate", "SELECT row_id, i, round(x, 6) AS x FROM f UNION ALL SELECT vec_id, i, 0.0 FROM embeddings, range(64, 80) t(i)", lambda a: arrays.pad_truncate(a, 80))
_array_query("instance_norm", "SELECT row_id, i, round((x - avg(x) OVER w) / sqrt(var_samp(x) OVER w + 1e-7), 6) AS x FROM f WINDOW w AS (PARTITION BY row_id)", arrays.instance_norm)
_array_query("min_max_scale", "SELECT row_id, i, CASE WHEN i < 60 THEN round(2 * (x - min(x) FILTER (i < 60) OVER w) / (max(x) FILTER (i < 60) OVER w - min(x) FILTER (i < 60) OVER w + 1e-7) - 1, 6) ELSE 0.0 END AS x FROM f WINDOW w AS (PARTITION BY row_id)", lambda a: arrays.min_max_scale(a, F.transform(a, lambda x, i: F.when(i < 60, 1).otherwise(0))))
_array_query("peak_norm", ", c AS (SELECT row_id, i, x - avg(x) OVER (PARTITION BY row_id) AS c FROM f) SELECT row_id, i, round(c / max(abs(c)) OVER (PARTITION BY row_id) * 0.25, 6) AS x FROM c", arrays.peak_norm)
_array_query("standardize", "SELECT row_id, i, round((x + 4.268) / 4.569, 6) AS x FROM f", arrays.standardize)
_array_query("power_to_db", ", d AS (SELECT row_id, i, 10 * log10(greatest(x * x, 1e-10)) AS d FROM f) SELECT row_id, i, round(greatest(d, max(d) OVER (PARTITION BY row_id) - 20), 6) AS x FROM d", lambda a: arrays.power_to_db(F.transform(a, lambda x: x * x), top_db=20.0))
_array_query("center_pad", "SELECT row_id, i + 8 AS i, round(x, 6) AS x FROM f UNION ALL SELECT vec_id, CASE WHEN i < 8 THEN i ELSE i + 64 END, 0.0 FROM embeddings, range(17) t(i)", lambda a: arrays.center_pad(a, 81))
_array_query("resize_2d", "SELECT row_id, i, round(x, 6) AS x FROM f WHERE i < 50 UNION ALL SELECT vec_id, i, -80.0 FROM embeddings, range(50, 100) t(i)", lambda a: F.flatten(arrays.resize_2d(F.array(a), 2, 50)))
QUERIES["map_rows"] = lambda spark, sf: _values(batches.map_rows(X.waveforms(spark, sf), "v", F.transform("samples", lambda x: x * 2)), "v")
ORACLES["map_rows"] = f"WITH {_FLAT} SELECT row_id, i, round(x * 2, 6) AS x FROM f"


@query("mono", "SELECT vec_id AS row_id, i, round((embedding[i + 1]::DOUBLE + embedding[64 - i]::DOUBLE) / 2, 6) AS x FROM embeddings, range(64) t(i)")
def mono(spark: SparkSession, sf: str) -> DataFrame:
    return _values(X.waveforms(spark, sf).select("row_id", arrays.mono(F.array("samples", F.reverse("samples"))).alias("v")), "v")


@query("merge_windows_embedding", f"WITH {_FLAT} SELECT row_id % 50 AS row_id, i, round(avg(x), 6) AS x FROM f GROUP BY 1, 2")
def merge_windows_embedding(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.waveforms(spark, sf).select((F.col("row_id") % 50).alias("row_id"), "samples")
    return _values(events.merge_windows(rows, "row_id", logits=None, embedding="samples"), "samples")


@query("band_features", f"WITH {_FLAT}, o AS (SELECT row_id, arg_max(i, x) AS peak, max(x) AS top FROM f GROUP BY 1), b AS (SELECT f.row_id, min(i) AS lo, max(i) AS hi FROM f JOIN o ON f.row_id = o.row_id WHERE x > top - 0.1 GROUP BY 1) SELECT o.row_id, peak * 10.0::DOUBLE AS peak_f, (lo + hi) * 5.0::DOUBLE AS centroid_f, (hi - lo) * 10.0::DOUBLE AS bandwidth_f FROM o JOIN b ON o.row_id = b.row_id")
def band_features(spark: SparkSession, sf: str) -> DataFrame:
    f = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: i * 10.0)
    return X.waveforms(spark, sf).select("row_id", arrays.band_features(F.col("samples"), f, 0.1).alias("b")).select("row_id", "b.peak_f", "b.centroid_f", "b.bandwidth_f")


def _mel_sql(sr: int, n_fft: int, hop: int, n_mels: int, length: int) -> str:
    """Centred frames with reflected ends, Hann window, power of the discrete Fourier transform, mel triangles: all as sums."""
    half, mel = n_fft // 2, f"(2595 * log10(1 + {sr / 2} / 700.0))"
    edge = lambda k: f"(700 * (pow(10, {mel} * ({k}) / {n_mels + 1} / 2595) - 1))"
    at = f"abs(t * {hop} + k - {half})"
    return f"""SELECT row_id, t, m, round((sum(p * greatest(0, least((f * {sr / n_fft} - {edge("m")}) / ({edge("m + 1")} - {edge("m")}), ({edge("m + 2")} - f * {sr / n_fft}) / ({edge("m + 2")} - {edge("m + 1")})))))::FLOAT::DOUBLE, 5) AS x
 FROM (SELECT row_id, t, f, pow(sum(w * cos(2 * pi() * f * k / {n_fft})), 2) + pow(sum(w * sin(2 * pi() * f * k / {n_fft})), 2) AS p
  FROM (SELECT vec_id AS row_id, t, k, embedding[CASE WHEN {at} < {length} THEN {at} ELSE {2 * (length - 1)} - {at} END + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * k / {n_fft})) AS w
   FROM embeddings, range({length // hop + 1}) a(t), range({n_fft}) b(k)) x, range({half + 1}) c(f) GROUP BY 1, 2, 3) y, range({n_mels}) d(m) GROUP BY 1, 2, 3"""


@query("mel_features", _mel_sql(64, 32, 16, 8, 64))
def mel_features(spark: SparkSession, sf: str) -> DataFrame:
    out = batches.mel_features(X.waveforms(spark, sf), sr=64, n_fft=32, hop=16, n_mels=8)
    out = out.select("row_id", F.posexplode("mel").alias("m", "frames")).select("row_id", "m", F.posexplode("frames").alias("t", "x"))
    return out.select("row_id", F.col("t").cast("long").alias("t"), F.col("m").cast("long").alias("m"), F.round(F.col("x").cast("double"), 5).alias("x"))


@query("map_batches", "SELECT vec_id AS row_id, label + 1 AS y FROM embeddings")
def map_batches(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "label", "embedding")
    return batches.map_batches(rows, lambda b: {"row_id": b["row_id"], "y": [x + 1 for x in b["label"]]}, "row_id long, y int", ["embedding"])


# ---- augmentation, clustering ----


def _noise(spark: SparkSession, sf: str) -> DataFrame:
    """The whole table of waveforms, numbered as noise clips."""
    return X.waveforms(spark, sf).select(F.col("row_id").alias("noise_no"), "samples")


_RMS = "sqrt(list_sum(list_transform({a}, lambda v: v::DOUBLE * v::DOUBLE)) / 64)"
_U1 = lambda what: _U.format(f"'1-{what}|' || vec_id") + "::DOUBLE"
_SNR = f"(3.0 + 27.0 * {_U1('snr')})"


@query("mix_pairs", f"""WITH n AS (SELECT *, coalesce(lead(vec_id) OVER w, first_value(vec_id) OVER w) AS other FROM embeddings WINDOW w AS (ORDER BY md5('1|' || vec_id), vec_id)),
 p AS (SELECT vec_id, embedding AS a, label, CASE WHEN other <> vec_id AND {_U1("p")} < 0.7 THEN other END AS partner, floor({_U1("o")} * 64)::INT AS off, {_SNR} AS snr FROM n),
 j AS (SELECT p.*, e.embedding AS b, e.label AS l2 FROM p LEFT JOIN embeddings e ON p.partner = e.vec_id)
 SELECT vec_id AS row_id, partner, i, round(a[i + 1]::DOUBLE + coalesce(b[(i - off + 64) % 64 + 1]::DOUBLE / {_RMS.format(a="b")} * ({_RMS.format(a="a")} / pow(10, snr / 20)), 0), 6) AS x, CASE WHEN l2 IS NULL OR l2 = label THEN 1.0 ELSE 2.0 END AS positives FROM j, range(64) t(i)""")
def mix_pairs(spark: SparkSession, sf: str) -> DataFrame:
    out = augment.mix_pairs(X.waveforms(spark, sf), seed=1).withColumn("positives", F.aggregate("labels", F.lit(0.0), lambda a, x: a + x))
    return out.select("row_id", "partner", "positives", F.posexplode("samples").alias("i", "x")).select("row_id", "partner", "positives", F.col("i").cast("long").alias("i"), R(F.col("x")).alias("x"))


_WITH_NOISE = f"n AS (SELECT count(*) AS n FROM embeddings), p AS (SELECT vec_id, embedding AS a, {_U1('p')} AS u, floor({_U1('no')} * n)::BIGINT AS no, {_SNR} AS snr FROM embeddings, n)"


@query("inject_nocall", f"WITH {_WITH_NOISE} SELECT p.vec_id AS row_id, i, round(CASE WHEN u < 0.2 THEN e.embedding[i + 1] ELSE a[i + 1] END::DOUBLE, 6) AS x, CASE WHEN u < 0.2 THEN 0.0 ELSE 1.0 END AS positives FROM p JOIN embeddings e ON no = e.vec_id, range(64) t(i)")
def inject_nocall(spark: SparkSession, sf: str) -> DataFrame:
    out = augment.inject_nocall(X.waveforms(spark, sf), _noise(spark, sf), 0.2, seed=1)
    out = out.select("row_id", F.aggregate("labels", F.lit(0.0), lambda a, x: a + x).alias("positives"), F.posexplode("samples").alias("i", "x"))
    return out.select("row_id", "positives", F.col("i").cast("long").alias("i"), R(F.col("x").cast("double")).alias("x"))


@query("add_noise", f"WITH {_WITH_NOISE} SELECT p.vec_id AS row_id, i, round(a[i + 1]::DOUBLE + CASE WHEN u < 0.5 THEN e.embedding[i + 1]::DOUBLE / {_RMS.format(a='e.embedding')} * ({_RMS.format(a='a')} / pow(10, snr / 20)) ELSE 0 END, 6) AS x FROM p JOIN embeddings e ON no = e.vec_id, range(64) t(i)")
def add_noise(spark: SparkSession, sf: str) -> DataFrame:
    return _values(augment.add_noise(X.waveforms(spark, sf), _noise(spark, sf), seed=1), "samples")


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return X.ev(spark, sf).select(F.concat(F.lit("r"), (F.substring("filepath", 2, 20).cast("long") % 40).cast("string")).alias("recording"), F.xxhash64("event_id").alias("h"), "event_id", "s", "e", "cl")


@query("scale_features", f"WITH {_EV}, r AS (SELECT event_id, 'r' || (CAST(substr(filepath, 2) AS BIGINT) % 40) AS recording, s, e FROM ev), w AS (SELECT *, avg(s) OVER p AS m, stddev_pop(s) OVER p AS d FROM r WINDOW p AS (PARTITION BY recording)) SELECT event_id, round((s - m) / d, 5) AS s_scaled FROM w")
def scale_features(spark: SparkSession, sf: str) -> DataFrame:
    return cluster.scale_features(_features(spark, sf), [], ["s"]).select("event_id", F.round("s_scaled", 5).alias("s_scaled"))


@query("scale_features_robust", f"WITH {_EV}, r AS (SELECT event_id, 'r' || (CAST(substr(filepath, 2) AS BIGINT) % 40) AS recording, s, e FROM ev), b AS (SELECT recording, unnest([s, e]) AS x FROM r), q AS (SELECT recording, quantile_cont(x, [0.25, 0.5, 0.75]) AS q FROM b GROUP BY 1), o AS (SELECT recording, min(s) AS lo, max(s) AS hi FROM r GROUP BY 1) SELECT event_id, round((s - q[2]) / (q[3] - q[1]), 5) AS s_scaled, round((e - q[2]) / (q[3] - q[1]), 5) AS e_scaled, round((s - lo) / (hi - lo), 5) AS t_scaled FROM r JOIN q ON r.recording = q.recording JOIN o ON r.recording = o.recording")
def scale_features_robust(spark: SparkSession, sf: str) -> DataFrame:
    out = cluster.scale_features(_features(spark, sf), ["s", "e"], [], "robust").withColumn("t", F.col("s"))
    out = cluster.scale_features(out, [], ["t"], "min-max")
    return out.select("event_id", *[F.round(c, 5).alias(c) for c in ("s_scaled", "e_scaled", "t_scaled")])


_AUTO = f"""WITH RECURSIVE {_EV}, p AS (SELECT filepath AS recording, pos AS roi_no, s, e FROM ev),
 d AS (SELECT a.recording, a.roi_no AS x, b.roi_no AS y, sqrt((a.s - b.s) * (a.s - b.s) + (a.e - b.e) * (a.e - b.e)) AS d FROM p a JOIN p b ON a.recording = b.recording),
 r AS (SELECT recording, y, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY recording) AS n, min(y) OVER (PARTITION BY recording) AS low, max(y) OVER (PARTITION BY recording) AS high
  FROM (SELECT recording, x, min(d) AS y FROM d WHERE x <> y GROUP BY 1, 2) q WINDOW w AS (PARTITION BY recording ORDER BY y)),
 g AS (SELECT *, CASE WHEN high <= low THEN 0 ELSE CASE WHEN i = n - 1 THEN 1.0::DOUBLE ELSE i * (1.0::DOUBLE / (n - 1)) END - (y - low) / (high - low) END AS gap FROM r WHERE n >= 3),
 k AS (SELECT recording, greatest(2, round_even(0.05 * n, 0)) AS least, CASE WHEN gap > 0 AND y > 0 THEN y ELSE high END AS eps FROM (SELECT *, row_number() OVER (PARTITION BY recording ORDER BY gap DESC, i) AS place FROM g) q WHERE place = 1),
 near AS (SELECT d.recording, x, y, least FROM d JOIN k ON d.recording = k.recording AND d <= eps), core AS (SELECT recording, x FROM near GROUP BY recording, x, least HAVING count(*) >= least),
 links AS (SELECT near.recording, near.x, near.y FROM near JOIN core a ON near.recording = a.recording AND near.x = a.x JOIN core b ON near.recording = b.recording AND near.y = b.x),
 reach AS (SELECT recording, x, x AS y FROM core UNION SELECT r.recording, r.x, l.y FROM reach r JOIN links l ON r.recording = l.recording AND r.y = l.x),
 numbered AS (SELECT recording, x, dense_rank() OVER (PARTITION BY recording ORDER BY c) - 1 AS cluster FROM (SELECT recording, x, min(y) AS c FROM reach GROUP BY 1, 2) q),
 told AS (SELECT near.recording, near.x, min(cluster) AS cluster FROM near JOIN numbered m ON near.recording = m.recording AND near.y = m.x GROUP BY 1, 2),
 o AS (SELECT p.recording, roi_no, coalesce(cluster, -1)::INT AS cluster FROM p LEFT JOIN told ON told.recording = p.recording AND told.x = p.roi_no),
 best AS (SELECT recording, cluster, row_number() OVER (PARTITION BY recording ORDER BY count(*) DESC, cluster) AS r FROM o WHERE cluster >= 0 GROUP BY 1, 2)
 SELECT o.recording, roi_no, o.cluster, (b.cluster IS NOT NULL AND b.cluster = o.cluster)::INT AS keep_label FROM o LEFT JOIN best b ON o.recording = b.recording AND b.r = 1"""


@query("cluster_events", _AUTO)
def cluster_events(spark: SparkSession, sf: str) -> DataFrame:
    rows = X.ev(spark, sf).select(F.col("filepath").alias("recording"), F.col("pos").alias("roi_no"), "s", "e")
    return cluster.cluster_events(rows, ["s", "e"])


_CLUSTERS = f"""WITH RECURSIVE {_EV}, p AS (SELECT 'r' || label AS recording, CAST(substr(filepath, 2) AS BIGINT) * 64 + pos AS roi_no, s, e FROM ev),
 n AS (SELECT recording, greatest(2, round_even(0.008 * count(*), 0)) AS least FROM p GROUP BY 1), v AS (SELECT recording, s, e, count(*) AS w, min(roi_no) AS x FROM p GROUP BY 1, 2, 3),
 near AS (SELECT a.recording, a.x, b.x AS y, b.w FROM v a JOIN v b ON a.recording = b.recording AND b.s BETWEEN a.s - 0.15 AND a.s + 0.15 AND sqrt(pow(a.s - b.s, 2) + pow(a.e - b.e, 2)) <= 0.15),
 core AS (SELECT near.recording, x FROM near JOIN n ON near.recording = n.recording GROUP BY near.recording, x, least HAVING sum(w) >= least),
 links AS (SELECT near.recording, near.x, near.y FROM near JOIN core a ON near.recording = a.recording AND near.x = a.x JOIN core b ON near.recording = b.recording AND near.y = b.x),
 reach AS (SELECT recording, x, x AS y FROM core UNION SELECT r.recording, r.x, l.y FROM reach r JOIN links l ON r.recording = l.recording AND r.y = l.x),
 parts AS (SELECT recording, x, min(y) AS c FROM reach GROUP BY 1, 2), numbered AS (SELECT recording, x, dense_rank() OVER (PARTITION BY recording ORDER BY c) - 1 AS cluster FROM parts),
 told AS (SELECT near.recording, near.x, min(cluster) AS cluster FROM near JOIN numbered m ON near.recording = m.recording AND near.y = m.x GROUP BY 1, 2),
 o AS (SELECT p.recording, roi_no, coalesce(cluster, -1)::INT AS cluster FROM p JOIN v ON p.recording = v.recording AND p.s = v.s AND p.e = v.e LEFT JOIN told ON told.recording = v.recording AND told.x = v.x),
 best AS (SELECT recording, cluster, row_number() OVER (PARTITION BY recording ORDER BY count(*) DESC, cluster) AS r FROM o WHERE cluster >= 0 GROUP BY 1, 2)
 SELECT o.recording, roi_no, o.cluster, (b.cluster IS NOT NULL AND b.cluster = o.cluster)::INT AS keep_label FROM o LEFT JOIN best b ON o.recording = b.recording AND b.r = 1"""


@query("cluster_events_fixed", _CLUSTERS)
def cluster_events_fixed(spark: SparkSession, sf: str) -> DataFrame:
    """Ten recordings, one for each label: each is larger than a task clusters by itself."""
    rows = X.ev(spark, sf).select(F.concat(F.lit("r"), "label").alias("recording"), (F.substring("filepath", 2, 20).cast("long") * 64 + F.col("pos")).alias("roi_no"), "s", "e")
    return cluster.cluster_events(rows, ["s", "e"], 0.15, 0.8)


# ---- sources, sinks, streams: written to the shared folder and read again ----


@query("read_table", "SELECT p_partkey, p_name FROM part")
def read_table(spark: SparkSession, sf: str) -> DataFrame:
    return io.read_table(spark, f"{sf}/part.parquet", X.table(spark, sf, "part").select("p_partkey", "p_name").schema)


def _metadata(spark: SparkSession, sf: str) -> str:
    """A metadata file with the event types as class names."""
    path = io.scratch(spark, "metadata")
    names = X.vocabulary(spark, sf).agg(F.transform(F.sort_array(F.collect_list(F.struct("label_id", "code"))), lambda x: x["code"]).alias("names"))
    names.select(F.struct(F.struct("names", F.struct("names").alias("feature")).alias("labels")).alias("features")).coalesce(1).write.json(path)
    return path


_VOCABULARY = "SELECT (row_number() OVER (ORDER BY event_type) - 1)::INT AS label_id, event_type AS code FROM (SELECT DISTINCT event_type FROM events)"


@query("read_vocabulary", f"SELECT *, unnest(['multiclass', 'multilabel']) AS task FROM ({_VOCABULARY}) v")
def read_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    path, tasks = _metadata(spark, sf), ("multiclass", "multilabel")
    one, other = (io.read_vocabulary(spark, path, task).withColumn("task", F.lit(task)) for task in tasks)
    return one.unionByName(other)


@query("num_classes", "SELECT count(DISTINCT event_type) AS num_classes FROM events")
def num_classes(spark: SparkSession, sf: str) -> DataFrame:
    return io.num_classes(io.read_vocabulary(spark, _metadata(spark, sf), "multiclass"))


@query("read_code_list", _VOCABULARY)
def read_code_list(spark: SparkSession, sf: str) -> DataFrame:
    path = io.scratch(spark, "codes")
    io.write_codes(X.vocabulary(spark, sf).orderBy("label_id").coalesce(1), path, "code")
    return io.read_code_list(spark, path, "code")


@query("write_codes", "SELECT p_name AS code FROM part")
def write_codes(spark: SparkSession, sf: str) -> DataFrame:
    path = io.scratch(spark, "codes")
    io.write_codes(X.table(spark, sf, "part").select(F.col("p_name").alias("code")), path, "code")
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


@query("list_noise_files", "SELECT DISTINCT 'label=' || label AS folder FROM embeddings")
def list_noise_files(spark: SparkSession, sf: str) -> DataFrame:
    """The waveforms as noise clips in folders, one for each label; the folders of the files found."""
    folder = io.scratch(spark, "noise")
    X.table(spark, sf, "embeddings").select("label", "embedding").write.partitionBy("label").parquet(folder)
    return io.list_noise_files(spark, folder).select(F.regexp_extract("path", "(label=[^/]*)/part-", 1).alias("folder")).where("folder <> ''").distinct()


@query("write_metrics", "SELECT event_type AS name, round(max(value), 6) AS value FROM events GROUP BY 1")
def write_metrics(spark: SparkSession, sf: str) -> DataFrame:
    path = io.scratch(spark, "metrics")
    io.write_metrics(best_value(spark, sf).withColumnRenamed("best", "value"), path)
    return spark.read.schema("name string, value double").json(path)


@query("write_read_prepared", "SELECT p_partkey, CAST(p_partkey % 5 AS INT) AS fold, 'test' AS split FROM part WHERE p_partkey % 5 = 4")
def write_read_prepared(spark: SparkSession, sf: str) -> DataFrame:
    root, cfg = io.scratch(spark, "prepared"), {"task": "multiclass", "folds": 5}
    rows = fold_filter(spark, sf)
    path = io.write_prepared(rows, root, "part", 1, cfg)
    if io.write_prepared(rows.limit(0), root, "part", 1, cfg) != path:  # the same configuration is written once
        raise ValueError("one configuration has two paths")
    return io.read_prepared(spark, path, "test")


@query("stream_explode_events", ORACLES["explode_events"])
def stream_explode_events(spark: SparkSession, sf: str) -> DataFrame:
    given, out, state = (io.scratch(spark, n) for n in ("recordings", "rows", "state"))
    X.recordings(spark, sf).write.parquet(given)
    stream = spark.readStream.schema(spark.read.parquet(given).schema).option("maxFilesPerTrigger", 4).parquet(given)
    rows = streams.stream_explode_events(stream)
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return flat(spark.read.schema(rows.schema).parquet(out))


def _in_two_runs(start: Callable[[], object]) -> None:
    """A stream that is stopped and started again from the same checkpoint."""
    for _ in range(2):
        start().awaitTermination()


@query("stream_metric_counts", f"{_TOP} SELECT class::INT AS pred, label::INT AS true, count(*) AS total, sum((class = label)::INT)::BIGINT AS correct FROM r JOIN embeddings ON row_id = vec_id WHERE r = 1 GROUP BY 1, 2")
def stream_metric_counts(spark: SparkSession, sf: str) -> DataFrame:
    given, out, state = (io.scratch(spark, n) for n in ("predictions", "counts", "state"))
    rows = X.wide(spark, sf).select(metrics.top_classes(F.col("scores"), 1)[0].cast("int").alias("pred"), F.col("true").cast("int").alias("true"))

    def run() -> object:
        rows.where((F.col("pred") % 2 == 0) if not runs else (F.col("pred") % 2 == 1)).write.mode("append").parquet(given)
        runs.append(1)
        stream = spark.readStream.schema("pred int, true int").option("maxFilesPerTrigger", 4).parquet(given)
        return streams.start_metric_counts(stream, out, state, availableNow=True)

    runs: list[int] = []
    _in_two_runs(run)
    return streams.counts_sink(out).read(spark)


@query("stream_metric_states", _NAMED)
def stream_metric_states(spark: SparkSession, sf: str) -> DataFrame:
    """All registered metrics over a stream of predictions."""
    given, out, state = (io.scratch(spark, n) for n in ("predictions", "states", "state"))
    X.wide(spark, sf).select("scores", "targets").repartition(4, "scores").write.parquet(given)
    stream = spark.readStream.schema("scores array<double>, targets array<int>").option("maxFilesPerTrigger", 2).parquet(given)
    _in_two_runs(lambda: streams.start_metric_states(stream, out, state, availableNow=True))
    return metrics.finish_metrics(staged(streams.states_sink(out).read(spark), "merged")).select("name", R(F.col("value")).alias("value"))
