"""Clustering of a recording's regions: scaling by counts of each recording, and density clustering (Ester et al. 1996).

A recording of at most SMALL rows is clustered within one task. A larger one is spread over many: equal rows become one
weighted vector, vectors are sorted into the cells of a grid whose cells are eps wide, in up to AXES of the features with
the widest ranges, and crowded cells are cut into tiles of about TILE vectors. Vectors within eps stand in cells that
adjoin, so tiles meet by an equi-join on cells; a tile is sent to each adjoining cell once for every SPREAD tiles there,
and the pairs of tiles are made and compared within the task, never shuffled. What comes back is one number a
vector: how many rows are near (core vectors), the links of a spanning forest (clusters, as connected components), or the
first cluster near (border vectors). With eps "auto" the nearest neighbours are searched in the same way, in grids that
get wider for the vectors not settled yet, and the knee is found on distances ranked in ranges.

Clusters are numbered within a recording by their first core row in order of roi_no; a border row belongs to the first
cluster near. Rows with a feature that is null or not finite are left out. Work grows with the pairs of vectors that
adjoin: features in which the grid can't tell vectors apart leave all pairs of a recording to compare.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import components
from .prefix import in_ranges, running
from .stats import keep_label
from .tables import join_null_safe, join_sized, staged

#: Rows of a distance matrix that are held at once.
ROWS = 1024
#: Rows of a recording that one task clusters.
SMALL = 2048
#: Recordings of at most so many rows are clustered many at once.
SHORT = 64
#: Features that make the grid, vectors of a tile, tiles of a cell that one task compares with others, pairs compared at once.
AXES, TILE, SPREAD, PAIRS = 3, 512, 64, 1 << 18
#: Vectors of a cell in the first search for nearest neighbours, and by how much the next ones are wider.
FIRST, WIDER = 8, 4.0

def _order_statistics(flat: DataFrame, shares: list[float]) -> DataFrame:
    """(recording, g, q): the interpolated quantiles of each group's x. Values are counted, ranked in ranges of each group, and
    those at the wanted ranks kept, so that no task holds a group's values."""
    by = ["recording", "g"]
    counts = flat.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("c"))
    rows, bucket = in_ranges(counts, "x", by)
    rows = join_null_safe(running(rows, bucket, [F.col("x")], {"upto": F.col("c")}, by=by), counts.groupBy(*by).agg(F.sum("c").alias("n")), by)
    place = lambda p: (F.col("n") - 1) * F.lit(p)
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), end(place(p)).cast("long").alias("at"), (place(p) - F.floor(place(p))).alias("part")) for i, p in enumerate(shares) for end in (F.floor, F.ceil)])
    held = F.filter(wanted, lambda w: (w["at"] < F.col("upto")) & (w["at"] >= F.col("upto") - F.col("c")))
    found = rows.select(*by, "x", F.explode(held).alias("w")).groupBy(*by, "w.i").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.first("w.part").alias("part"))
    value = F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part")
    return found.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", value.alias("v")))), lambda t: t["v"]).alias("q"))


def scale_features(df: DataFrame, shape: list[str], others: list[str], scaler: str = "standard") -> DataFrame:
    """Scale inside each recording: the shape columns together as if one, every other column by itself.

    scaler: min-max, robust (median and the interpolated quartiles), any other name: mean and deviation. Counts by
    recording and column have partial sums, so that a frequent recording isn't brought to one task as rows. A null
    recording is one recording; null values stay out of the counts and become 0, as does a column of one value.
    """
    group = {c: "shape" for c in shape} | {c: c for c in others}
    values = F.explode(F.array(*[F.struct(F.lit(g).alias("g"), F.col(c).cast("double").alias("x")) for c, g in group.items()]))
    flat = df.select("recording", values.alias("v")).select("recording", "v.g", "v.x").where("x is not null")
    if scaler == "robust":
        stats = _order_statistics(flat, [0.25, 0.5, 0.75]).select("recording", "g", F.col("q")[1].alias("centre"), (F.col("q")[2] - F.col("q")[0]).alias("width"))
    elif scaler == "min-max":
        stats = flat.groupBy("recording", "g").agg(F.min("x").alias("centre"), (F.max("x") - F.min("x")).alias("width"))
    else:
        stats = flat.groupBy("recording", "g").agg(F.avg("x").alias("centre"), F.stddev_pop("x").alias("width"))
    stats = stats.groupBy("recording").agg(F.map_from_entries(F.collect_list(F.struct("g", F.struct("centre", "width")))).alias("_s"))
    rows = join_null_safe(df, stats, ["recording"], "left")
    scaled = lambda c, g: F.coalesce(F.try_divide(F.col(c) - F.col("_s")[g]["centre"], F.col("_s")[g]["width"]), F.lit(0.0))
    return rows.withColumns({f"{c}_scaled": scaled(c, g) for c, g in group.items()}).drop("_s")


def knee(y: np.ndarray) -> float:
    """The value where a rising convex curve bends most: the largest gap under its chord (Satopaa et al. 2011)."""
    if len(y) < 3 or y[-1] <= y[0]:
        return 0.0
    x = np.linspace(0, 1, len(y))
    gap = x - (y - y[0]) / (y[-1] - y[0])
    k = int(np.argmax(gap))
    return float(y[k]) if gap[k] > 0 else 0.0


def _near(x: np.ndarray, eps: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Each row's neighbours within eps, and its distance to the nearest other row; a block of rows at a time."""
    lists, nearest = [], np.zeros(len(x))
    for at in range(0, len(x), ROWS):
        d = np.sqrt(((x[at : at + ROWS, None, :] - x[None, :, :]) ** 2).sum(axis=2))
        lists += [np.flatnonzero(row <= eps) for row in d]
        d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
        nearest[at : at + len(d)] = d.min(axis=1)
    return lists, nearest


def dbscan(x: np.ndarray, eps: float, min_points: int) -> np.ndarray:
    near, _ = _near(x, eps)
    label = np.full(len(x), -1)
    core = np.array([len(a) >= min_points for a in near], bool)
    cluster = 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        todo = [i]
        label[i] = cluster
        while todo:
            j = todo.pop()
            if core[j]:
                fresh = near[j][label[near[j]] < 0]
                label[fresh] = cluster
                todo.extend(fresh.tolist())
        cluster += 1
    return label


def _one(x: np.ndarray, eps: float | str, pct: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and keep_label of one recording's rows."""
    if len(x) < 3:
        return np.full(len(x), -1), np.zeros(len(x), int)
    width = eps
    if eps == "auto":
        nearest = np.sort(_near(x, 0.0)[1])
        width = knee(nearest) or float(nearest[-1])
    label = dbscan(x, float(width), max(2, round(pct / 100 * len(x))))
    found = label[label >= 0]
    best = np.argmax(np.bincount(found)) if len(found) else -2
    return label, (label == best).astype(int)


def _alike(x: np.ndarray, eps: float | str, pct: float) -> tuple[np.ndarray, np.ndarray]:
    """As _one, of many recordings with the same number of rows, at least 3; x: (recordings, rows, features)."""
    k, n, _ = x.shape
    d = np.sqrt(((x[:, :, None, :] - x[:, None, :, :]) ** 2).sum(axis=3))
    if eps == "auto":
        other = d.copy()
        other[:, np.arange(n), np.arange(n)] = np.inf
        nearest = np.sort(other.min(axis=2), axis=1)
        low, high = nearest[:, :1], nearest[:, -1:]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = np.where(high > low, np.linspace(0, 1, n) - (nearest - low) / (high - low), 0.0)
        at = gap.argmax(axis=1)
        bend = np.where(gap[np.arange(k), at] > 0, nearest[np.arange(k), at], 0.0)
        width = np.where(bend > 0, bend, nearest[:, -1])[:, None, None]
    else:
        width = float(eps)
    near = d <= width
    core = near.sum(axis=2) >= max(2, round(pct / 100 * n))
    # the first core row that each one reaches
    links, first = near & core[:, None, :], np.where(core, np.arange(n), n)
    while True:
        low = np.where(core, np.minimum(first, np.where(links, first[:, None, :], n).min(axis=2)), n)
        if (low == first).all():
            break
        first = low
    start = first == np.arange(n)
    number = np.where(core, np.take_along_axis(np.cumsum(start, axis=1) - 1, np.minimum(first, n - 1), axis=1), n)
    label = np.where(core, number, np.where(links, number[:, None, :], n).min(axis=2))
    size = (label[:, None, :] == np.arange(n)[None, :, None]).sum(axis=2)
    keep = (label == size.argmax(axis=1)[:, None]) & (label < n)
    return np.where(label < n, label, -1), keep.astype(int)


def _each(x: np.ndarray, first: np.ndarray, eps: float | str, pct: float) -> tuple[np.ndarray, np.ndarray]:
    """Cluster and keep_label of the rows of recordings that begin at `first`; short ones are taken together by their number of rows."""
    label, keep = np.full(len(x), -1), np.zeros(len(x), int)
    n = np.diff(np.append(first, len(x)))
    for size in np.unique(n[n >= 3]).tolist():
        starts = first[n == size]
        if size > SHORT:
            for at in starts.tolist():
                label[at : at + size], keep[at : at + size] = _one(x[at : at + size], eps, pct)
            continue
        some = max(1, PAIRS // (size * size))
        for i in range(0, len(starts), some):
            at = starts[i : i + some, None] + np.arange(size)
            label[at], keep[at] = _alike(x[at], eps, pct)
    return label, keep


def _in_tasks(rows: DataFrame, d: int, eps: float | str, pct: float) -> DataFrame:
    """(recording, roi_no, cluster, keep_label) of small recordings, each within a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows, many recordings at once; a batch's last recording waits for the next batch."""
        left: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                name = batch.column("recording")
                last = batch.num_rows - 1
                changes = np.flatnonzero(np.asarray(pc.not_equal(name.slice(1), name.slice(0, last)))) + 1
                if not len(changes) and (not left or left[-1].column("recording")[0] == name[0]):
                    left.append(batch)
                    continue
                if not len(changes):
                    yield told(left)
                    left = [batch]
                    continue
                yield told([*left, batch.slice(0, int(changes[-1]))])
                left = [batch.slice(int(changes[-1]))]
        if left:
            yield told(left)

    def told(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        name = table.column("recording")
        x = table.column("x").flatten().to_numpy().reshape(-1, d)
        first = np.concatenate([[0], np.flatnonzero(np.asarray(pc.not_equal(name.slice(1), name.slice(0, len(name) - 1)))) + 1])
        label, keep = _each(x, first, eps, pct)
        return pa.RecordBatch.from_arrays([name, table.column("roi_no"), pa.array(label.astype(np.int32)), pa.array(keep.astype(np.int32))], names=["recording", "roi_no", "cluster", "keep_label"])

    return rows.repartition("recording").sortWithinPartitions("recording", "roi_no").mapInArrow(run, f"recording string, roi_no {dict(rows.dtypes)['roi_no']}, cluster int, keep_label int")


def _compared(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The pairs of vectors of each row's two tiles, some at once: their places in the batch's left and right lists, their distance, and the row."""
    n, m = (np.diff(batch.column(c).offsets.to_numpy()).astype(np.int64) for c in ("point", "r_point"))
    left, right = (batch.column(c).flatten().to_numpy().reshape(-1, batch.column("d")[0].as_py()) for c in ("x", "r_x"))
    l_first, r_first, total = np.cumsum(n) - n, np.cumsum(m) - m, n * m
    at = 0
    while at < len(total):
        stop = max(at + 1, at + int(np.searchsorted(np.cumsum(total[at:]), PAIRS, "right")))
        t = total[at:stop]
        row = np.repeat(np.arange(at, stop), t)
        k = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t)
        i, j = l_first[row] + k // m[row], r_first[row] + k % m[row]
        yield i, j, np.sqrt(((left[i] - right[j]) ** 2).sum(axis=1)), row
        at = stop


def _forest(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links (x, y) connect, at most one a node."""
    nodes, place = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = place[: len(x)], place[len(x) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def _comparing(kind: str) -> Callable:
    """Pairs of tiles to numbers of the left vectors (point, value): rows near ("count"), the nearest distance ("nearest"), the
    least tag near ("border"); or to links (x, y) of vectors near ("links")."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            point, other, weight, tag = (batch.column(c).flatten().to_numpy() for c in ("point", "r_point", "r_w", "r_tag"))
            eps = batch.column("eps").to_numpy()
            value = np.zeros(len(point)) if kind == "count" else np.full(len(point), np.inf)
            links = []
            for i, j, far, row in _compared(batch):
                if kind == "nearest":
                    some = point[i] != other[j]
                    np.minimum.at(value, i[some], far[some])
                    continue
                near = far <= eps[row]
                if kind == "links":
                    near &= point[i] < other[j]
                    links.append(_forest(point[i[near]], other[j[near]]))
                elif kind == "count":
                    np.add.at(value, i[near], weight[j[near]])
                else:
                    np.minimum.at(value, i[near], tag[j[near]])
            if kind == "links":
                x, y = (np.concatenate([pair[k] for pair in links]) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["x", "y"])
            else:
                some = value > 0 if kind == "count" else np.isfinite(value)
                yield pa.RecordBatch.from_arrays([pa.array(point[some]), pa.array(value[some])], names=["point", "value"])

    return run


class _Grid:
    """Vectors in the cells of a grid. vectors: (recording, point, x, w, tag), grid: (recording, low, axes, width, eps), both written."""

    def __init__(self, vectors: DataFrame, grid: DataFrame, d: int):
        self.d, self.axes = d, min(d, AXES)
        rows = join_sized(vectors, grid, "recording", "inner", F.length("recording") + 8 * (d + 4))
        rows = rows.withColumn("cell", F.transform("axes", lambda a: F.floor((F.element_at("x", a) - F.element_at("low", a)) / F.col("width")).cast("long")))
        self.rows = rows.select("recording", "cell", "eps", "point", "x", "w", "tag")
        crowd = self.rows.groupBy("recording", "cell").count().where(F.col("count") > TILE)
        self.crowded = staged(crowd.select("recording", "cell", F.ceil(F.col("count") / TILE).cast("int").alias("parts")), "crowded")
        self.size = F.length("recording") + 8 * self.axes + 16

    def _tiles(self, rows: DataFrame) -> DataFrame:
        dealt = join_sized(rows, self.crowded, ["recording", "cell"], "left", self.size)
        dealt = dealt.withColumn("part", F.pmod(F.xxhash64("point"), F.coalesce("parts", F.lit(1))))
        listed = dealt.groupBy("recording", "cell", "part").agg(F.first("eps").alias("eps"), F.collect_list(F.struct("point", "w", "tag", "x")).alias("t"))
        return listed.select("recording", "cell", "part", "eps", "t.point", "t.w", "t.tag", F.flatten("t.x").alias("x"))

    def met(self, kind: str, left: Callable[[DataFrame], DataFrame] = lambda rows: rows, right: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """What _comparing(kind) tells of all pairs of a left and a right vector in cells that adjoin."""
        salts = self.crowded.where(F.col("parts") > SPREAD).select("recording", "cell", F.ceil(F.col("parts") / SPREAD).alias("salts"))
        step = F.array(*[F.array(*[F.lit(x).cast("long") for x in s]) for s in itertools.product((-1, 0, 1), repeat=self.axes)])
        a = self._tiles(left(self.rows)).withColumn("cell", F.explode(F.transform(step, lambda s: F.zip_with("cell", s, lambda p, q: p + q))))
        a = join_sized(a, salts, ["recording", "cell"], "left", self.size).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)))
        b = join_sized(self._tiles(right(self.rows)), salts, ["recording", "cell"], "left", self.size)
        b = b.select("recording", "cell", F.pmod("part", F.coalesce("salts", F.lit(1))).alias("salt"), *[F.col(c).alias(f"r_{c}") for c in ("point", "w", "tag", "x")])
        pairs = a.join(b, ["recording", "cell", "salt"]).select(F.lit(self.d).alias("d"), "eps", "point", "x", "r_point", "r_w", "r_tag", "r_x")
        return pairs.mapInArrow(_comparing(kind), "x long, y long" if kind == "links" else "point long, value double")


def _shape(vectors: DataFrame, d: int) -> DataFrame:
    """(recording, n, vectors, low, axes, ranges): rows, distinct vectors, least values, and the axes of widest range with their ranges."""
    each = [F.element_at("x", i + 1) for i in range(d)]
    low, high = F.array(*[F.min(e) for e in each]), F.array(*[F.max(e) for e in each])
    out = vectors.groupBy("recording").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("vectors"), low.alias("low"), high.alias("high"))
    wide = F.transform(F.zip_with("high", "low", lambda h, lo: h - lo), lambda r, i: F.struct(r.alias("r"), (i + 1).alias("axis")))
    out = out.withColumn("wide", F.slice(F.sort_array(wide, asc=False), 1, min(d, AXES)))
    return staged(out.select("recording", "n", "vectors", "low", F.col("wide.axis").alias("axes"), F.col("wide.r").alias("ranges")), "shape")


def _nearest(vectors: DataFrame, shape: DataFrame, d: int) -> DataFrame:
    """(recording, point, w, value): each row's distance to the nearest other row; 0 for rows that have an equal."""
    some = F.filter("ranges", lambda r: r > 0)
    volume = F.aggregate(some, F.lit(0.0), lambda a, r: a + F.log(r)) + F.log(F.lit(float(FIRST)) / F.col("vectors"))
    most = F.array_max("ranges")
    width = F.when(F.size(some) > 0, F.greatest(F.exp(volume / F.size(some)), most * F.lit(2.0**-40))).otherwise(F.lit(1.0))
    grid = shape.select("recording", "low", "axes", width.alias("width"), most.alias("most"), F.lit(0.0).alias("eps"))
    done = vectors.where("w > 1").select("point", F.lit(0.0).alias("value"))
    left = staged(vectors.where("w = 1").select("point"), "left")
    while not left.isEmpty():
        now = staged(grid, "grid")
        own = left
        found = _Grid(vectors, now.drop("most"), d).met("nearest", left=lambda rows: rows.join(own, "point", "left_semi"))
        best = found.groupBy("point").agg(F.min("value").alias("value"))
        asked = vectors.join(left, "point", "left_semi").select("point", "recording").join(best, "point", "left")
        told = staged(join_sized(asked, now.select("recording", "width", "most"), "recording", "inner", F.length("recording") + 16), "told")
        # settled: nothing nearer stands beyond the cells that adjoin; a vector alone in its recording has no other
        settled = (F.coalesce("value", F.lit(float("inf"))) <= F.col("width")) | (F.col("width") >= F.col("most"))
        done = done.unionByName(told.where(settled).select("point", F.coalesce("value", F.lit(0.0)).alias("value")))
        left = staged(told.where(~settled).select("point"), "left")
        grid = now.withColumn("width", F.col("width") * WIDER)
    return vectors.select("recording", "point", "w").join(done, "point")


def _knees(nearest: DataFrame) -> DataFrame:
    """(recording, eps): knee() of each recording's distances in order; where there is none, the largest distance."""
    counts = staged(nearest.groupBy("recording", "value").agg(F.sum("w").alias("c")), "distances")
    rows, bucket = in_ranges(counts, "value", ["recording"])
    ranked = running(rows, bucket, [F.col("value")], {"upto": F.col("c")}, by=["recording"]).drop("_cuts")
    ends = counts.groupBy("recording").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("c").alias("n"))
    gap = F.when(F.col("upto") == F.col("n"), 1.0).otherwise((F.col("upto") - 1) * (F.lit(1.0) / (F.col("n") - 1))) - F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low"))
    best = ranked.join(ends, "recording").withColumn("gap", gap).groupBy("recording").agg(F.max(F.struct("gap", (-F.col("value")).alias("neg"))).alias("b"), F.first("high").alias("high"))
    at = F.when(F.col("b.gap") > 0, -F.col("b.neg"))
    return best.select("recording", F.when(at > 0, at).otherwise(F.col("high")).alias("eps"))


def _in_grid(rows: DataFrame, d: int, eps: float | str, pct: float) -> DataFrame:
    """(recording, roi_no, cluster, keep_label) of large recordings."""
    vectors = rows.groupBy("recording", "x").agg(F.count(F.lit(1)).alias("w"), F.min("roi_no").alias("first"))
    vectors = staged(vectors.withColumn("point", F.monotonically_increasing_id()).withColumn("tag", F.lit(0.0)), "vectors")
    shape = _shape(vectors, d)
    own = _knees(_nearest(vectors, shape, d)) if eps == "auto" else shape.select("recording", F.lit(float(eps)).alias("eps"))
    most = F.array_max("ranges")
    width = F.greatest("eps", F.when(most > 0, most * F.lit(2.0**-40)).otherwise(F.lit(1.0)))
    grid = staged(shape.join(own, "recording").select("recording", "low", "axes", width.alias("width"), "eps"), "grid")
    least = shape.select("recording", F.greatest(F.lit(2), F.bround(F.lit(pct) / 100 * F.col("n"))).alias("least"))
    cells = _Grid(vectors, grid, d)
    near = cells.met("count").groupBy("point").agg(F.sum("value").alias("near"))
    near = vectors.select("recording", "point", "first").join(near, "point")
    core = staged(join_sized(near, staged(least, "least"), "recording", "inner", F.length("recording") + 8).where("near >= least").select("recording", "point", "first"), "core")
    cores = lambda x: x.join(core.select("point"), "point", "left_semi")
    of = components(cells.met("links", cores, cores))
    named = core.join(of.withColumnRenamed("node", "point"), "point", "left").withColumn("component", F.coalesce("component", "point"))
    # one row a cluster: as many of a recording as n / least at most
    numbers = named.groupBy("recording", "component").agg(F.min(F.struct("first", "point")).alias("start"))
    numbers = numbers.withColumn("number", (F.row_number().over(W.partitionBy("recording").orderBy("start")) - 1).cast("double"))
    inner = staged(named.join(numbers.select("component", "number"), "component").select("point", F.col("number").alias("tag")), "inner")
    border = cells.met("border", lambda x: x.join(inner, "point", "left_anti"), lambda x: x.drop("tag").join(inner, "point"))
    labels = inner.unionByName(border.groupBy("point").agg(F.min("value").alias("tag")))
    told = vectors.select("recording", "x", "point").join(labels, "point", "left").select("recording", "x", F.coalesce(F.col("tag").cast("int"), F.lit(-1)).alias("cluster"))
    out = staged(rows.join(told, ["recording", "x"]).select("recording", "roi_no", "cluster"), "clustered")
    return keep_label(out)


def cluster_events(df: DataFrame, features: list[str], eps: float | str = "auto", pct: float = 5.0) -> DataFrame:
    """(recording, roi_no, cluster, keep_label); fewer than 3 rows are noise, a null recording is one recording.

    eps: a distance, or "auto" for the knee of the distances to the nearest neighbour. A cluster's core rows have at
    least pct % of the recording's rows (2 at least) within eps, themselves among them. keep_label marks the rows of
    the largest cluster.
    """
    values = [F.col(c).cast("double") for c in features]
    rows = df.select(F.col("recording").cast("string").alias("recording"), "roi_no", F.array(*values).alias("x"))
    rows = rows.where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
    named = rows.withColumns({"recording": F.coalesce(F.concat(F.lit("r"), "recording"), F.lit("null"))})  # so that null is a name like any other
    large = staged(named.groupBy("recording").count().where(F.col("count") > SMALL).select("recording"), "large")
    if large.isEmpty():
        out = _in_tasks(named, len(features), eps, pct)
    else:
        size = F.length("recording") + 16
        out = _in_tasks(join_sized(named, large, "recording", "left_anti", size), len(features), eps, pct)
        out = out.unionByName(_in_grid(staged(join_sized(named, large, "recording", "left_semi", size), "rows"), len(features), eps, pct))
    return out.withColumn("recording", F.when(F.col("recording") != "null", F.substring("recording", 2, 1 << 30)))
