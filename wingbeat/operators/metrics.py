"""Prediction metrics over long rows (row_id, class, score, target) or wide rows (row_id, scores, targets).

Curve metrics first count by (class, score): that settles ties and shrinks what the ordered windows see.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays
from .prefix import in_ranges, running


def unpivot(df: DataFrame) -> DataFrame:
    """Wide to long."""
    return df.select("row_id", F.posexplode(F.arrays_zip("scores", "targets")).alias("class", "_z")).select("row_id", "class", F.col("_z.scores").cast("double").alias("score"), F.col("_z.targets").cast("int").alias("target"))


def by_score(long: DataFrame) -> DataFrame:
    return long.groupBy("class", "score").agg(F.sum("target").cast("double").alias("p"), F.count(F.lit(1)).cast("double").alias("n"))


def _curve(counts: DataFrame) -> DataFrame:
    """(class, score, p, n, tp, seen) of counts at each score: those of this and all higher scores; summed in ranges of each
    class's scores, so that no task gets a whole class, however close its scores."""
    c, bucket = in_ranges(counts, "score", ["class"], descending=True)
    return running(c, bucket, [F.desc("score")], {"tp": F.col("p"), "seen": F.col("n")}, by=["class"]).drop("_cuts")


def _precision() -> Column:
    return F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("seen")), F.sum("p"))


def per_class(counts: DataFrame) -> DataFrame:
    """(class, positives, ap, auroc) of (class, score, p, n). A positive is worth the negatives below it, half of those at its
    score: all negatives less those seen so far, of which half of the last ones come back."""
    c = _curve(counts)
    lost = F.sum(F.col("p") * (F.col("seen") - F.col("tp") - (F.col("n") - F.col("p")) / 2))
    won = F.try_divide(lost, F.sum("p") * F.sum(F.col("n") - F.col("p")))
    return c.groupBy("class").agg(F.sum("p").alias("positives"), _precision().alias("ap"), (1 - won).alias("auroc"))


def average_precision(long: DataFrame) -> DataFrame:
    """(class, positives, ap); ap is null for classes without positives."""
    return per_class(by_score(long)).select("class", "positives", "ap")


def cmap(long: DataFrame) -> DataFrame:
    return average_precision(long).agg(F.avg("ap").alias("cmap"))


def cmap_min_support(long: DataFrame, threshold: int = 5) -> DataFrame:
    return average_precision(long).where(F.col("positives") >= threshold).agg(F.avg("ap").alias("cmap"))


def padded_cmap(long: DataFrame, padding: int = 5) -> DataFrame:
    """With `padding` rows of score 1 and target 1 added to every class."""
    pad = long.select("class").distinct().withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(padding)))).select(F.lit(None).cast("long").alias("row_id"), "class", F.lit(1.0).alias("score"), F.lit(1).alias("target"))
    return cmap(long.select("row_id", "class", "score", "target").unionByName(pad))


def _micro(counts: DataFrame) -> DataFrame:
    c, bucket = in_ranges(counts.groupBy("score").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), "score", descending=True)
    return running(c, bucket, [F.desc("score")], {"tp": F.col("p"), "seen": F.col("n")}).agg(_precision().alias("map"))


def map_micro(long: DataFrame) -> DataFrame:
    """One AP over all pairs: running sums over score ranges, not one window."""
    return _micro(long.select("score", F.col("target").cast("double").alias("p"), F.lit(1.0).alias("n")))


def auroc(long: DataFrame) -> DataFrame:
    """(class, auroc), ties half; null without positives or negatives."""
    return per_class(by_score(long)).select("class", "auroc")


def auroc_macro(long: DataFrame) -> DataFrame:
    return auroc(long).agg(F.avg("auroc").alias("auroc"))


def top_classes(scores: Column, k: int) -> Column:
    """The k best classes, ties to the lower one."""
    order = F.array_sort(F.transform(scores, lambda x, i: F.struct((-x).alias("s"), i.alias("c"))))
    return F.transform(F.slice(order, 1, k), lambda t: t["c"])


def _hits(k: int, include_nocalls: bool, threshold: float) -> tuple[Column, Column]:
    """Whether a row counts, and whether it is right."""
    top = top_classes(F.col("scores"), k)
    empty = ~F.exists("targets", lambda t: t == 1)
    hit = F.exists(top, lambda c: F.col("targets")[c] == 1)
    quiet = F.forall(top, lambda c: F.col("scores")[c] < threshold)
    return (F.lit(True), F.when(empty, quiet).otherwise(hit)) if include_nocalls else (~empty, hit)


def topk_accuracy(wide: DataFrame, k: int, include_nocalls: bool = False, threshold: float = 0.5) -> DataFrame:
    counted, right = _hits(k, include_nocalls, threshold)
    return wide.agg(F.try_divide(F.sum(F.when(counted & right, 1).otherwise(0)), F.sum(F.when(counted, 1).otherwise(0))).alias("accuracy"))


def balanced_accuracy(df: DataFrame, classes: int, adjusted: bool = False, axis: str = "pred") -> DataFrame:
    """df (pred, true). Mean over classes of the share of hits, by predictions (as the original) or by true classes."""
    rows = df.groupBy(F.col(axis).alias("c")).agg((F.sum((F.col("pred") == F.col("true")).cast("int")) / F.count(F.lit(1))).alias("share"))
    score = F.avg("share")
    return rows.agg(((score - 1 / classes) / (1 - 1 / classes) if adjusted else score).alias("accuracy"))


def top5_accuracy(wide: DataFrame) -> DataFrame:
    """wide (scores, true)."""
    return wide.agg(F.avg(F.array_contains(top_classes(F.col("scores"), 5), F.col("true")).cast("int")).alias("accuracy"))


def multiclass_accuracy_f1(wide: DataFrame) -> DataFrame:
    """Accuracy and micro F1 of the best class; with one prediction a row both are the share of hits."""
    hit = (top_classes(F.col("scores"), 1)[0] == F.col("true")).cast("int")
    return wide.agg(F.avg(hit).alias("accuracy"), F.try_divide(2 * F.sum(hit), F.sum(F.lit(2))).alias("f1"))


def activate(df: DataFrame, kind: str = "multilabel") -> DataFrame:
    f = {"multilabel": arrays.sigmoid, "multiclass": arrays.softmax}[kind]
    return df.withColumn("scores", f(F.col("logits")))


def prediction_table(wide: DataFrame, k: int = 5) -> DataFrame:
    where = F.filter(F.transform("targets", lambda t, i: F.when(t == 1, i)), lambda i: i.isNotNull())
    join = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ", ")
    return wide.select("row_id", join(top_classes(F.col("scores"), k)).alias("predicted"), join(where).alias("positive"))


def _bce(z: Column, t: Column) -> Column:
    """Of a logit, in the form that can't overflow."""
    return F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))


def bce_loss(long: DataFrame) -> DataFrame:
    """long (logit, target)."""
    return long.agg(F.avg(_bce(F.col("logit"), F.col("target"))).alias("loss"))


def focal_loss(long: DataFrame, alpha: float | list[float] = 0.25, gamma: float = 2.0, reduction: str = "mean") -> DataFrame:
    a = F.lit(alpha) if isinstance(alpha, (int, float)) else F.element_at(F.array(*[F.lit(x) for x in alpha]), F.col("class") + 1)
    b = _bce(F.col("logit"), F.col("target"))
    loss = a * F.pow(1 - F.exp(-b), F.lit(gamma)) * b
    return long.withColumn("loss", loss) if reduction == "none" else long.agg({"mean": F.avg, "sum": F.sum}[reduction](loss).alias("loss"))


def asymmetric_loss(long: DataFrame, gamma_neg: float = 4.0, gamma_pos: float = 1.0, clip: float = 0.05, eps: float = 1e-8) -> DataFrame:
    """Sum over pairs; negatives count less by a probability shift and a stronger focus."""
    p = 1 / (1 + F.exp(-F.col("logit")))
    q = F.least(1 - p + clip, F.lit(1.0)) if clip else 1 - p
    t = F.col("target")
    base = t * F.log(F.greatest(p, F.lit(eps))) + (1 - t) * F.log(F.greatest(q, F.lit(eps)))
    weight = F.pow(1 - p * t - q * (1 - t), gamma_pos * t + gamma_neg * (1 - t))
    return long.agg((-F.sum(base * weight)).alias("loss"))


def asymmetric_loss_single(wide: DataFrame, gamma_neg: float = 4.0, gamma_pos: float = 1.0, smoothing: float = 0.1) -> DataFrame:
    """The single-label form with label smoothing: wide (logits, true)."""
    top = F.array_max("logits")
    shift = F.transform("logits", lambda x: (x - top).cast("double"))
    logsum = F.log(F.aggregate(shift, F.lit(0.0), lambda a, x: a + F.exp(x)))
    n = F.size("logits")

    def term(x: Column, i: Column) -> Column:
        logp = x - logsum
        hit = i == F.col("true")
        p = F.exp(logp)
        weight = F.when(hit, F.pow(1 - p, F.lit(gamma_pos))).otherwise(F.pow(p, F.lit(gamma_neg)))
        target = F.when(hit, 1.0).otherwise(0.0) * (1 - smoothing) + smoothing / n
        return -target * logp * weight

    return wide.agg(F.avg(F.aggregate(F.transform(shift, term), F.lit(0.0), lambda a, x: a + x)).alias("loss"))


def _named(one: DataFrame) -> DataFrame:
    """One row of metrics to (name, value)."""
    return one.select(F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in one.columns]), F.array(*[F.col(f"`{c}`").cast("double") for c in one.columns]))).alias("name", "value"))


def metric_set(long: DataFrame, support: int = 5) -> DataFrame:
    """Named curve metrics from one table of (class, score) counts: (name, value)."""
    per = per_class(by_score(long))
    return _named(per.agg(F.avg("ap").alias("cmap"), F.avg(F.when(F.col("positives") >= support, F.col("ap"))).alias(f"cmap{support}"), F.avg("auroc").alias("auroc")))


# ---- open sets of metrics with states that merge


@dataclass(frozen=True)
class Metric:
    """A named metric: what it adds to a state of predictions, and how its value comes from a merged state.

    kind: "curve" metrics share counts of targets at each score of a class, and `value` is an aggregate over
    (class, positives, ap, auroc), or a function of the counts that gives one row; "hits" metrics sum whether
    a row counts and is right.
    """

    kind: str
    value: Column | Callable[[DataFrame], DataFrame] | None = None
    hits: Callable[[], tuple[Column, Column]] | None = None


def curve_metric(value: Callable[[], Column]) -> Callable[[], Metric]:
    return lambda: Metric("curve", value())


def hits_metric(k: int, include_nocalls: bool = False, threshold: float = 0.5) -> Callable[[], Metric]:
    return lambda: Metric("hits", hits=lambda: _hits(k, include_nocalls, threshold))


def _padded(counts: DataFrame, padding: int = 5) -> DataFrame:
    rows = counts.select("class").distinct().select("class", F.lit(1.0).alias("score"), F.lit(float(padding)).alias("p"), F.lit(float(padding)).alias("n"))
    both = counts.unionByName(rows).groupBy("class", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return per_class(both).agg(F.avg("ap"))


#: Metrics by name; add to it with register_metric(). Entries are made when they are used, since columns need a session.
METRICS: dict[str, Callable[[], Metric]] = {
    "cmAP": curve_metric(lambda: F.avg("ap")),
    "cmAP5": curve_metric(lambda: F.avg(F.when(F.col("positives") >= 5, F.col("ap")))),
    "MultilabelAUROC": curve_metric(lambda: F.avg("auroc")),
    "mAP": lambda: Metric("curve", _micro),
    "pcmAP": lambda: Metric("curve", _padded),
    "T1Accuracy": hits_metric(1),
    "T3Accuracy": hits_metric(3),
}
STATE = "kind string, class int, score double, p double, n double"


def register_metric(name: str, metric: Callable[[], Metric]) -> None:
    METRICS[name] = metric


def metric_state(wide: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The state (STATE) of a batch of predictions (scores, targets): its size is that of the distinct scores of each class.

    kind "curve": p targets among n rows at a score of a class. Other kinds are names of hit metrics: p right of n.
    Rows whose scores or targets are null add nothing.
    """
    chosen = {n: METRICS[n]() for n in (METRICS if names is None else names)}
    rows = wide.where("scores is not null and targets is not null")
    state = None
    if any(m.kind == "curve" for m in chosen.values()):
        pair = F.posexplode(F.arrays_zip("scores", "targets")).alias("class", "z")
        long = rows.select(pair).select("class", F.col("z.scores").cast("double").alias("score"), F.col("z.targets").cast("int").alias("target"))
        state = by_score(long).select(F.lit("curve").alias("kind"), "class", "score", "p", "n")
    hits = {n: m.hits() for n, m in chosen.items() if m.kind == "hits"}
    if hits:
        each = [F.struct(F.lit(n).alias("kind"), (counted & right).cast("double").alias("p"), counted.cast("double").alias("n")) for n, (counted, right) in hits.items()]
        told = rows.select(F.explode(F.array(*each)).alias("h")).groupBy("h.kind").agg(F.sum("h.p").alias("p"), F.sum("h.n").alias("n"))
        told = told.select("kind", F.lit(None).cast("int").alias("class"), F.lit(None).cast("double").alias("score"), "p", "n")
        state = told if state is None else state.unionByName(told)
    return state


def merge_states(states: DataFrame) -> DataFrame:
    """One state of many, as of all their predictions together."""
    return states.groupBy("kind", "class", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def finish_metrics(state: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(name, value) of a merged state; metrics over classes share one pass."""
    chosen = {n: METRICS[n]() for n in (METRICS if names is None else names)}
    counts = state.where("kind = 'curve'").select("class", "score", "p", "n")
    shared = {n: m.value for n, m in chosen.items() if m.kind == "curve" and isinstance(m.value, Column)}
    parts = [_named(per_class(counts).agg(*[v.alias(n) for n, v in shared.items()]))] if shared else []
    parts += [_named(m.value(counts).toDF(n)) for n, m in chosen.items() if m.kind == "curve" and n not in shared]
    hits = [n for n, m in chosen.items() if m.kind == "hits"]
    if hits:
        parts.append(state.where(F.col("kind").isin(*hits)).select(F.col("kind").alias("name"), F.try_divide("p", "n").alias("value")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
