"""Sample arrays: one expression for each operator, without a shuffle.

Null arrays give null; empty arrays give empty or padded ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column, f=lambda x: x) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def pad_truncate(a: Column, n: int, value: float = 0.0) -> Column:
    return F.slice(F.concat(a, F.array_repeat(F.lit(value).cast("float"), n)), 1, n)


def attention_mask(a: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i <= F.size(a), 1).otherwise(0))


def instance_norm(a: Column, length: Column | None = None) -> Column:
    """(x - mean) / sqrt(sample variance + 1e-7) over the first `length` values; the padding becomes 0."""
    n = F.size(a) if length is None else F.least(length, F.size(a))
    own = F.slice(a, F.lit(1), n)
    mean = _total(own) / n
    var = F.try_divide(F.aggregate(own, F.struct(F.lit(0.0).alias("s"), mean.alias("m")), lambda s, x: F.struct((s["s"] + (x - s["m"]) * (x - s["m"])).alias("s"), s["m"].alias("m")), lambda s: s["s"]), n - 1)
    # mean and deviation are computed once a row: they ride along as an array argument
    stat = F.array(mean, F.sqrt(var + 1e-7))
    return F.flatten(F.transform(F.array(stat), lambda t: F.transform(a, lambda x, i: F.when(i < n, (x - t[0]) / t[1]).otherwise(0.0))))


def min_max_scale(a: Column, mask: Column) -> Column:
    """2 (x - min) / (max - min + 1e-7) - 1 over unmasked values; masked ones become 0."""
    own = F.filter(F.zip_with(a, mask, lambda x, m: F.when(m == 1, x)), lambda x: x.isNotNull())
    ends = F.array(F.array_min(own), F.array_max(own))
    return F.flatten(F.transform(F.array(ends), lambda t: F.zip_with(a, mask, lambda x, m: F.when(m == 1, 2 * (x - t[0]) / (t[1] - t[0] + 1e-7) - 1).otherwise(0.0))))


def peak_norm(a: Column, peak: float = 0.25) -> Column:
    mean = F.try_divide(_total(a), F.size(a))
    centred = F.flatten(F.transform(F.array(mean), lambda m: F.transform(a, lambda x: x - m)))
    top = F.array_max(F.transform(centred, lambda x: F.abs(x)))
    return F.flatten(F.transform(F.array(F.struct(centred.alias("c"), top.alias("t"))), lambda s: F.transform(s["c"], lambda x: F.when(s["t"] > 0, x / s["t"]).otherwise(x) * peak)))


def standardize(a: Column, mean: float = -4.268, std: float = 4.569) -> Column:
    return F.transform(a, lambda x: (x - mean) / std)


def power_to_db(a: Column, ref: float = 1.0, amin: float = 1e-10, top_db: float | None = 80.0) -> Column:
    if amin <= 0 or top_db is not None and top_db < 0:
        raise ValueError("amin must be positive, top_db not negative")
    db = F.transform(a, lambda x: 10 * F.log10(F.greatest(x.cast("double"), F.lit(amin))) - 10 * F.log10(F.greatest(F.lit(abs(ref)).cast("double"), F.lit(amin))))
    if top_db is None:
        return db
    return F.flatten(F.transform(F.array(F.struct(db.alias("d"), (F.array_max(db) - top_db).alias("f"))), lambda s: F.transform(s["d"], lambda x: F.greatest(x, s["f"]))))


def resize_2d(a: Column, height: int | None = None, width: int = 1024, db: bool = True) -> Column:
    """Pad below and to the right with -80 (dB) or 0, or cut."""
    value = F.lit(-80.0 if db else 0.0)
    rows = F.transform(a, lambda r: F.slice(F.concat(r.cast("array<double>"), F.array_repeat(value, width)), 1, width))
    return rows if height is None else F.slice(F.concat(rows, F.array_repeat(F.array_repeat(value, width), height)), 1, height)


def center_pad(a: Column, width: int, value: float = 0.0) -> Column:
    """Pad the lesser half left and the rest right; a longer array loses as much at either side."""
    d = F.lit(width) - F.size(a)
    left = F.floor(d / 2).cast("int")
    padded = F.concat(F.array_repeat(F.lit(value), F.greatest(left, F.lit(0))), a.cast("array<double>"), F.array_repeat(F.lit(value), F.greatest(d - left, F.lit(0))))
    return F.slice(padded, F.greatest(-left, F.lit(0)) + 1, F.lit(width))


def mono(channels: Column) -> Column:
    """Mean over channels (array of arrays) at each sample."""
    return F.transform(channels[0], lambda x, i: _total(F.transform(channels, lambda c: c[i])) / F.size(channels))


def slice_samples(a: Column, start: Column, stop: Column) -> Column:
    return F.slice(a, start + 1, F.greatest(stop - start, F.lit(0)))


def band_features(spectrum: Column, freqs: Column, drop_db: float = 6.0) -> Column:
    """struct(peak_f, min_f, max_f, centroid_f, bandwidth_f) of a mean spectrum in dB."""
    top = F.array_max(spectrum)
    over = F.filter(F.zip_with(spectrum, freqs, lambda s, f: F.struct(s.alias("s"), f.alias("f"))), lambda x: x["s"] > top - drop_db)
    low, high = F.element_at(over, 1)["f"], F.element_at(over, -1)["f"]
    peak = F.element_at(freqs, F.array_position(spectrum, top).cast("int"))
    return F.struct(peak.alias("peak_f"), low.alias("min_f"), high.alias("max_f"), ((low + high) / 2).alias("centroid_f"), (high - low).alias("bandwidth_f"))


def sigmoid(a: Column) -> Column:
    return F.transform(a, lambda x: 1 / (1 + F.exp(-x.cast("double"))))


def softmax(a: Column) -> Column:
    e = F.flatten(F.transform(F.array(F.array_max(a)), lambda m: F.transform(a, lambda x: F.exp((x - m).cast("double")))))
    return F.flatten(F.transform(F.array(F.struct(e.alias("e"), _total(e).alias("t"))), lambda s: F.transform(s["e"], lambda x: x / s["t"])))


def one_hot(labels: Column, num_classes: int) -> Column:
    """A float vector of fixed length; null labels give zeros."""
    return F.transform(F.sequence(F.lit(0), F.lit(num_classes - 1)), lambda i: F.coalesce(F.array_contains(labels, i), F.lit(False)).cast("float"))
