"""Array arithmetic as Catalyst expressions (higher-order functions, no Python workers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(x) -> Column:
    return F.aggregate(_col(x), F.lit(0.0), lambda a, e: a + e)


def mean(x) -> Column:
    x = _col(x)
    return total(x) / F.size(x)


def variance(x) -> Column:
    """Population variance, in two passes over the array."""
    x = _col(x)
    return F.aggregate(
        F.array(mean(x)), F.lit(0.0), lambda _, m: total(F.transform(x, lambda e: (e - m) * (e - m))) / F.size(x)
    )


def std(x) -> Column:
    """Population standard deviation."""
    return F.sqrt(variance(x))


def clamped(sd) -> Column:
    """A scale kept away from zero; transfers and losses clamp."""
    return F.greatest(_col(sd), F.lit(EPS))


def dot(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: x * y))


def squared_distance(a, b) -> Column:
    return total(F.zip_with(_col(a), _col(b), lambda x, y: (x - y) * (x - y)))


def instance_normal(x, mu, sd) -> Column:
    """(x - mean) / (std + eps): features add the epsilon, they don't clamp."""
    mu, sd = _col(mu), _col(sd)
    return F.transform(_col(x), lambda e: (e - mu) / (sd + EPS))


def unit(x) -> Column:
    """x over its length, the length at least 1e-8."""
    x = _col(x)
    length = F.greatest(F.sqrt(dot(x, x)), F.lit(1e-8))
    return F.aggregate(F.array(length), x, lambda v, n: F.transform(v, lambda e: e / n))


def centred(x, mu) -> Column:
    mu = _col(mu)
    return F.transform(_col(x), lambda e: e - mu)


def transfer(v, mu_from, sd_from, mu_to, sd_to) -> Column:
    """Values of one window on another's scale."""
    a, b, c, d = clamped(sd_from), clamped(sd_to), _col(mu_from), _col(mu_to)
    return F.transform(_col(v), lambda e: (e - c) / a * b + d)


def transfer_residual(v, sd_from, sd_to) -> Column:
    """Residuals change scale only; they have no level to shift."""
    a, b = clamped(sd_from), clamped(sd_to)
    return F.transform(_col(v), lambda e: e / a * b)


def mse(pred, target) -> Column:
    return squared_distance(pred, target) / F.size(_col(target))


def mae(pred, target) -> Column:
    return total(F.zip_with(_col(pred), _col(target), lambda x, y: F.abs(x - y))) / F.size(_col(target))


def nmse(pred, target, sd) -> Column:
    s = clamped(sd)
    return total(F.zip_with(_col(pred), _col(target), lambda x, y: F.pow((x - y) / s, F.lit(2.0)))) / F.size(_col(target))


def softmax(x) -> Column:
    """Shifted by the maximum; the denominator is at least 1e-12."""
    x = _col(x)
    e = F.aggregate(F.array(F.array_max(x)), x, lambda v, m: F.transform(v, lambda y: F.exp(y - m)))
    return F.aggregate(F.array(e), x, lambda _, v: F.aggregate(F.array(F.greatest(total(v), F.lit(1e-12))), v, lambda w, s: F.transform(w, lambda y: y / s)))


def distance_weights(d) -> Column:
    """softmax of -(d - min) / max(std, eps) over a query's neighbours."""
    d = _col(d)
    low, spread = F.array_min(d), clamped(std(d))
    scaled = F.aggregate(F.array(F.struct(low.alias("m"), spread.alias("s"))), d, lambda v, p: F.transform(v, lambda e: -(e - p["m"]) / p["s"]))
    return softmax(scaled)


def weighted(weights, arrays) -> Column:
    """Sum over k of weights[k] * arrays[k][h]."""
    w, a = _col(weights), _col(arrays)
    zero = F.transform(a[0], lambda _: F.lit(0.0))
    return F.aggregate(
        F.arrays_zip(w.alias("w"), a.alias("a")),
        zero,
        lambda acc, p: F.zip_with(acc, p["a"], lambda x, y: x + p["w"] * y),
    )


def choose(use, a, b) -> Column:
    """Per step, a where use is true and b elsewhere."""
    return F.transform(F.arrays_zip(_col(use).alias("u"), _col(a).alias("a"), _col(b).alias("b")), lambda p: F.when(p["u"], p["a"]).otherwise(p["b"]))


def rounded(x, digits: int = 6) -> Column:
    return F.transform(_col(x), lambda e: F.round(e, digits))
