"""Forecasters behind one interface, and the prediction table they fill.

A forecaster is a function from (x, context) columns to a forecast column. context is a
column of the k neighbour windows on the query's scale, or None.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagspark.functions import arrays as A

from .retrieval import lookup

Forecaster = Callable[[Column, Column | None], Column]


def persistence(horizon: int) -> Forecaster:
    """The last value, repeated."""
    return lambda x, context=None: F.array_repeat(F.element_at(x, -1), horizon)


def seasonal(horizon: int, period: int) -> Forecaster:
    """The value one period before, repeated over further periods."""
    return lambda x, context=None: F.transform(
        F.sequence(F.lit(0), F.lit(horizon - 1)), lambda h: F.element_at(x, (h % period - period).cast("int"))
    )


def linear(weights: np.ndarray, bias: np.ndarray) -> Forecaster:
    """Dense weights (horizon x lags) and a bias; the product stays in Catalyst."""
    rows = [F.array(*[F.lit(float(v)) for v in row]) for row in weights]
    return lambda x, context=None: F.array(*[A.dot(x, w) + F.lit(float(b)) for w, b in zip(rows, bias)])


def blended(horizon: int, period: int) -> Forecaster:
    """Half the seasonal value, half the mean of the context's horizons: a forecaster that uses its context."""
    base = seasonal(horizon, period)

    def run(x: Column, context: Column | None) -> Column:
        plain = base(x, None)
        if context is None:
            return plain
        size = F.size(context)
        zero = F.array_repeat(F.lit(0.0), horizon)
        summed = F.aggregate(context, zero, lambda acc, w: F.zip_with(acc, F.slice(w, -horizon, horizon), lambda a, b: a + b))
        return F.zip_with(plain, summed, lambda a, b: F.when(size > 0, a * 0.5 + b / size * 0.5).otherwise(a))

    return run


def instance_normalised(model: Forecaster) -> Forecaster:
    """The model on (x - mean) / (std + eps), its output scaled back; the context passes unscaled."""

    def run(x: Column, context: Column | None = None) -> Column:
        mu, sd = A.mean(x), A.std(x) + A.EPS
        return F.transform(model(F.transform(x, lambda e: (e - mu) / sd), context), lambda e: e * sd + mu)

    return run


#: Names of the models; aliases share an entry.
MODELS: dict[str, Callable[..., Forecaster]] = {
    "persistence": persistence,
    "naive": persistence,
    "seasonal": seasonal,
    "blended": blended,
    "linear": linear,
}


def load_model(name: str, normalization: str = "none", **options) -> Forecaster:
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; there are {', '.join(sorted(MODELS))}")
    if normalization not in ("none", "instance"):
        raise ValueError(f"unknown normalization {normalization}")
    model = MODELS[name](**options)
    return instance_normalised(model) if normalization == "instance" else model


def batch_model(rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray], column: str = "pred", x: str = "x") -> DataFrame:
    """A model that must run in Python: lookbacks go to it a batch at a time by Arrow."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(predict(np.stack(v.to_list())), float))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn(column, run(x))


def payload(queries: DataFrame, neighbours: DataFrame, windows: DataFrame, vanilla: Forecaster, contextual: Forecaster, lookbacks: bool = False, stride: int | None = None) -> DataFrame:
    """One row a query: x, y, mu, sd, pred, pred_ctx and nbrs by rank.

    A neighbour holds rank, nt, nu, distance, its mu and sd, its horizon ys and residual es
    (actual minus its own forecast) on the query's scale. Neighbour windows are joined by
    key, so that only the k rows of a query are ever held. Queries without neighbours keep
    empty nbrs and their context forecast is the plain one. With lookbacks, a neighbour also
    holds its lookback xs on the query's scale. stride is that of a stored table of windows.
    """
    q = queries.select("split", F.col("t").alias("qt"), F.col("series_id").alias("qu"), "x", "y", "mu", "sd")
    found = lookup(neighbours, windows, stride).join(q.select("split", "qt", "qu", "mu", "sd"), ["split", "qt", "qu"])
    residual = F.zip_with("yc", vanilla(F.col("xc"), None), lambda a, b: a - b)
    scaled = found.withColumns(
        {
            "ys": A.transfer("yc", "mu_c", "sd_c", "mu", "sd"),
            "es": A.transfer_residual(residual, "sd_c", "sd"),
            "ws": A.transfer(F.concat("xc", "yc"), "mu_c", "sd_c", "mu", "sd"),
        }
    )
    one = F.struct("rank", "nt", "nu", "distance", F.col("mu_c").alias("mu"), F.col("sd_c").alias("sd"), "ys", "es", "ws")
    nested = scaled.groupBy("split", "qt", "qu").agg(F.array_sort(F.collect_list(one)).alias("nbrs"))
    whole = q.join(nested, ["split", "qt", "qu"], "left")
    context = F.transform("nbrs", lambda n: n["ws"])
    plain = vanilla(F.col("x"), None)
    ctx = F.when(F.col("nbrs").isNull(), plain).otherwise(contextual(F.col("x"), context))
    whole = whole.withColumns({"pred": plain, "pred_ctx": ctx})
    names, kind = ("rank", "nt", "nu", "distance", "mu", "sd", "ys", "es"), "rank:bigint,nt:bigint,nu:bigint,distance:double,mu:double,sd:double,ys:array<double>,es:array<double>"
    xs = lambda n: [F.slice(n["ws"], F.lit(1), F.size("x")).alias("xs")] if lookbacks else []
    drop = F.transform("nbrs", lambda n: F.struct(*[n[c].alias(c) for c in names], *xs(n)))
    kind += ",xs:array<double>" if lookbacks else ""
    return whole.withColumn("nbrs", F.coalesce(drop, F.array().cast(f"array<struct<{kind}>>")))
