"""Boosted regression trees for gates: many small models, fitted side by side as Spark tasks.

A gate has a few dozen features and learns from at most MAX_ROWS rows (those of smallest
key hash), so one model fits a task; the models of all gates and steps are the groups of
one applyInPandas. Features are cut into BINS by quantiles, and each tree is grown level by
level from histograms of gradients. Scoring is one Arrow pass over all rows for all models.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a gate is fitted on at most: a bounded sample by hash.
MAX_ROWS = 100_000
BINS = 32


class Trees:
    """Complete trees of one depth: split features and thresholds by level order, and leaf values."""

    def __init__(self, start: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.start, self.feature, self.threshold, self.leaf = start, feature, threshold, leaf

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), int)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, logistic: bool, iterations: int, rate: float, depth: int, l2: float = 3.0) -> Trees:
    """Gradient boosting with squared or logistic loss; leaves are Newton steps with a penalty l2."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, col, side="left") for c, col in zip(cuts, x.T)], axis=1)
    p, inner, total = x.shape[1], 2**depth - 1, np.average(y, weights=weight)
    start = np.log(total / (1 - total)) if logistic else total
    value = np.full(len(y), start)
    features, thresholds, leaves = [], [], []
    for _ in range(iterations):
        if logistic:
            q = 1 / (1 + np.exp(-value))
            gradient, hessian = weight * (q - y), weight * q * (1 - q)
        else:
            gradient, hessian = weight * (value - y), weight
        node = np.zeros(len(y), int)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            place = ((node - first)[:, None] * p + np.arange(p)) * BINS + binned
            g, h = (np.bincount(place.ravel(), np.repeat(v, p), width * p * BINS).reshape(width, p, BINS) for v in (gradient, hessian))
            left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
            all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
            gain = left_g**2 / (left_h + l2) + (all_g - left_g) ** 2 / (all_h - left_h + l2) - all_g**2 / (all_h + l2)
            for f, c in enumerate(cuts):
                gain[:, f, len(c) :] = -np.inf
            best = gain.reshape(width, -1).argmax(axis=1)
            for k, b in enumerate(best):
                if gain[k].ravel()[b] > 1e-12:
                    feature[first + k], threshold[first + k] = b // BINS, cuts[b // BINS][b % BINS]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > threshold[node])
        leaf_g, leaf_h = (np.bincount(node - inner, v, inner + 1) for v in (gradient, hessian))
        leaf = -rate * leaf_g / (leaf_h + l2)
        value += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    shape = (iterations, inner)
    return Trees(float(start), np.array(features, int).reshape(shape), np.array(thresholds).reshape(shape), np.array(leaves).reshape(iterations, inner + 1))


def fit_all(rows: DataFrame, models: list[dict], key: Column, iterations: int, rate: float, depth: int, max_rows: int = MAX_ROWS) -> dict[str, Trees | float]:
    """Trees by name, or a constant score. models: dicts of name, classifier, target (Column) and features (Column of an array).

    A regressor's constant is its target where that does not vary; a classifier of one class scores +0.5 or -0.5.
    """
    n = rows.count()
    if not n:
        raise ValueError("no rows to fit on")
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int((1 << 40) * max_rows / n))
    each = F.array(
        *[F.struct(F.lit(m["name"]).alias("name"), F.lit(m["classifier"]).alias("classifier"), m["target"].cast("double").alias("y"), m["features"].alias("x")) for m in models]
    )
    long = rows.select(F.explode(each).alias("m")).select("m.*")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x, y = np.array(group["x"].to_list(), float), group["y"].to_numpy(float)
        name, logistic = group["name"].iloc[0], bool(group["classifier"].iloc[0])
        weight, constant = np.ones(len(y)), None
        if logistic:
            up = int((y > 0).sum())
            y, constant = (y > 0).astype(float), {0: -0.5, len(y): 0.5}.get(up)
            if constant is None:  # both classes weigh the same
                weight = np.where(y > 0, max(up, len(y) - up) / up, max(up, len(y) - up) / (len(y) - up))
        elif y.max() - y.min() <= 1e-12:
            constant = float(y[0])
        if constant is not None:
            made = [name, constant, True, [], [], []]
        else:
            t = boost(x, y, weight, logistic, iterations, rate, depth)
            made = [name, t.start, False, t.feature.ravel().tolist(), t.threshold.ravel().tolist(), t.leaf.ravel().tolist()]
        return pd.DataFrame([made], columns=["name", "start", "constant", "feature", "threshold", "leaf"])

    kinds = "name string, start double, constant boolean, feature array<int>, threshold array<double>, leaf array<double>"
    out: dict[str, Trees | float] = {}
    for r in long.groupBy("name").applyInPandas(fit, kinds).collect():  # one row a model
        inner = 2**depth - 1
        shaped = Trees(r["start"], np.array(r["feature"], int).reshape(-1, inner), np.array(r["threshold"]).reshape(-1, inner), np.array(r["leaf"]).reshape(-1, inner + 1))
        out[r["name"]] = r["start"] if r["constant"] else shaped
    return out


def score_all(rows: DataFrame, fitted: dict[str, Trees | float], models: list[dict], keys: list[str]) -> DataFrame:
    """keys and scores, a map from each model's name to its score: a value, a probability less 0.5, or the constant."""
    names = [m["name"] for m in models]
    logistic = {m["name"]: m["classifier"] for m in models}
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    inputs = rows.select(*keys, *[m["features"].alias(f"__x{i}") for i, m in enumerate(models)])
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = []
            for i, name in enumerate(names):
                model = shared.value[name]
                if isinstance(model, float):
                    columns.append(np.full(batch.num_rows, model))
                    continue
                x = np.array(batch.column(len(keys) + i).to_pylist(), float).reshape(batch.num_rows, -1)
                raw = model.raw(x) if len(x) else np.empty(0)
                columns.append(1 / (1 + np.exp(-raw)) - 0.5 if logistic[name] else raw)
            flat = np.stack(columns, axis=1) if columns else np.empty((batch.num_rows, 0))
            offsets = pa.array(np.arange(batch.num_rows + 1) * len(names), pa.int32())
            scores = pa.MapArray.from_arrays(offsets, pa.array(names * batch.num_rows, pa.string()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], scores], [*keys, "scores"])

    return inputs.mapInArrow(run, f"{kinds}, scores map<string,double>")
