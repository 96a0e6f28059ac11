"""The learned mixture of four candidate forecasts and its loss.

Candidates at each step: plain forecast, context forecast, plain plus a residual shift,
plain plus a memory shift. Weights are a softmax over per-step gate scores. At the identity
start the shifts are zero and the gates of all but the first candidate are GATE_INIT.
Training is gradient descent on per-step gates and shift scales: each round is one
aggregation over the rows, and only the gradient's few numbers reach the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagspark.functions import arrays as A

GATE_INIT = -6.0
BETA = GAMMA = 1e-2


def identity_mixture(gate: float = GATE_INIT) -> Column:
    """The mixture before training: softmax of (0, g, g, g) over pred, pred_ctx, pred, pred."""
    rest = float(np.exp(gate) / (1 + 3 * np.exp(gate)))
    first = float(1 / (1 + 3 * np.exp(gate)))
    return F.zip_with("pred", "pred_ctx", lambda p, c: p * first + (c + p * 2) * rest)


def loss_terms(yhat: Column, residual: Column, memory: Column) -> dict[str, Column]:
    """Squared means on the query's scale: forecast error, distance from the plain forecast, and of both branches from the plain error."""
    s = A.clamped("sd")
    square = lambda a, b: A.mean(F.zip_with(a, b, lambda x, y: F.pow((x - y) / s, F.lit(2.0))))
    miss = F.zip_with("y", "pred", lambda y, p: y - p)
    return {"prediction": square(yhat, F.col("y")), "regularity": square(yhat, F.col("pred")), "residual": square(residual, miss), "memory": square(memory, miss)}


def loss(rows: DataFrame, yhat: Column, residual: Column, memory: Column, beta: float = BETA, gamma: float = GAMMA) -> DataFrame:
    """(split, loss): prediction + beta * regularity + gamma * (residual + memory), averaged."""
    t = loss_terms(yhat, residual, memory)
    return rows.groupBy("split").agg(F.avg(t["prediction"] + t["regularity"] * beta + (t["residual"] + t["memory"]) * gamma).alias("loss"))


def _candidates(h: str = "") -> list[Column]:
    return [F.col("p"), F.col("c"), F.col("p") + F.col("e"), F.col("m")]


def fit_mixture(frame: DataFrame, horizon: int, rounds: int = 20, rate: float = 0.5, beta: float = BETA) -> np.ndarray:
    """Per-step gate scores (horizon x 4) that lower the loss; frame is adapters.neighbour_frame() of the train split."""
    zipped = F.arrays_zip(*[F.col(c).alias(a) for c, a in (("pred", "p"), ("pred_ctx", "c"), ("ew", "e"), ("yw", "m"), ("y", "y"))])
    rows = frame.select("sd", F.posexplode(zipped).alias("h", "z")).select("h", A.clamped("sd").alias("s"), "z.*").cache()
    gates = np.tile([0.0, GATE_INIT / 3, GATE_INIT / 3, GATE_INIT / 3], (horizon, 1))
    for _ in range(rounds):
        w = np.exp(gates - gates.max(axis=1, keepdims=True))
        w /= w.sum(axis=1, keepdims=True)
        table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
        k = [table[F.col("h")][i] for i in range(4)]
        mix = sum((a * b for a, b in zip(k[1:], _candidates()[1:])), k[0] * _candidates()[0])
        slope = ((mix - F.col("y")) + (mix - F.col("p")) * beta) / F.pow("s", F.lit(2.0)) * 2
        grads = rows.groupBy("h").agg(*[F.avg(slope * k[i] * (_candidates()[i] - mix)).alias(f"g{i}") for i in range(4)]).collect()
        for g in grads:
            step = np.array([g[f"g{i}"] for i in range(4)])
            gates[g["h"]] -= rate * step / max(1.0, float(np.linalg.norm(step)))
    rows.unpersist()
    return gates


def apply_mixture(frame: DataFrame, gates: np.ndarray, name: str = "adapter") -> DataFrame:
    """Predictions of a fitted mixture."""
    w = np.exp(gates - gates.max(axis=1, keepdims=True))
    w /= w.sum(axis=1, keepdims=True)
    table = F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in w])
    zipped = F.arrays_zip(*[c.alias(a) for c, a in ((table, "w"), (F.col("pred"), "p"), (F.col("pred_ctx"), "c"), (F.col("ew"), "e"), (F.col("yw"), "m"))])
    yhat = F.transform(zipped, lambda z: z["w"][0] * z["p"] + z["w"][1] * z["c"] + z["w"][2] * (z["p"] + z["e"]) + z["w"][3] * z["m"])
    return frame.select("split", F.lit(name).alias("method"), "qt", "qu", "y", "sd", yhat.alias("yhat"))
