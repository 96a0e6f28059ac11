"""Attention over a query's neighbours, and a patch transformer, as NumPy passes on Arrow batches.

The adapter reads a prediction table whose neighbours carry their lookbacks xs (see
forecasts.payload). On the query's scale it forms four candidates at each step: the plain
forecast, the context forecast, and the plain one plus a residual and plus a memory shift.
Two attention blocks over the neighbours feed the shifts' heads, a third one the softmax
weights of the candidates. A fresh adapter has zero output layers and gate scores of
GATE_INIT, which is the identity mixture.

Training fits the output layers of the three heads; the blocks before them keep their seeded
weights, so what they give is worked out once and cached. A round is one Spark job: every
partition sums the gradient of its rows, partial sums meet in GROUPS tasks, and the driver
takes an Adam step on a few thousand numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagspark.functions import arrays as A

from .mixture import BETA, GAMMA, GATE_INIT

GROUPS = 32
TINY = 1e-5


def _layer(rng: np.random.Generator, n_in: int, n_out: int) -> tuple[np.ndarray, np.ndarray]:
    bound = 1 / np.sqrt(n_in)
    return rng.uniform(-bound, bound, (n_in, n_out)), rng.uniform(-bound, bound, n_out)


def _dense(layer, x: np.ndarray) -> np.ndarray:
    return x @ layer[0] + layer[1]


def _norm(x: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + TINY)


def _gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(np.sqrt(2 / np.pi) * (x + 0.044715 * x**3)))


def _softmax(x: np.ndarray, axis: int) -> np.ndarray:
    e = np.exp(x - x.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def attend(q: np.ndarray, k: np.ndarray, v: np.ndarray, heads: int) -> tuple[np.ndarray, np.ndarray]:
    """Multi-head attention of q (n, a, d) over k, v (n, b, d): values and head-averaged weights (n, a, b)."""
    n, a, d = q.shape
    split = lambda z: z.reshape(n, z.shape[1], heads, d // heads).transpose(0, 2, 1, 3)
    w = _softmax(split(q) @ split(k).transpose(0, 1, 3, 2) / np.sqrt(d // heads), 3)
    return (w @ split(v)).transpose(0, 2, 1, 3).reshape(n, a, d), w.mean(axis=1)


@dataclass
class Block:
    """Cross-attention: projections with layer norm, attention, residual norm, a wide feed-forward part, residual norm, projection."""

    layers: dict
    heads: int

    @classmethod
    def fresh(cls, rng, query: int, key: int, value: int, out: int, heads: int, width: int) -> Block:
        d = heads * width
        sizes = {"q": (query, d), "k": (key, d), "v": (value, d), "iq": (d, d), "ik": (d, d), "iv": (d, d), "io": (d, d), "up": (d, 4 * d), "down": (4 * d, d), "out": (d, out)}
        return cls({name: _layer(rng, *size) for name, size in sizes.items()}, heads)

    def __call__(self, query: np.ndarray, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = self.layers
        q, k, v = _norm(_dense(p["q"], query))[:, None], _norm(_dense(p["k"], keys)), _norm(_dense(p["v"], values))
        seen, weights = attend(_dense(p["iq"], q), _dense(p["ik"], k), _dense(p["iv"], v), self.heads)
        hidden = _norm(q + _dense(p["io"], seen))
        hidden = _norm(hidden + _dense(p["down"], _gelu(_dense(p["up"], hidden))))
        return _dense(p["out"], hidden[:, 0]), weights[:, 0]


@dataclass
class Adapter:
    """The adapter's blocks, the hidden layers of its heads, and the heads' output layers, which training moves."""

    horizon: int
    blocks: dict[str, Block]
    hidden: dict[str, tuple]
    out: dict[str, tuple]

    @classmethod
    def fresh(cls, lags: int, horizon: int, seed: int = 0, heads: int = 4, width: int = 8, hidden: int = 64, gate: float = GATE_INIT) -> Adapter:
        rng = np.random.default_rng(seed)
        blocks = {
            "residual": Block.fresh(rng, lags + horizon, lags + horizon, horizon, horizon, heads, width),
            "memory": Block.fresh(rng, lags, lags, horizon, horizon, heads, width),
            "mixture": Block.fresh(rng, lags, lags, lags, lags, heads, width),
        }
        heads_in = {"residual": 2 * horizon, "memory": 2 * horizon, "mixture": lags}
        scores = np.zeros((4, horizon))
        scores[1:] = gate
        out = {name: (np.zeros((hidden, horizon)), np.zeros(horizon)) for name in ("residual", "memory")}
        return cls(horizon, blocks, {n: _layer(rng, size, hidden) for n, size in heads_in.items()}, out | {"mixture": (np.zeros((hidden, 4 * horizon)), scores.ravel())})

    def features(self, x, xs, ys, es, pred) -> dict[str, np.ndarray]:
        """What the heads' output layers read, for normalised lookbacks, neighbours (n, k, .) and forecasts."""
        own = ys - es  # the neighbours' own forecasts on the query's scale
        r, _ = self.blocks["residual"](np.concatenate([x, pred], 1), np.concatenate([xs, own], 2), es)
        m, _ = self.blocks["memory"](x, xs, ys)
        z, _ = self.blocks["mixture"](x, xs, xs)
        inputs = {"residual": np.concatenate([pred, r], 1), "memory": np.concatenate([pred, m], 1), "mixture": z}
        return {name: _gelu(_dense(self.hidden[name], v)) for name, v in inputs.items()}

    def forward(self, features: dict[str, np.ndarray], pred: np.ndarray, ctx: np.ndarray) -> dict[str, np.ndarray]:
        residual, memory = (_dense(self.out[n], features[n]) for n in ("residual", "memory"))
        weights = _softmax(_dense(self.out["mixture"], features["mixture"]).reshape(-1, 4, self.horizon), 1)
        candidates = np.stack([pred, ctx, pred + residual, pred + memory], 1)
        return {"yhat": (weights * candidates).sum(axis=1), "weights": weights, "candidates": candidates, "residual": residual, "memory": memory}

    def gradient(self, features, pred, ctx, y, beta: float, gamma: float) -> tuple[float, np.ndarray]:
        """Summed loss and gradient of the output layers over rows: forecast error, distance from the plain forecast, and both shifts' errors."""
        f, h = self.forward(features, pred, ctx), self.horizon
        yhat, miss = f["yhat"], y - pred
        slope = 2 / h * ((yhat - y) + beta * (yhat - pred))
        shifts = {n: f["weights"][:, i] * slope + 2 * gamma / h * (f[n] - miss) for i, n in ((2, "residual"), (3, "memory"))}
        shifts["mixture"] = (f["weights"] * (f["candidates"] - yhat[:, None]) * slope[:, None]).reshape(len(y), -1)
        parts = [part for n in ("residual", "memory", "mixture") for part in ((features[n].T @ shifts[n]).ravel(), shifts[n].sum(axis=0))]
        loss = ((yhat - y) ** 2 + beta * (yhat - pred) ** 2 + gamma * ((f["residual"] - miss) ** 2 + (f["memory"] - miss) ** 2)).mean(axis=1).sum()
        return float(loss), np.concatenate(parts)

    def moved(self, flat: np.ndarray) -> Adapter:
        """The adapter with its output layers replaced by numbers in the order of gradient()."""
        out, at = {}, 0
        for n in ("residual", "memory", "mixture"):
            made = []
            for old in self.out[n]:
                made.append(flat[at : at + old.size].reshape(old.shape))
                at += old.size
            out[n] = tuple(made)
        return Adapter(self.horizon, self.blocks, self.hidden, out)

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for n in ("residual", "memory", "mixture") for p in self.out[n]])


def _batch(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Arrays of a batch on each query's own scale; rows must have equally many neighbours."""
    col = lambda c: np.array(batch.column(c).to_pylist(), float)
    mu, sd = col("mu")[:, None], np.maximum(col("sd")[:, None], A.EPS)
    out = {c: (col(c) - mu) / sd for c in ("x", "pred", "pred_ctx", "y")}
    return out | {"xs": (col("xs") - mu[:, None]) / sd[:, None], "ys": (col("ys") - mu[:, None]) / sd[:, None], "es": col("es") / sd[:, None], "mu": mu, "sd": sd}


def _inputs(payload: DataFrame) -> DataFrame:
    lists = [F.col("nbrs")[c].alias(c) for c in ("xs", "ys", "es")]
    return payload.select("split", "qt", "qu", "x", "y", "mu", "sd", "pred", "pred_ctx", *lists)


def _same_k(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose rows have equally many neighbours."""
    k = np.array([len(v) for v in batch.column("ys")])
    for size in np.unique(k[k > 0]):
        yield batch.take(pa.array(np.nonzero(k == size)[0]))


def apply(payload: DataFrame, model: Adapter, name: str = "attention_adapter") -> DataFrame:
    """(split, method, qt, qu, y, sd, yhat) of the adapter; queries without neighbours have no prediction."""
    shared = payload.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _same_k(batch):
                b = _batch(part)
                f = shared.value.features(b["x"], b["xs"], b["ys"], b["es"], b["pred"])
                yhat = shared.value.forward(f, b["pred"], b["pred_ctx"])["yhat"] * b["sd"] + b["mu"]
                keys = [part.column(c) for c in ("split", "qt", "qu", "y", "sd")]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(list(yhat), pa.list_(pa.float64()))], ["split", "qt", "qu", "y", "sd", "yhat"])

    out = _inputs(payload).mapInArrow(run, "split string, qt long, qu long, y array<double>, sd double, yhat array<double>")
    return out.select("split", F.lit(name).alias("method"), "qt", "qu", "y", "sd", "yhat")


FEATURES = ("residual", "memory", "mixture", "pred", "pred_ctx", "y")


def fit(payload: DataFrame, model: Adapter, rounds: int = 100, rate: float = 0.01, decay: float = 1e-4, clip: float = 1.0, beta: float = BETA, gamma: float = GAMMA) -> Adapter:
    """The adapter after Adam rounds on all rows; an error if there are none."""
    shared = payload.sparkSession.sparkContext.broadcast(model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _same_k(batch):
                b = _batch(part)
                made = shared.value.features(b["x"], b["xs"], b["ys"], b["es"], b["pred"]) | {c: b[c] for c in ("pred", "pred_ctx", "y")}
                yield pa.RecordBatch.from_arrays([pa.array(list(made[c]), pa.list_(pa.float64())) for c in FEATURES], list(FEATURES))

    rows = _inputs(payload).mapInArrow(features, ", ".join(f"{c} array<double>" for c in FEATURES)).cache()
    now = model.flat()
    first, second = np.zeros_like(now), np.zeros_like(now)
    for step in range(1, rounds + 1):
        n, _, slope = _summed(rows, model.moved(now), beta, gamma)
        slope = slope / n
        slope *= min(1.0, clip / max(float(np.linalg.norm(slope)), 1e-12))
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        now = now - rate * (first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8) + decay * now)
    rows.unpersist()
    return model.moved(now)


def _summed(rows: DataFrame, model: Adapter, beta: float, gamma: float) -> tuple[int, float, np.ndarray]:
    """Rows, loss and gradient over all rows."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss, total = 0, 0.0, np.zeros_like(shared.value.flat())
        for batch in batches:
            f = {c: np.array(batch.column(c).to_pylist(), float) for c in FEATURES}
            if batch.num_rows:
                own, slope = shared.value.gradient(f, f["pred"], f["pred_ctx"], f["y"], beta, gamma)
                n, loss, total = n + batch.num_rows, loss + own, total + slope
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.array([total], pa.list_(pa.float64()))], ["n", "loss", "g"])

    def meet(table: pa.Table) -> pa.Table:
        total = np.sum(np.array(table.column("g").to_pylist(), float), axis=0)
        return pa.table({"n": [sum(table.column("n").to_pylist())], "loss": [sum(table.column("loss").to_pylist())], "g": pa.array([total], pa.list_(pa.float64()))})

    kinds = "n long, loss double, g array<double>"
    partial = rows.mapInArrow(part, kinds).withColumn("group", F.spark_partition_id() % GROUPS)
    found = partial.groupBy("group").applyInArrow(lambda t: meet(t.drop_columns(["group"])), kinds).collect()  # at most GROUPS rows
    n = sum(r["n"] for r in found)
    if not n:
        raise ValueError("no rows to fit on")
    return n, sum(r["loss"] for r in found), np.sum([r["g"] for r in found], axis=0)


@dataclass
class PatchTransformer:
    """Patches of an instance-normalised lookback through encoder layers to a forecast."""

    lags: int
    horizon: int
    length: int
    step: int
    heads: int
    layers: list[dict]
    embedding: tuple
    places: np.ndarray
    head: tuple

    @classmethod
    def fresh(cls, lags: int, horizon: int, seed: int = 0, length: int = 16, step: int = 8, width: int = 128, heads: int = 16, depth: int = 3, wide: int = 256) -> PatchTransformer:
        if lags < length or width % heads:
            raise ValueError("a lookback holds a patch, and heads divide the width")
        rng = np.random.default_rng(seed)
        count = (lags - length) // step + 2  # the end is padded by one step
        sizes = {"q": (width, width), "k": (width, width), "v": (width, width), "o": (width, width), "up": (width, wide), "down": (wide, width)}
        layers = [{n: _layer(rng, *size) for n, size in sizes.items()} for _ in range(depth)]
        return cls(lags, horizon, length, step, heads, layers, _layer(rng, length, width), rng.uniform(-0.02, 0.02, (count, width)), _layer(rng, count * width, horizon))

    def encode(self, x: np.ndarray) -> np.ndarray:
        """(n, patches, width) of normalised lookbacks."""
        if x.ndim != 2 or x.shape[1] != self.lags:
            raise ValueError(f"lookbacks have {self.lags} values")
        padded = np.concatenate([x, np.repeat(x[:, -1:], self.step, axis=1)], axis=1)
        z = np.lib.stride_tricks.sliding_window_view(padded, self.length, axis=1)[:, :: self.step]
        z = _dense(self.embedding, z) + self.places
        for p in self.layers:
            seen, _ = attend(_dense(p["q"], z), _dense(p["k"], z), _dense(p["v"], z), self.heads)
            z = _norm(z + _dense(p["o"], seen))
            z = _norm(z + _dense(p["down"], _gelu(_dense(p["up"], z))))
        return z

    def forecast(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        mu, sd = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True) + TINY
        return _dense(self.head, self.encode((x - mu) / sd).reshape(len(x), -1)) * sd + mu

    def embed(self, x: np.ndarray) -> np.ndarray:
        """The mean over the patches, for windows.embed()."""
        x = np.asarray(x, float)
        return self.encode((x - x.mean(axis=1, keepdims=True)) / (x.std(axis=1, keepdims=True) + TINY)).mean(axis=1)
