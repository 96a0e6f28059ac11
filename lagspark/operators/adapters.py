"""Output-space adapters: neighbour averages and ridge mixes of a prediction table.

Fits need one pass: the Gram matrices of the features and their products with the targets
are sums by step, which all trainable methods share in one aggregation. The systems are then
solved row by row in Catalyst, so there may be as many groups of fits as the data has (a fit
for each series, say), and coefficients are a table that predictions are joined with.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagspark.functions import arrays as A
from lagspark.functions.linear import solve_ridge

TRAINABLE = ("horizon_mix_scalar", "residual_mix_scalar", "residual_ridge_shared", "residual_ridge_horizon", "horizon_ridge_shared", "full_ridge_horizon")
METHODS = ("vanilla", "context_forecast", "horizon_knn_weighted", "horizon_knn_mean", "residual_knn_weighted", *TRAINABLE)


def distances() -> Column:
    return F.transform("nbrs", lambda n: n["distance"])


def weights() -> Column:
    return A.distance_weights(distances())


def neighbour_frame(payload: DataFrame) -> DataFrame:
    """payload with w, the weighted horizon yw, the weighted residual ew and the mean horizon ym."""
    ys, es = F.transform("nbrs", lambda n: n["ys"]), F.transform("nbrs", lambda n: n["es"])
    out = payload.withColumn("w", weights())
    even = F.transform("nbrs", lambda n: F.lit(1.0) / F.size("nbrs"))
    return out.withColumns({"yw": A.weighted("w", ys), "ew": A.weighted("w", es), "ym": A.weighted(even, ys)})


def gram(rows: DataFrame, p: int, by: list[str] | None = None) -> DataFrame:
    """n, xx (p x p) and xy (p): sums of products of rows (f array of p, target), in one shuffle."""
    f = F.col("f")
    sums = [F.sum(f[i] * f[j]).alias(f"xx_{i}_{j}") for i in range(p) for j in range(i, p)] + [F.sum(f[i] * F.col("target")).alias(f"xy_{i}") for i in range(p)]
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), *sums)
    xx = F.array(*[F.array(*[F.col(f"xx_{min(i, j)}_{max(i, j)}") for j in range(p)]) for i in range(p)])
    return out.select(*(by or []), "n", xx.alias("xx"), F.array(*[F.col(f"xy_{i}") for i in range(p)]).alias("xy"))


def ridge(rows: DataFrame, p: int, l2: float, by: list[str] | None = None) -> DataFrame:
    """(by, beta): ridge coefficients of each group of rows."""
    return solve_ridge(gram(rows, p, by), l2).select(*(by or []), "beta")


def step_rows(frame: DataFrame, features: Column, target: Column) -> DataFrame:
    """(h, f, target) a query and step; features is an array over steps of feature arrays."""
    rows = frame.select(F.posexplode(F.arrays_zip(features.alias("f"), target.alias("target"))).alias("h", "z"))
    return rows.select("h", F.col("z.f").alias("f"), F.col("z.target").alias("target"))


def _over_steps(*columns: Column) -> Column:
    """Step-wise feature arrays of forecast arrays."""
    zipped = F.arrays_zip(*[c.alias(str(i)) for i, c in enumerate(columns)])
    return F.transform(zipped, lambda z: F.array(*[z[str(i)] for i in range(len(columns))]))


def _neighbours(name: str, k: int) -> list[Column]:
    return [F.col("nbrs")[i][name] for i in range(k)]


def _plans(k: int) -> dict[str, tuple[list[str], str, bool]]:
    """Features, target and whether each step has coefficients of its own, by trainable method."""
    ys, es = [f"ys{i}" for i in range(k)], [f"es{i}" for i in range(k)]
    return {
        "horizon_mix_scalar": (["shift"], "error", False),
        "residual_mix_scalar": (["ew"], "error", False),
        "residual_ridge_shared": (es, "error", False),
        "horizon_ridge_shared": (["pred", *ys], "y", False),
        "residual_ridge_horizon": (es, "error", True),
        "full_ridge_horizon": (["pred", *ys, "pred_ctx"], "y", True),
    }


def step_products(payload: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """n and the sums of products that the trainable methods need, by group and step h: one aggregation for all of them."""
    frame = neighbour_frame(payload)
    error = F.zip_with("y", "pred", lambda a, b: a - b)
    shift = F.zip_with("yw", "pred", lambda a, b: a - b)
    columns = {"pred": F.col("pred"), "pred_ctx": F.col("pred_ctx"), "y": F.col("y"), "ew": F.col("ew"), "error": error, "shift": shift}
    columns |= {f"{n}{i}": c for n in ("ys", "es") for i, c in enumerate(_neighbours(n, k))}
    steps = frame.select(*by, F.posexplode(F.arrays_zip(*[c.alias(n) for n, c in columns.items()])).alias("h", "z")).select(*by, "h", "z.*")
    return steps.groupBy(*by, "h").agg(F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for a, b in sorted(_pairs(k))])


def _pairs(k: int) -> set[tuple[str, str]]:
    """The products that some trainable method needs."""
    pairs = {tuple(sorted((a, b))) for features, _, _ in _plans(k).values() for a in features for b in features}
    return pairs | {tuple(sorted((a, target))) for features, target, _ in _plans(k).values() for a in features}


def fit_table(payload: DataFrame, k: int, l2: float = 1e-3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, method, h, beta): coefficients of the trainable adapters on the rows given (k neighbours each).

    h is the step, -1 for methods that share coefficients over all steps. Lazy, as any table.
    """
    products = step_products(payload, k, by)
    sums = [c for c in products.columns if c not in (*by, "h")]
    # Each step's sums count for the step and for the whole.
    both = products.withColumn("h", F.explode(F.array(F.col("h"), F.lit(-1))))
    both = both.groupBy(*by, "h").agg(*[F.sum(F.col(f"`{c}`")).alias(c) for c in sums])
    cell = lambda a, b: F.col(f"`{'*'.join(sorted((a, b)))}`")

    def system(name: str, features: list[str], target: str) -> Column:
        xx = F.array(*[F.array(*[cell(a, b) for b in features]) for a in features])
        return F.struct(F.lit(name).alias("method"), xx.alias("xx"), F.array(*[cell(a, target) for a in features]).alias("xy"))

    plans = {per: F.array(*[system(n, f, t) for n, (f, t, p) in _plans(k).items() if p == per]) for per in (True, False)}
    each = both.select(*by, "h", "n", F.explode(F.when(F.col("h") < 0, plans[False]).otherwise(plans[True])).alias("s")).select(*by, "h", "n", "s.*")
    found = solve_ridge(each, l2)
    clipped = F.transform("beta", lambda b: F.least(F.greatest(b, F.lit(0.0)), F.lit(1.0)))
    return found.select(*by, "method", "h", F.when(F.col("method").endswith("mix_scalar"), clipped).otherwise(F.col("beta")).alias("beta"))


def fit(payload: DataFrame, k: int, l2: float = 1e-3) -> dict[str, np.ndarray]:
    """The coefficients of fit_table() as arrays: a few dozen numbers a step."""
    rows = fit_table(payload, k, l2).orderBy("method", "h").collect()
    if not rows:
        raise ValueError("no rows to fit on")
    found = {m: np.array([r["beta"] for r in rows if r["method"] == m]) for m in TRAINABLE}
    return {m: found[m] if per_step else found[m][0] for m, (_, _, per_step) in _plans(k).items()}


def nested(models: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, fitted): one row a group, a map from each method to its coefficients by step."""
    steps = models.groupBy(*by, "method").agg(F.array_sort(F.collect_list(F.struct("h", "beta"))).alias("s"))
    pairs = F.collect_list(F.struct("method", F.transform("s", lambda x: x["beta"]).alias("steps")))
    return steps.groupBy(*by).agg(F.map_from_entries(pairs).alias("fitted"))


def predict(payload: DataFrame, models: DataFrame | None, k: int, suffix: str = "", by: tuple[str, ...] = ()) -> DataFrame:
    """(split, method, qt, qu, y, sd, yhat) of the methods; with a suffix only the trainable ones.

    models is a table of fit_table(), fresh or read back, of the groups by (rows of a group
    without a model get no prediction). Without models only the methods without a fit.
    """
    frame = neighbour_frame(payload)
    add = lambda base, extra: F.zip_with(base, extra, lambda a, b: a + b)
    methods: dict[str, Column] = {
        "vanilla": F.col("pred"),
        "context_forecast": F.col("pred_ctx"),
        "horizon_knn_weighted": F.col("yw"),
        "horizon_knn_mean": F.col("ym"),
        "residual_knn_weighted": add("pred", "ew"),
    }
    if models is not None:
        one = nested(models, by)
        # A row a group; one row in all without groups.
        frame = frame.join(one, list(by)) if by else frame.join(F.broadcast(one), F.lit(True))
        residual, horizon = _over_steps(*_neighbours("es", k)), _over_steps(F.col("pred"), *_neighbours("ys", k))
        everything = _over_steps(F.col("pred"), *_neighbours("ys", k), F.col("pred_ctx"))
        fitted = lambda name: F.col("fitted")[name]
        scalar = lambda name: fitted(name)[0][0]
        shared = lambda features, name: F.transform(features, lambda f: A.dot(f, fitted(name)[0]))
        per_step = lambda features, name: F.zip_with(features, fitted(name), lambda f, c: A.dot(f, c))
        methods |= {
            "horizon_mix_scalar": F.zip_with("pred", "yw", lambda a, b: a + (b - a) * scalar("horizon_mix_scalar")),
            "residual_mix_scalar": F.zip_with("pred", "ew", lambda a, b: a + b * scalar("residual_mix_scalar")),
            "residual_ridge_shared": add("pred", shared(residual, "residual_ridge_shared")),
            "residual_ridge_horizon": add("pred", per_step(residual, "residual_ridge_horizon")),
            "horizon_ridge_shared": shared(horizon, "horizon_ridge_shared"),
            "full_ridge_horizon": per_step(everything, "full_ridge_horizon"),
        }
    if suffix:
        methods = {f"{m}{suffix}": e for m, e in methods.items() if m in TRAINABLE}
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), e.alias("yhat")) for m, e in methods.items()])
    rows = frame.select("split", "qt", "qu", "y", "sd", F.explode(pairs).alias("m"))
    return rows.select("split", F.col("m.method").alias("method"), "qt", "qu", "y", "sd", F.col("m.yhat").alias("yhat"))


def run(payload: DataFrame, k: int, l2: float = 1e-3, fit_on_eval: bool = False) -> DataFrame:
    """Predictions of all methods for all splits, fitted on train; with eval-fitted bounds if asked for."""
    out = predict(payload, fit_table(payload.where("split = 'train'"), k, l2), k)
    if fit_on_eval:
        last = payload.where("split = 'eval'")
        out = out.unionByName(predict(last, fit_table(last, k, l2), k, suffix="_eval_fit"))
    return out
