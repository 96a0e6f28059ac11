"""Gates between the plain and the context forecast, their bounds and diagnostics."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagspark.functions import arrays as A
from lagspark.sources.tables import cut

from . import boosting
from .adapters import neighbour_frame

OBJECTIVES = ("regressor", "classifier")
#: Ranges of scores that running sums are cut into.
RANGES = 64
#: Gates that are fitted at the same time.
JOBS = 8
# Fixed names and order of the common features.
COMMON = (
    "weighted_minus_pred_mean", "weighted_residual_mean", "query_mean", "query_std", "neighbour_mean_mean", "neighbour_mean_std",
    "neighbour_std_mean", "neighbour_std_std", "same_user_ratio", "age_mean", "weight_std", "weight_max", "distance_mean",
)
SCALAR = ("context_shift_mean", "context_shift_std", *COMMON)


def gate_features(payload: DataFrame) -> DataFrame:
    """(split, qt, qu, shift, the 15 scalar features, target, target_steps): shift is the context forecast minus the plain one."""
    f = neighbour_frame(payload)
    mu, sd = F.transform("nbrs", lambda n: n["mu"]), F.transform("nbrs", lambda n: n["sd"])
    shift = F.zip_with("pred_ctx", "pred", lambda a, b: a - b)
    columns = {
        "context_shift_mean": A.mean(shift),
        "context_shift_std": A.std(shift),
        "weighted_minus_pred_mean": A.mean(F.zip_with("yw", "pred", lambda a, b: a - b)),
        "weighted_residual_mean": A.mean("ew"),
        "query_mean": F.col("mu"),
        "query_std": F.col("sd"),
        "neighbour_mean_mean": A.mean(mu),
        "neighbour_mean_std": A.std(mu),
        "neighbour_std_mean": A.mean(sd),
        "neighbour_std_std": A.std(sd),
        "same_user_ratio": A.mean(F.transform("nbrs", lambda n: (n["nu"] == F.col("qu")).cast("double"))),
        "age_mean": A.mean(F.transform("nbrs", lambda n: (F.col("qt") - n["nt"]).cast("double"))),
        "weight_std": A.std("w"),
        "weight_max": F.array_max("w"),
        "distance_mean": A.mean(F.transform("nbrs", lambda n: n["distance"])),
    }
    return f.select("split", "qt", "qu", shift.alias("shift"), *(c.alias(n) for n, c in columns.items()), A.mean(gains()).alias("target"), gains().alias("target_steps"))


def gains() -> Column:
    """Squared error of the plain forecast minus that of the context forecast, by step."""
    zipped = F.arrays_zip(F.col("pred").alias("p"), F.col("pred_ctx").alias("c"), F.col("y").alias("y"))
    return F.transform(zipped, lambda z: (z["p"] - z["y"]) * (z["p"] - z["y"]) - (z["c"] - z["y"]) * (z["c"] - z["y"]))


class Gate:
    """A fitted score; the context forecast is chosen where it is positive."""

    def __init__(self, model: boosting.Trees | None = None, constant: float | None = None, features: list[str] | None = None, classifier: bool = False):
        self.model, self.constant, self.features, self.classifier = model, constant, list(features or []), classifier

    def score(self, rows: DataFrame) -> DataFrame:
        out = score_gates(rows, {"gate": self}, [c for c in rows.columns if c != "score"])
        return out.withColumn("score", F.col("scores")["gate"]).drop("scores")


def fit_gate(rows: DataFrame, features: list[str], objective: str = "regressor", target: str = "target", iterations: int = 300, rate: float = 0.03, depth: int = 4) -> Gate:
    """A boosted gate on the signed gain; a constant one if the target does not vary. The fit is one task."""
    if objective not in OBJECTIVES:
        raise ValueError(f"unknown objective {objective}")
    plan = {"name": "gate", "classifier": objective == "classifier", "target": F.col(target), "features": F.array(*features)}
    found = boosting.fit_all(rows, [plan], F.struct(*features), iterations, rate, depth)["gate"]
    constant, model = (found, None) if isinstance(found, float) else (None, found)
    return Gate(model, constant, features, objective == "classifier")


def fit_step_gates(rows: DataFrame, features: list[str], horizon: int, objective: str, **how) -> list[Gate]:
    """One gate a step, its target the gain at that step."""
    return _fit_side_by_side(rows, [(features, objective, h) for h in range(horizon)], **how)


def _fit_side_by_side(rows: DataFrame, plans: list[tuple[list[str], str, int | None]], **how) -> list[Gate]:
    """Gates of (features, objective, step or None for the mean gain); their jobs run at the same time."""
    by_step = rows.withColumns({f"__t{h}": F.col("target_steps")[h] for _, _, h in plans if h is not None})

    def one(plan):
        features, objective, h = plan
        return fit_gate(by_step, features, objective, "target" if h is None else f"__t{h}", **how)

    with ThreadPoolExecutor(JOBS) as pool:
        return list(pool.map(one, plans))


def score_gates(rows: DataFrame, gates: dict[str, Gate], keys: list[str]) -> DataFrame:
    """keys and scores, a map from each gate's name to its score, in one pass."""
    plans = [{"name": n, "classifier": g.classifier, "features": F.array(*g.features).cast("array<double>")} for n, g in gates.items()]
    fitted = {n: g.model if g.model is not None else float(g.constant) for n, g in gates.items()}
    return boosting.score_all(rows, fitted, plans, keys)


def with_shift_columns(rows: DataFrame, horizon: int) -> tuple[DataFrame, list[str]]:
    """The horizon features: the shift at every step and the 13 common ones."""
    names = [f"shift_{h}" for h in range(horizon)]
    return rows.withColumns({n: F.col("shift")[h] for h, n in enumerate(names)}), [*names, *COMMON]


def select_by(payload: DataFrame, scores: DataFrame, name: str) -> DataFrame:
    """Predictions that take the context forecast where a query's score is positive."""
    joined = payload.join(scores.select("split", "qt", "qu", "score"), ["split", "qt", "qu"])
    return _prediction(joined, name, F.when(F.col("score") > 0, F.col("pred_ctx")).otherwise(F.col("pred")))


def _prediction(rows: DataFrame, name: str, yhat: Column) -> DataFrame:
    return rows.select("split", F.lit(name).alias("method"), "qt", "qu", "y", "sd", yhat.alias("yhat"))


def bayes_gates(payload: DataFrame, fit_split: str = "oracle") -> DataFrame:
    """Gates without features: the context forecast iff it was better on average, over all steps or at each."""
    steps = payload.where(F.col("split") == fit_split).select(F.posexplode(gains()).alias("h", "g"))
    by_step = steps.groupBy("h").agg(F.avg("g").alias("g"), F.sum("g").alias("s"), F.count("g").alias("n"))
    table = by_step.agg(F.array_sort(F.collect_list(F.struct("h", "g"))).alias("by_h"), (F.sum("s") / F.sum("n")).alias("all"))
    rows = payload.join(F.broadcast(table), F.lit(True))  # one row with a number a step
    scalar = F.when(F.col("all") > 0, F.col("pred_ctx")).otherwise(F.col("pred"))
    step = A.choose(F.transform("by_h", lambda x: x["g"] > 0), "pred_ctx", "pred")
    return _prediction(rows, "bayes_context_scalar", scalar).unionByName(_prediction(rows, "bayes_context_horizon", step))


def oracles(payload: DataFrame) -> DataFrame:
    """Target-aware bounds: the context forecast iff its loss is strictly smaller, by window or by step."""
    scalar = F.when(A.mse("pred_ctx", "y") < A.mse("pred", "y"), F.col("pred_ctx")).otherwise(F.col("pred"))
    step = A.choose(F.transform(gains(), lambda g: g > 0), "pred_ctx", "pred")
    return _prediction(payload, "oracle_context_scalar", scalar).unionByName(_prediction(payload, "oracle_context_horizon", step))


def run(payload: DataFrame, horizon: int, iterations: int = 300, rate: float = 0.03, depth: int = 4, per_step: bool = True) -> DataFrame:
    """Predictions of all gates: boosted on the oracle split by two objectives, Bayes and oracle ones."""
    out = bayes_gates(payload).unionByName(oracles(payload))
    wide, gates = _all_gates(payload, horizon, per_step, iterations=iterations, rate=rate, depth=depth)
    scored = score_gates(wide, gates, ["split", "qt", "qu"])
    joined = payload.join(scored, ["split", "qt", "qu"])
    for o in OBJECTIVES:
        take = F.col("scores")[f"{o}_scalar"] > 0
        out = out.unionByName(_prediction(joined, f"boosted_context_{o}_scalar", F.when(take, F.col("pred_ctx")).otherwise(F.col("pred"))))
        if per_step:
            use = F.array(*[F.col("scores")[f"{o}_{h}"] > 0 for h in range(horizon)])
            out = out.unionByName(_prediction(joined.withColumn("use", use), f"boosted_context_{o}_horizon", A.choose("use", "pred_ctx", "pred")))
    return out


def _all_gates(payload: DataFrame, horizon: int, per_step: bool, **how) -> tuple[DataFrame, dict[str, Gate]]:
    """The features of all rows, and the gates fitted on the oracle split by name: objective_scalar and objective_step."""
    wide, names = with_shift_columns(gate_features(payload), horizon)
    plans = [(list(SCALAR), o, None) for o in OBJECTIVES]
    plans += [(names, o, h) for o in OBJECTIVES for h in range(horizon)] if per_step else []
    fit_on = wide.where("split = 'oracle'").cache()
    fitted = _fit_side_by_side(fit_on, plans, **({"iterations": 300, "rate": 0.03} | how))
    fit_on.unpersist()
    return wide, {f"{o}_{'scalar' if h is None else h}": g for (_, o, h), g in zip(plans, fitted)}


def gate_scores(payload: DataFrame, horizon: int, **how) -> DataFrame:
    """(split, qt, qu, gate, h, score, target) of the boosted gates, h -1 for the scalar ones."""
    wide, gates = _all_gates(payload, horizon, True, **how)
    scored = score_gates(wide, gates, ["split", "qt", "qu", "target", "target_steps"])
    rows = scored.select("split", "qt", "qu", "target", "target_steps", F.explode("scores").alias("name", "score"))
    last = F.substring_index("name", "_", -1)
    h = F.when(last == "scalar", -1).otherwise(last.try_cast("int"))
    target = F.when(h < 0, F.col("target")).otherwise(F.get("target_steps", h))
    return rows.select("split", "qt", "qu", F.substring_index("name", "_", 1).alias("gate"), h.alias("h"), "score", target.alias("target"))


def select_score(scores: DataFrame, gate: str, step: int | str | None = None) -> DataFrame:
    """(split, qt, qu, h, score, target) of one gate: its scalar form (None), all its steps ("all"), or one step.

    Older names are understood too: the objective with a shape behind it, as in regressor_horizon.
    """
    name, _, shape = gate.partition("_")
    if name not in OBJECTIVES or shape not in ("", "scalar", "horizon"):
        raise ValueError(f"unknown gate {gate}")
    step = "all" if shape == "horizon" and step is None else step
    rows = scores.where(F.col("gate") == name)
    rows = rows.where("h < 0") if step is None else rows.where("h >= 0") if step == "all" else rows.where(F.col("h") == int(step))
    return rows.select("split", "qt", "qu", "h", "score", "target")


def _summed(scores: DataFrame, score: str, target: str) -> DataFrame:
    finite = F.col(score).isNotNull() & F.col(target).isNotNull() & ~F.isnan(score) & ~F.isnan(target)
    rows = scores.where(finite).groupBy(F.col(score).cast("double").alias("score"))
    return rows.agg(F.count_if(F.col(target) > 0).alias("p"), F.count_if(F.col(target) <= 0).alias("m"))


def roc_curve(scores: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """(score, tp, fp, tpr, fpr) at each distinct score, falling; target > 0 is the positive class.

    Rows are first summed by score. Running sums are made within RANGES ranges of scores and
    start from the sums of the ranges above, so no task sorts all scores.
    """
    return _curve(cut(_summed(scores, score, target)))


def _curve(rows: DataFrame) -> DataFrame:
    """The curve of rows summed by score."""
    # One small job over the sums: where the ranges end.
    points = rows.agg(F.percentile_approx("score", [i / RANGES for i in range(1, RANGES)], 1000).alias("p")).first()["p"] or []
    place = F.size(F.filter(F.array(*[F.lit(float(x)) for x in sorted(set(points))]).cast("array<double>"), lambda x: x >= F.col("score")))
    rows = rows.withColumn("range", place)
    # At most RANGES rows, one partition.
    above = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    sums = rows.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("m").alias("rm"))
    sums = sums.select(
        "range", *(F.coalesce(F.sum(c).over(above), F.lit(0)).alias(n) for c, n in (("rp", "p0"), ("rm", "m0"))), F.sum("rp").over(everything).alias("all_p"), F.sum("rm").over(everything).alias("all_m")
    )
    down = Window.partitionBy("range").orderBy(F.desc("score"))
    out = rows.join(F.broadcast(sums), "range").withColumns({"tp": F.sum("p").over(down) + F.col("p0"), "fp": F.sum("m").over(down) + F.col("m0")})
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select("score", "tp", "fp", rate("tp", "all_p").alias("tpr"), rate("fp", "all_m").alias("fpr"), "p", "m", "all_p", "all_m")


def roc_auc(scores: DataFrame, score: str = "score", target: str = "target") -> DataFrame:
    """(auc, accuracy, n) over the rows with numbers: area by trapezoids, and the share whose score's sign is right; auc is null for one class.

    The scores are read once: both come from their sums by score.
    """
    sums = cut(_summed(scores, score, target))
    curve = _curve(sums)
    # A trapezoid's left edge is where the curve stood before the score's own rows.
    area = F.col("m") / F.col("all_m") * (2 * F.col("tp") - F.col("p")) / F.col("all_p") / 2
    both = (F.col("all_p") > 0) & (F.col("all_m") > 0)
    auc = curve.agg(F.sum(F.when(both, area)).alias("auc"))
    right = F.sum(F.when(F.col("score") > 0, F.col("p")).otherwise(F.col("m")))
    right = sums.agg(F.try_divide(right, F.sum(F.col("p") + F.col("m"))).alias("accuracy"), F.coalesce(F.sum(F.col("p") + F.col("m")), F.lit(0)).alias("n"))
    return auc.join(right, F.lit(True))  # one row each


def threshold_sweep(payload: DataFrame, scores: DataFrame, points: int = 101) -> DataFrame:
    """(i, threshold, right_pct, nmse) for equally spaced thresholds: decisions that are right, and the loss they lead to.

    Each row counts at the lowest thresholds that its score passes, so rows are summed by
    that number once instead of being joined with every threshold.
    """
    s = scores.select("split", "qt", "qu", "score")
    span = s.agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    rows = payload.join(s, ["split", "qt", "qu"]).join(F.broadcast(span), F.lit(True))
    rows = rows.select(
        "score", "lo", "hi", A.nmse("pred", "y", "sd").alias("base"), A.nmse("pred_ctx", "y", "sd").alias("ctx"), (A.mse("pred_ctx", "y") < A.mse("pred", "y")).cast("int").alias("better")
    )
    step = (F.col("hi") - F.col("lo")) / (points - 1)
    # Thresholds strictly below the score: that many sweeps take the context forecast.
    below = F.aggregate(F.sequence(F.lit(0), F.lit(points - 1)), F.lit(0), lambda n, i: n + F.when(F.col("lo") + i * step < F.col("score"), 1).otherwise(0))
    by = rows.groupBy(below.alias("below")).agg(
        F.count("*").alias("n"), F.sum("base").alias("base"), F.sum("ctx").alias("ctx"), F.sum("better").alias("better"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )
    each = by.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    takes = F.col("below") > F.col("i")
    out = each.groupBy("i").agg(
        F.first(F.col("lo") + F.col("i") * step).alias("threshold"),
        (F.sum(F.when(takes, F.col("better")).otherwise(F.col("n") - F.col("better"))) / F.sum("n") * 100).alias("right_pct"),
        (F.sum(F.when(takes, F.col("ctx")).otherwise(F.col("base"))) / F.sum("n")).alias("nmse"),
    )
    return out.withColumn("i", F.col("i").cast("long"))


def gate_summary(payload: DataFrame, predictions: DataFrame) -> DataFrame:
    """(split, method, right_pct, nmse) of gates; a decision is read off the nearer forecast, ties don't count."""
    joined = predictions.select("split", "method", "qt", "qu", "yhat").join(payload.select("split", "qt", "qu", "y", "sd", "pred", "pred_ctx"), ["split", "qt", "qu"])
    ctx, base = A.mse("pred_ctx", "y"), A.mse("pred", "y")
    took = A.squared_distance("yhat", "pred_ctx") < A.squared_distance("yhat", "pred")
    right = F.when(F.abs(ctx - base) > 1e-12, ((ctx < base) == took).cast("double"))
    return joined.groupBy("split", "method").agg((F.avg(right) * 100).alias("right_pct"), F.avg(A.nmse("yhat", "y", "sd")).alias("nmse"))
