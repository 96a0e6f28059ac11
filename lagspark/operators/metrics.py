"""Losses, their summaries, and the feature table of a prediction table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagspark.functions import arrays as A
from lagspark.sources.tables import cut


def window_losses(payload: DataFrame, pred: str = "pred") -> DataFrame:
    """(split, qt, qu, mse, mae, nmse) of each query's forecast."""
    return payload.select(
        "split", "qt", "qu", A.mse(pred, "y").alias("mse"), A.mae(pred, "y").alias("mae"), A.nmse(pred, "y", "sd").alias("nmse")
    )


def loss_summary(losses: DataFrame) -> DataFrame:
    """(split, metric, mean, std, w10_user_mean): the last is the mean over the worst tenth of the series."""
    long = losses.unpivot(["split", "qu"], ["mse", "mae", "nmse"], "metric", "value")
    all_ = long.groupBy("split", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    users = long.groupBy("split", "metric", "qu").agg(F.avg("value").alias("v"))
    group = Window.partitionBy("split", "metric")
    worst = users.withColumns({"r": F.row_number().over(group.orderBy(F.desc("v"), "qu")), "n": F.count("*").over(group)})
    worst = worst.where(F.col("r") <= F.greatest(F.lit(1), F.ceil(F.col("n") * F.lit(0.1))))
    return all_.join(worst.groupBy("split", "metric").agg(F.avg("v").alias("w10_user_mean")), ["split", "metric"])


def user_losses(losses: DataFrame) -> DataFrame:
    """nmse mean and sample standard deviation of each series."""
    return losses.groupBy("split", "qu").agg(F.avg("nmse").alias("nmse_mean"), F.stddev_samp("nmse").alias("nmse_std"))


def horizon_profile(payload: DataFrame, pred: str = "pred") -> DataFrame:
    """(split, h, mse): squared error at each step, averaged over the queries."""
    steps = payload.select("split", F.posexplode(F.zip_with(pred, "y", lambda a, b: (a - b) * (a - b))).alias("h", "se"))
    return steps.groupBy("split", F.col("h").cast("long").alias("h")).agg(F.avg("se").alias("mse"))


def feature_table(payload: DataFrame) -> DataFrame:
    """One row a query with its losses, neighbour statistics and differences."""
    d = F.transform("nbrs", lambda n: n["distance"])
    age = F.transform("nbrs", lambda n: (F.col("qt") - n["nt"]).cast("double"))
    mu, sd = F.transform("nbrs", lambda n: n["mu"]), F.transform("nbrs", lambda n: n["sd"])
    same = F.transform("nbrs", lambda n: (n["nu"] == F.col("qu")).cast("double"))
    base, ctx = A.mse("pred", "y"), A.mse("pred_ctx", "y")
    out = payload.withColumns({"base_loss": base, "context_loss": ctx})
    return out.select(
        "split", "qt", "qu", "base_loss", "context_loss",
        F.least("base_loss", "context_loss").alias("oracle_loss"),
        (F.col("context_loss") < F.col("base_loss")).alias("context_better"),
        ((F.col("base_loss") - F.col("context_loss")) / F.greatest("base_loss", F.lit(1e-8)) * 100).alias("improvement_pct"),
        A.mse("pred_ctx", "pred").alias("forecast_disagreement"),
        A.mean(d).alias("distance_mean"), A.std(d).alias("distance_std"),
        F.size("nbrs").cast("long").alias("neighbours"),
        A.mean(same).alias("same_user_fraction"), A.mean(age).alias("age_mean"), A.std(age).alias("age_std"),
        F.col("mu").alias("query_mean"), F.col("sd").alias("query_std"),
        A.mean(mu).alias("neighbour_mean_mean"), A.std(mu).alias("neighbour_mean_std"),
        A.mean(sd).alias("neighbour_std_mean"), A.std(sd).alias("neighbour_std_std"),
        (A.mean(mu) - F.col("mu")).alias("mean_difference"), (A.mean(sd) - F.col("sd")).alias("std_difference"),
    )


def quantiles(rows: DataFrame, by: list[str], value: str, points: list[float], buckets: int = 1024) -> DataFrame:
    """(by, i, quantile): exact quantiles of each group's finite values, between ranks by a straight line.

    A selection by refined histograms: each pass counts, in buckets between two values, those
    rows that may still hold a wanted rank, and goes on with the bucket that does, from its
    least to its greatest value. Buckets are equal in turn by value, by the logarithm of the
    way from the lower end and by that from the upper one, so that values spread over many
    orders of size take few passes too. Counts are combined before they are shuffled, and no task
    holds a group's values. Each pass reads rows again, so they should be a stored table.
    """
    x = F.col(value).cast("double")
    v = rows.select(F.struct(*by).alias("k"), x.alias("v")).where(F.coalesce(~F.isnan("v") & (F.abs("v") < F.lit(float("inf"))), F.lit(False)))
    spans = cut(v.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")))
    wanted = spans.select("k", "n", F.posexplode(F.array(*[F.lit(float(q)) for q in points])).alias("i", "q"))
    wanted = wanted.select("k", "i", (F.col("q") * (F.col("n") - 1)).alias("at"))
    ranks = wanted.select("k", F.explode(F.array(F.floor("at"), F.ceil("at"))).alias("rank")).distinct()
    state = cut(ranks.join(spans, "k").select("k", "rank", "lo", "hi", F.lit(0).cast("long").alias("below")))
    turn = 0
    while not (still := state.where("lo < hi")).isEmpty():
        inside = v.join(still.select("k", "lo", "hi").distinct(), "k").where("v >= lo AND v <= hi")
        share = F.try_divide(F.col("v") / 2 - F.col("lo") / 2, F.col("hi") / 2 - F.col("lo") / 2)
        octaves = lambda r: F.when(r > 0, F.greatest(F.log2(r) / 1100 + 1, F.lit(0.0))).otherwise(0.0)
        share = (share, octaves(share), 1 - octaves(1 - share))[turn % 3]
        turn += 1
        middle = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * buckets), F.lit(buckets - 1))
        # The ends are in buckets of their own, so that a pass always gets on.
        at = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), buckets).otherwise(middle)
        counts = inside.groupBy("k", "lo", "hi", at.cast("int").alias("at")).agg(F.count("*").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("c").over(Window.partitionBy("k", "lo", "hi").orderBy("at"))
        counts = counts.withColumn("upto", upto)  # at most buckets + 2 rows a range
        hit = still.join(counts, ["k", "lo", "hi"]).where("rank < below + upto AND rank >= below + upto - c")
        state = cut(state.where("lo >= hi").unionByName(hit.select("k", "rank", F.col("a").alias("lo"), F.col("b").alias("hi"), F.expr("below + upto - c").alias("below"))))
    low = state.select("k", F.col("rank").alias("r0"), F.col("lo").alias("v0"))
    high = state.select("k", F.col("rank").alias("r1"), F.col("lo").alias("v1"))
    found = wanted.withColumns({"r0": F.floor("at"), "r1": F.ceil("at")}).join(low, ["k", "r0"]).join(high, ["k", "r1"])
    return found.select("k.*", "i", (F.col("v0") + (F.col("v1") - F.col("v0")) * (F.col("at") - F.col("r0"))).alias("quantile"))


def scale_diagnostics(payload: DataFrame) -> DataFrame:
    """Quantiles of the lookback scale and counts of tiny ones, by split."""
    points = {"q0": 0.0, "q0_1": 0.001, "q1": 0.01, "q5": 0.05, "q10": 0.1, "q50": 0.5}
    found = quantiles(payload, ["split"], "sd", list(points.values()))
    wide = found.groupBy("split").agg(*[F.max(F.when(F.col("i") == i, F.col("quantile"))).alias(n) for i, n in enumerate(points)])
    tiny = payload.groupBy("split").agg(*(F.count_if(F.col("sd") < x).alias(f"below_{n}") for n, x in (("1e8", 1e-8), ("1e6", 1e-6), ("1e3", 1e-3))))
    return tiny.join(wide, "split", "left").select("split", *points, "below_1e8", "below_1e6", "below_1e3")


#: A state of evaluation: how many windows, and the sums of their losses.
SUMS = ("n", "mse_sum", "mae_sum", "nmse_sum")


def evaluation_state(predictions: DataFrame, by: tuple[str, ...] = ("split", "method")) -> DataFrame:
    """(by, n and the sums of losses) of a batch of predictions; states of several batches merge."""
    losses = (A.mse("yhat", "y"), A.mae("yhat", "y"), A.nmse("yhat", "y", "sd"))
    return predictions.groupBy(*by).agg(F.count("*").alias("n"), *[F.sum(x).alias(c) for x, c in zip(losses, SUMS[1:])])


def merge_states(states: list[DataFrame], by: tuple[str, ...] = ("split", "method")) -> DataFrame:
    """One state out of those of disjoint batches; any order and grouping gives the same."""
    return reduce(DataFrame.unionByName, states).groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def finished(state: DataFrame, reference: str = "vanilla") -> DataFrame:
    """The scores of method_scores() from a state."""
    scores = state.select("split", "method", *[(F.col(f"{c}_sum") / F.col("n")).alias(c) for c in ("mse", "mae", "nmse")])
    return _against(scores, reference)


def method_scores(predictions: DataFrame, reference: str = "vanilla") -> DataFrame:
    """(split, method, mse, mae, nmse, relative_nmse_improvement_pct) over all queries and steps.

    predictions has split, method, y, sd and yhat, all arrays of one length.
    """
    scores = predictions.groupBy("split", "method").agg(
        F.avg(A.mse("yhat", "y")).alias("mse"), F.avg(A.mae("yhat", "y")).alias("mae"), F.avg(A.nmse("yhat", "y", "sd")).alias("nmse")
    )
    return _against(scores, reference)


def _against(scores: DataFrame, reference: str) -> DataFrame:
    """scores with the improvement of their nmse over the reference's, by split."""
    base = scores.where(F.col("method") == reference).select("split", F.col("nmse").alias("ref"))
    change = (F.col("ref") - F.col("nmse")) / F.greatest("ref", F.lit(1e-12)) * 100
    return scores.join(base, "split", "left").withColumn("relative_nmse_improvement_pct", change).drop("ref")


def metric_view(predictions: DataFrame, method: str, reference: str, view: str = "direct", by: str = "h") -> DataFrame:
    """nmse of a method by step or by window: direct, improvement over a reference, or relative to it."""
    if view not in ("direct", "improvement", "relative"):
        raise ValueError(f"unknown view {view}")
    steps = predictions.where(F.col("method").isin(method, reference)).select(
        "split", "method", "qt", "qu", F.posexplode(F.zip_with("yhat", "y", lambda a, b: F.pow((a - b) / A.clamped("sd"), F.lit(2.0)))).alias("h", "e")
    )
    keys = ["split", "h"] if by == "h" else ["split", "qt", "qu"]
    a = steps.where(F.col("method") == method).groupBy(*keys).agg(F.avg("e").alias("a"))
    b = steps.where(F.col("method") == reference).groupBy(*keys).agg(F.avg("e").alias("b"))
    value = {"direct": F.col("a"), "improvement": F.col("b") - F.col("a"), "relative": F.when(F.abs("b") > 1e-12, (F.col("b") - F.col("a")) / F.col("b"))}[view]
    return a.join(b, keys).select(*keys, value.alias("value"))


#: Errors of one step that the views show.
ERRORS = ("difference", "mse", "nmse")


def views(predictions: DataFrame, reference: str, by: str = "h") -> DataFrame:
    """(split, method, step or window, metric, direct, improvement, relative) of every method.

    Errors are averaged by step (by="h") or by window, NaN left out; improvement is the
    reference's taken from it, relative is that by the reference's, null where this is next to 0.
    All methods and metrics come from one aggregation, and the reference meets them by key.
    """
    keys = {"h": ["split", "h"], "window": ["split", "qt", "qu"]}.get(by)
    if keys is None:
        raise ValueError(f"views are by h or by window, not by {by}")
    rows = predictions.select("split", "method", "qt", "qu", A.clamped("sd").alias("s"), F.posexplode(F.arrays_zip("yhat", "y")).alias("h", "z"))
    miss = F.col("z.yhat") - F.col("z.y")
    errors = dict(zip(ERRORS, (miss, F.pow(miss, F.lit(2.0)), F.pow(miss / F.col("s"), F.lit(2.0)))))
    means = rows.groupBy(*keys, "method").agg(*[F.avg(F.when(~F.isnan(e), e)).alias(n) for n, e in errors.items()])
    long = means.select(*keys, "method", F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("direct")) for n in ERRORS])).alias("m"))
    long = long.select(*keys, "method", "m.*")
    ref = long.where(F.col("method") == reference).select(*keys, "metric", F.col("direct").alias("ref"))
    gain = F.col("direct") - F.col("ref")
    out = long.join(ref, [*keys, "metric"], "left")
    return out.select(*keys, "method", "metric", "direct", gain.alias("improvement"), F.when(F.abs("ref") > 1e-12, gain / F.col("ref")).alias("relative"))


def view_averages(predictions: DataFrame, reference: str) -> DataFrame:
    """(split, method, metric, direct, improvement, relative, window_relative): the views' averages over the steps, and that of the windows' own relative changes."""
    steps = views(predictions, reference).groupBy("split", "method", "metric").agg(*[F.avg(c).alias(c) for c in ("direct", "improvement", "relative")])
    own = views(predictions, reference, "window").groupBy("split", "method", "metric").agg(F.avg("relative").alias("window_relative"))
    return steps.join(own, ["split", "method", "metric"])


def correlation(features: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson correlation over the finite pairs; null for fewer than two points or no variance."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    rows = features.where(finite(a) & finite(b))
    out = rows.agg(F.count("*").alias("n"), F.corr(a, b).alias("r"))
    return out.select("n", F.when((F.col("n") >= 2) & ~F.isnan("r"), F.col("r")).alias("r"))


def histogram(rows: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """(bin, count) of sign(x) log(1 + |x|) in equal bins between its extremes."""
    x = F.signum(column) * F.log1p(F.abs(column))
    values = rows.where(F.col(column).isNotNull() & ~F.isnan(column)).select(x.alias("x"))
    span = values.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    at = F.least(F.floor((F.col("x") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0) * bins), F.lit(bins - 1))
    return values.join(F.broadcast(span), F.lit(True)).groupBy(at.cast("long").alias("bin")).agg(F.count("*").alias("count"))
