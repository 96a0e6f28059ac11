"""Queries of the time-series operators over the tables of a folder, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagspark.functions import arrays as A
from lagspark.operators import adapters, attention, batches, forecasts, gates, metrics, mixture, payloads, report, retrieval, runs, windows
from lagspark.sources import series as S
from lagspark.sources import tables as T

from .sql import SQL

LAGS, HORIZON, PERIOD, STORE_STRIDE, QUERY_STRIDE, K, L2 = 48, 12, 24, 24, 6, 5, 1e-3
PARAMS = {"lags": LAGS, "horizon": HORIZON, "period": PERIOD, "store_stride": STORE_STRIDE, "query_stride": QUERY_STRIDE, "k": K, "l2": L2}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Shared inputs. Windows and prediction tables are stored once an application and read by every query that needs them.


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.event_series(read(spark, sf_dir, "events"))


def bounds(long: DataFrame) -> tuple[int, int, int, int]:
    return windows.split_bounds(long.agg(F.max("t")).first()[0] + 1)


def all_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, tuple[int, int, int, int]]:
    """Windows with statistics and features, stored by phase and chunk: queries, store and neighbour lookups read their folders."""
    events = read(spark, sf_dir, "events")

    def make() -> DataFrame:
        rows = windows.features(windows.with_stats(windows.windows(S.event_series(events), LAGS, HORIZON)))
        return windows.placed(rows, STORE_STRIDE, retrieval.DATES)

    rows = T.stored(spark, f"windows-{T.fingerprint(events)}", make, by=("phase", "chunk"), slices=F.floor(F.col("series_id") / 1024))
    return rows, windows.split_bounds((rows.agg(F.max("t")).first()[0] or 0) + LAGS + HORIZON)


def queries_of(rows: DataFrame, ends: tuple[int, int, int, int], splits=windows.SPLITS) -> DataFrame:
    return windows.query_starts(rows, splits, ends, LAGS, HORIZON, QUERY_STRIDE, STORE_STRIDE * retrieval.DATES)


def online(**how) -> retrieval.StorePolicy:
    return retrieval.StorePolicy(LAGS, HORIZON, PERIOD, STORE_STRIDE, **how)


def neighbours(spark: SparkSession, sf_dir: str, metric: str = "euclidean", space: str = "instance"):
    rows, ends = all_windows(spark, sf_dir)
    feats = rows if space == "instance" else windows.features(rows, space)
    q = queries_of(feats, ends)
    return retrieval.knn_blocks(q, feats, online(), K, metric), q, rows


def payload_of(spark: SparkSession, sf_dir: str, splits=windows.SPLITS, lookbacks: bool = False) -> DataFrame:
    """The prediction table of all splits, stored by split: persistence, and the blended forecaster given the neighbours."""

    def make() -> DataFrame:
        near, q, rows = neighbours(spark, sf_dir)
        out = forecasts.payload(q, near, rows, forecasts.persistence(HORIZON), forecasts.blended(HORIZON, PERIOD), lookbacks, STORE_STRIDE)
        return out.where(F.size("nbrs") > 0)

    name = f"payload{'-lookbacks' * lookbacks}-{T.fingerprint(read(spark, sf_dir, 'events'))}"
    rows = T.stored(spark, name, make, by=("split",), slices=F.pmod(F.xxhash64("qt", "qu"), F.lit(64)))
    return rows.where(F.col("split").isin(list(splits))) if tuple(splits) != windows.SPLITS else rows


def frame_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.neighbour_frame(payload_of(spark, sf_dir))


def by_step(rows: DataFrame, column: str, name: str | None = None) -> DataFrame:
    out = rows.select("split", "qt", "qu", F.posexplode(column).alias("h", "v"))
    return out.select("split", "qt", "qu", F.col("h").cast("long").alias("h"), F.round("v", 6).alias(name or column))


def flat(rows: DataFrame, keys: list[str], arrays: list[str], n: int) -> DataFrame:
    """One row a place in parallel arrays of at most n values, rounded; places past an array's end are null."""
    out = rows.select(*keys, *arrays, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("i"))
    return out.select(*keys, F.col("i").cast("long").alias("i"), *(F.round(F.get(F.col(c), F.col("i") - 1), 6).alias(c) for c in arrays))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


# Ingest.


def _long(spark: SparkSession, sf_dir: str, how: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumnRenamed("event_type", "series_name")
    return S.resample(events, "h", how, tie="event_id").select("series_name", "ts", *r6("value"))


@query
def resample_sum(spark, sf_dir):
    return series(spark, sf_dir).select("t", "ts", "series_id", "series_name", *r6("value"))


@query
def resample_mean_complete(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("series_name"), F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"))
    return S.resample(orders, "d", "mean").select("series_name", "ts", *r6("value"))


@query
def resample_first(spark, sf_dir):
    return _long(spark, sf_dir, "first")


@query
def resample_last(spark, sf_dir):
    return _long(spark, sf_dir, "last")


@query
def asfreq_grid(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_name"), F.col("o_orderdate").cast("timestamp").alias("ts")).agg(F.sum("o_totalprice").alias("value"))
    return S.resample(orders, "w", "asfreq").select("series_name", "ts", *r6("value"))


@query
def complete_rows(spark, sf_dir):
    items = read(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").alias("ts"), F.lower(F.concat("l_returnflag", "l_linestatus")).alias("s"), "l_quantity")
    wide = items.groupBy("ts").pivot("s", ["af", "nf", "no", "rf"]).agg(F.sum("l_quantity"))
    some = ["af", "nf", "rf"]
    whole = S.complete_rows(wide.select("ts", *some)).select("ts", *r6(*some))
    return whole.join(wide.select("ts", F.round("no", 6).alias("no")), "ts", "left")


@query
def drop_series(spark, sf_dir):
    long = series(spark, sf_dir)
    names = [r[0] for r in long.select("series_name").distinct().orderBy("series_name").collect()]  # one row a series
    keep = S.drop_series(names, [1, names[-1]])
    return long.where(F.col("series_name").isin(keep)).select("t", "series_name", *r6("value"))


@query
def rename_series(spark, sf_dir):
    return series(spark, sf_dir).select("t", "series_id", F.concat(F.lit("user_"), F.col("series_id")).alias("series_name"), *r6("value"))


@query
def dense_position(spark, sf_dir):
    return S.event_series(read(spark, sf_dir, "events"), how="mean").select("t", "ts", "series_id", "series_name", *r6("value"))


# Windows.


@query
def split_bounds(spark, sf_dir):
    return windows.bounds_table(series(spark, sf_dir))


@query
def query_starts(spark, sf_dir):
    rows, ends = all_windows(spark, sf_dir)
    return queries_of(rows, ends).select("split", "t", "series_id")


@query
def window_extract(spark, sf_dir):
    rows = windows.windows(series(spark, sf_dir), LAGS, HORIZON)
    return flat(rows, ["series_id", "t"], ["x", "y"], LAGS)


@query
def instance_norm(spark, sf_dir):
    rows, _ = all_windows(spark, sf_dir)
    return flat(rows, ["series_id", "t"], ["feat"], LAGS)


@query
def window_extract_all(spark, sf_dir):
    return flat(windows.windows(series(spark, sf_dir), LAGS, HORIZON), ["series_id", "t"], ["x", "y"], LAGS)


@query
def instance_norm_all(spark, sf_dir):
    return flat(all_windows(spark, sf_dir)[0], ["series_id", "t"], ["feat"], LAGS)


@query
def window_stats(spark, sf_dir):
    rows, _ = all_windows(spark, sf_dir)
    return rows.select("series_id", "t", *r6("mu", "sd"))


def _patches(rows: DataFrame) -> DataFrame:
    out = windows.patches(rows, 16, 8).select("series_id", "t", F.posexplode("patches").alias("patch", "v"))
    return flat(out.withColumn("patch", F.col("patch").cast("long")), ["series_id", "t", "patch"], ["v"], 16)


@query
def patch_unfold(spark, sf_dir):
    return _patches(all_windows(spark, sf_dir)[0])


@query
def patch_unfold_all(spark, sf_dir):
    return _patches(all_windows(spark, sf_dir)[0])


@query
def moving_average(spark, sf_dir):
    out = windows.moving_average(all_windows(spark, sf_dir)[0], 5)
    return flat(out, ["series_id", "t"], ["trend", "residual"], LAGS)


@query
def moving_average_all(spark, sf_dir):
    return flat(windows.moving_average(all_windows(spark, sf_dir)[0], 5), ["series_id", "t"], ["trend", "residual"], LAGS)


@query
def fourier_features(spark, sf_dir):
    rows, _ = all_windows(spark, sf_dir)
    return flat(windows.features(rows, "fourier", LAGS), ["series_id", "t"], ["feat"], LAGS)


@query
def encoder_features(spark, sf_dir):
    rows, _ = all_windows(spark, sf_dir)
    basis = np.cos(np.outer(np.arange(LAGS), np.arange(8)) * np.pi / LAGS)
    return windows.embed(rows, lambda x: x @ basis).select("series_id", "t", A.rounded("feat").alias("feat"))


@query
def patch_encoder_features(spark, sf_dir):
    """Lookbacks in the space of a patch transformer's encoder with seeded weights."""
    rows, _ = all_windows(spark, sf_dir)
    model = attention.PatchTransformer.fresh(LAGS, HORIZON, seed=5)
    return windows.embed(rows, model.embed).select("series_id", "t", A.rounded("feat").alias("feat"))


# Retrieval.


def _store(spark, sf_dir, policy: retrieval.StorePolicy) -> DataFrame:
    rows, ends = all_windows(spark, sf_dir)
    out = retrieval.store_bounds(queries_of(rows, ends), policy).where("keep_n > 0")
    return out.select("split", "t", "series_id", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "keep_n")


@query
def store_online(spark, sf_dir):
    return _store(spark, sf_dir, online())


@query
def store_fixed(spark, sf_dir):
    end = bounds(series(spark, sf_dir))[0]
    return _store(spark, sf_dir, online(online=False, store_end=end))


@query
def store_capped(spark, sf_dir):
    return _store(spark, sf_dir, online(min_dates=5, max_dates=5, max_windows=40, n_series=5))


@query
def eligible_queries(spark, sf_dir):
    rows, ends = all_windows(spark, sf_dir)
    return retrieval.eligible(queries_of(rows, ends), online(min_dates=12), K).select("split", "t", "series_id")


@query
def knn_euclidean(spark, sf_dir):
    near, *_ = neighbours(spark, sf_dir)
    return near.withColumn("distance", F.round("distance", 6))


@query
def knn_cosine(spark, sf_dir):
    near, *_ = neighbours(spark, sf_dir, metric="cosine", space="raw")
    return near.withColumn("distance", F.round("distance", 6))


@query
def knn_pearson(spark, sf_dir):
    near, *_ = neighbours(spark, sf_dir, metric="pearson", space="raw")
    return near.withColumn("distance", F.round("distance", 6))


@query
def knn_blocked(spark, sf_dir):
    rows, ends = all_windows(spark, sf_dir)
    near = retrieval.knn_blocks(queries_of(rows, ends), rows, online(), K, dates=8, series=2, query_dates=4)
    return near.withColumn("distance", F.round("distance", 6))


@query
def knn_embeddings(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.transform("embedding", lambda e: e.cast("double")).alias("feat"), F.lit(0).cast("long").alias("series_id"))
    policy = retrieval.StorePolicy(0, 0, 1, 1, online=False, align=False, store_end=1 << 62)
    near = retrieval.knn_blocks(rows.where("t % 100 = 0").withColumn("split", F.lit("all")), rows, policy, K + 1, dates=4096, query_dates=100 * 4096)
    # The query itself is among its own k + 1 nearest, or hidden behind as many copies of it.
    from pyspark.sql.window import Window

    others = near.where("qt <> nt").withColumn("rank", F.row_number().over(Window.partitionBy("qt").orderBy("distance", "nt")).cast("long"))
    return others.where(F.col("rank") <= K).select(F.col("qt").alias("qid"), "rank", F.col("nt").alias("nid"), *r6("distance"))


@query
def neighbor_lookup(spark, sf_dir):
    near, _, rows = neighbours(spark, sf_dir)
    return flat(retrieval.lookup(near, rows, STORE_STRIDE), ["qt", "qu", "rank"], ["xc", "yc"], LAGS)


@query
def leave_one_out_context(spark, sf_dir):
    near, _, rows = neighbours(spark, sf_dir)
    each = retrieval.leave_one_out(retrieval.lookup(near, rows, STORE_STRIDE)).select("qt", "qu", "rank", F.posexplode("context").alias("i", "w"))
    other = F.when(F.col("i") + 1 < F.col("rank"), F.col("i") + 1).otherwise(F.col("i") + 2).cast("long")
    each = each.select("qt", "qu", "rank", other.alias("other"), F.slice("w", -HORIZON, HORIZON).alias("y"))
    return flat(each, ["qt", "qu", "rank", "other"], ["y"], HORIZON)


@query
def same_series(spark, sf_dir):
    return metrics.feature_table(payload_of(spark, sf_dir)).select("split", "qt", "qu", "same_user_fraction")


# Forecasts.


@query
def persistence_forecast(spark, sf_dir):
    return by_step(payload_of(spark, sf_dir), "pred")


@query
def context_forecast(spark, sf_dir):
    return by_step(payload_of(spark, sf_dir), "pred_ctx", "pred")


@query
def linear_forecast(spark, sf_dir):
    rows, ends = all_windows(spark, sf_dir)
    weights = np.array([[(h + 1) * (i + 1) / 2311 for i in range(LAGS)] for h in range(HORIZON)])
    model = forecasts.load_model("linear", weights=weights, bias=np.arange(HORIZON, dtype=float))
    rows = queries_of(rows, ends).select("split", F.col("t").alias("qt"), F.col("series_id").alias("qu"), model(F.col("x"), None).alias("pred"))
    out = rows.select("split", "qt", "qu", F.posexplode("pred").alias("h", "v"))
    return out.select("split", "qt", "qu", F.col("h").cast("long").alias("h"), F.round("v", 4).alias("pred"))


def _nbrs(spark, sf_dir) -> DataFrame:
    return payload_of(spark, sf_dir).select("split", "qt", "qu", F.explode("nbrs").alias("n")).select("split", "qt", "qu", "n.*")


@query
def scale_transfer(spark, sf_dir):
    return _nbrs(spark, sf_dir).transform(flat, ["split", "qt", "qu", "rank"], ["ys"], HORIZON)


@query
def residual_transfer(spark, sf_dir):
    return _nbrs(spark, sf_dir).transform(flat, ["split", "qt", "qu", "rank"], ["es"], HORIZON)


@query
def payload(spark, sf_dir):
    rows = _nbrs(spark, sf_dir)
    out = flat(rows, ["split", "qt", "qu", "rank", "nt", "nu", "distance", "mu", "sd"], ["ys", "es"], HORIZON)
    return out.withColumns({c: F.round(c, 6) for c in ("distance", "mu", "sd")})


# Metrics and adapters.


@query
def window_losses(spark, sf_dir):
    out = metrics.window_losses(payload_of(spark, sf_dir))
    return out.select("split", "qt", "qu", F.round("mse", 6).alias("mse"), *r6("mae", "nmse"))


@query
def loss_summary(spark, sf_dir):
    out = metrics.loss_summary(metrics.window_losses(payload_of(spark, sf_dir)))
    return out.select("split", "metric", *(F.round(c, 6).alias(c) for c in ("mean", "std", "w10_user_mean")))


@query
def user_losses(spark, sf_dir):
    return metrics.user_losses(metrics.window_losses(payload_of(spark, sf_dir))).select("split", "qu", *r6("nmse_mean", "nmse_std"))


@query
def horizon_profile(spark, sf_dir):
    return metrics.horizon_profile(payload_of(spark, sf_dir)).withColumn("mse", F.round("mse", 6))


@query
def distance_weights(spark, sf_dir):
    rows = payload_of(spark, sf_dir).select("split", "qt", "qu", F.posexplode(adapters.weights()).alias("r", "w"))
    return rows.select("split", "qt", "qu", (F.col("r") + 1).cast("long").alias("rank"), *r6("w"))


@query
def knn_weighted(spark, sf_dir):
    return by_step(frame_of(spark, sf_dir), "yw")


@query
def knn_mean(spark, sf_dir):
    return by_step(frame_of(spark, sf_dir), "ym")


@query
def residual_knn(spark, sf_dir):
    return by_step(frame_of(spark, sf_dir), "ew")


@query
def mix_scalars(spark, sf_dir):
    models = adapters.fit_table(payload_of(spark, sf_dir).where("split = 'train'"), K, L2)
    of = lambda name: F.round(F.max(F.when(F.col("method") == name, F.col("beta")[0])), 6)
    return models.agg(of("horizon_mix_scalar").alias("horizon_mix"), of("residual_mix_scalar").alias("residual_mix"))


def _scores(out: DataFrame) -> DataFrame:
    out = metrics.method_scores(out) if "yhat" in out.columns else out
    return out.select(
        "split", "method", F.round("mse", 6).alias("mse"), F.round("mae", 5).alias("mae"), F.round("nmse", 6).alias("nmse"),
        F.round("relative_nmse_improvement_pct", 5).alias("relative_nmse_improvement_pct"),
    )


SIMPLE = ("vanilla", "context_forecast", "horizon_knn_weighted", "horizon_knn_mean", "residual_knn_weighted", "horizon_mix_scalar", "residual_mix_scalar")


@query
def method_scores(spark, sf_dir):
    return _scores(adapters.run(payload_of(spark, sf_dir), K, L2).where(F.col("method").isin(list(SIMPLE))))


@query
def ridge_scores(spark, sf_dir):
    """All eleven methods and the six evaluation-fitted bounds."""
    return _scores(adapters.run(payload_of(spark, sf_dir), K, L2, fit_on_eval=True))


@query
def ridge_coefficients(spark, sf_dir):
    models = adapters.fit_table(payload_of(spark, sf_dir).where("split = 'train'"), K, L2)
    rows = models.select("method", F.greatest("h", F.lit(0)).cast("long").alias("h"), F.posexplode("beta").alias("i", "value"))
    return rows.select("method", "h", F.col("i").cast("long").alias("i"), F.round("value", 5).alias("value"))


@query
def ridge_by_series(spark, sf_dir):
    """Adapters fitted for each series by itself, and their scores."""
    rows = payload_of(spark, sf_dir)
    models = adapters.fit_table(rows.where("split = 'train'"), K, L2, by=("qu",))
    scored = adapters.predict(rows, models, K, by=("qu",)).where(F.col("method").isin("residual_ridge_shared", "horizon_ridge_shared", "horizon_mix_scalar"))
    return scored.groupBy("split", "method").agg(F.round(F.avg(A.nmse("yhat", "y", "sd")), 5).alias("nmse"))


@query
def reloaded_scores(spark, sf_dir):
    """Coefficients written as a version of a model table, read back and joined with the rows they predict."""
    rows, root = payload_of(spark, sf_dir), f"{T.application_folder(spark)}/models"
    fitted = adapters.fit_table(rows.where("split = 'train'"), K, L2)
    version = T.save_model(fitted, root, "adapters", fitted_on="train")
    models = T.load_model(spark, root, "adapters", version).where("fitted_on = 'train'")
    return _scores(adapters.predict(rows, models, K).where(F.col("method").isin(list(SIMPLE))))


@query
def merged_scores(spark, sf_dir):
    """Scores from the merged states of batches, one a weekday of the query's date."""
    scored = adapters.predict(payload_of(spark, sf_dir), None, K)
    batches = [metrics.evaluation_state(scored.where(F.pmod(F.floor(F.col("qt") / 24), F.lit(7)) == d)) for d in range(7)]
    return _scores(metrics.finished(metrics.merge_states(batches)))


@query
def random_draws(spark, sf_dir):
    return payloads.draw(payload_of(spark, sf_dir), 500, seed=11).select("draw", "split", "qt", "qu")


@query
def feature_table(spark, sf_dir):
    out = metrics.feature_table(payload_of(spark, sf_dir))
    r4 = [F.round(c, 6).alias(c) for c in ("base_loss", "context_loss", "oracle_loss")]
    return out.select(
        "split", "qt", "qu", *r4, "context_better", F.round("improvement_pct", 5).alias("improvement_pct"), "neighbours",
        *r6("distance_mean", "distance_std", "same_user_fraction", "age_mean", "age_std", "neighbour_mean_mean", "neighbour_std_std"),
    )


@query
def scale_quantiles(spark, sf_dir):
    rows, ends = all_windows(spark, sf_dir)
    names = ("q0", "q0_1", "q1", "q5", "q10", "q50")
    return metrics.scale_diagnostics(queries_of(rows, ends)).select("split", *r6(*names), "below_1e8", "below_1e6", "below_1e3")


# Gates.


def _gate_nmse(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("split", "method").agg(F.round(F.avg(A.nmse("yhat", "y", "sd")), 6).alias("nmse"))


@query
def bayes_gates(spark, sf_dir):
    return _gate_nmse(gates.bayes_gates(payload_of(spark, sf_dir)))


@query
def oracle_gates(spark, sf_dir):
    return _gate_nmse(gates.oracles(payload_of(spark, sf_dir)))


@query
def gate_features(spark, sf_dir):
    return gates.gate_features(payload_of(spark, sf_dir)).select("split", "qt", "qu", *r6(*gates.SCALAR), F.round("target", 6).alias("target"))


@query
def boosted_gates(spark, sf_dir):
    return _gate_nmse(gates.run(payload_of(spark, sf_dir), HORIZON))


def _gate_scores(rows: DataFrame) -> DataFrame:
    """A score of our own for the diagnostics: how far the context forecast lies below the plain one."""
    f = gates.gate_features(rows).where("split = 'eval'")
    return f.select("split", "qt", "qu", F.round(-F.col("context_shift_mean"), 6).alias("score"), F.round("target", 6).alias("target"))


@query
def roc_curve(spark, sf_dir):
    return gates.roc_curve(_gate_scores(payload_of(spark, sf_dir))).select("score", "tp", "fp", *r6("tpr", "fpr"))


@query
def roc_auc(spark, sf_dir):
    return gates.roc_auc(_gate_scores(payload_of(spark, sf_dir))).select(*r6("auc", "accuracy"), "n")


@query
def threshold_sweep(spark, sf_dir):
    rows = payload_of(spark, sf_dir)
    return gates.threshold_sweep(rows, _gate_scores(rows)).select("i", *r6("threshold", "right_pct", "nmse"))


@query
def gate_summary(spark, sf_dir):
    rows = payload_of(spark, sf_dir)
    return gates.gate_summary(rows, gates.oracles(rows).where("method = 'oracle_context_scalar'")).select("split", "method", *r6("right_pct", "nmse"))


@query
def metric_views(spark, sf_dir):
    rows = adapters.predict(payload_of(spark, sf_dir), None, K)
    return metrics.metric_view(rows, "horizon_knn_mean", "vanilla", "relative").select("split", F.col("h").cast("long").alias("h"), *r6("value"))


@query
def feature_correlation(spark, sf_dir):
    return metrics.correlation(metrics.feature_table(payload_of(spark, sf_dir)), "distance_mean", "improvement_pct").select("n", *r6("r"))


@query
def loss_histogram(spark, sf_dir):
    return metrics.histogram(gates.gate_features(payload_of(spark, sf_dir)), "target")


@query
def step_views(spark, sf_dir):
    """Every method's errors by step: direct, against the plain forecast, and relative to it."""
    rows = adapters.predict(payload_of(spark, sf_dir), None, K)
    out = metrics.views(rows, "vanilla")
    return out.select("split", "method", F.col("h").cast("long").alias("h"), "metric", F.round("direct", 5).alias("direct"), F.round("improvement", 5).alias("improvement"), *_relative())


@query
def window_views(spark, sf_dir):
    """Every method's errors by window, as step_views shows them by step."""
    rows = adapters.predict(payload_of(spark, sf_dir), None, K)
    out = metrics.views(rows, "vanilla", "window")
    return out.select("split", "method", "qt", "qu", "metric", *r6("direct", "improvement"), *_relative())


def _relative() -> list:
    """Relative changes of squared errors; those of differences may be over next to nothing."""
    return [F.round(F.when(F.col("metric") != "difference", F.col("relative")), 4).alias("relative")]


@query
def view_averages(spark, sf_dir):
    out = metrics.view_averages(adapters.predict(payload_of(spark, sf_dir), None, K), "vanilla").where("metric <> 'difference'")
    return out.select("split", "method", "metric", *[F.round(c, 4).alias(c) for c in ("direct", "improvement", "relative", "window_relative")])


# Batches of a learner.


@query
def batch_neighbours(spark, sf_dir):
    """Neighbours' horizons and residuals as a learner reads them, on the query's own scale."""
    rows = batches.prepare(payload_of(spark, sf_dir)).select("split", "qt", "qu", F.explode("nbrs").alias("n")).select("split", "qt", "qu", "n.rank", "n.ys", "n.es")
    return flat(rows, ["split", "qt", "qu", "rank"], ["ys", "es"], HORIZON)


@query
def batch_restored(spark, sf_dir):
    """Forecasts halfway between the plain and the context one, made on the query's own scale and brought back."""
    rows = batches.prepare(payload_of(spark, sf_dir)).withColumn("yhat", F.zip_with("pred", "pred_ctx", lambda a, b: (a + b) / 2))
    return by_step(batches.restore(rows, ["yhat"]), "yhat")


@query
def batch_losses(spark, sf_dir):
    """The context forecast's loss under each normalisation; they agree."""
    rows = payload_of(spark, sf_dir)
    each = [batches.prepare(rows, how).select("split", F.lit(how).alias("how"), batches.loss("pred_ctx").alias("l")) for how in batches.NORMALISATIONS]
    return each[0].unionByName(each[1]).groupBy("split", "how").agg(F.round(F.avg("l"), 6).alias("loss"))


# Runs.


def _run(spark, sf_dir) -> runs.Run:
    """A run written from the prediction table and loaded again; its later source replaces a method and a gate of the earlier one."""
    root, rows = f"{T.application_folder(spark)}/run-{T.fingerprint(read(spark, sf_dir, 'events'))}", payload_of(spark, sf_dir)
    if not T.exists(spark, f"{root}/done"):
        own = ("horizon_knn_mean", "residual_knn_weighted")
        scored = adapters.predict(rows, None, K).where(F.col("method").isin(list(own)))
        # The baselines hold a first try at a gate, the context forecast itself; of the gates it is another one, in the eval split only.
        shown = rows.select("split", F.lit("bayes_context_scalar").alias("method"), "qt", "qu", F.col("pred_ctx").alias("yhat"))
        f = gates.gate_features(rows)
        score = lambda name, c: f.select("split", F.lit(name).alias("gate"), "qt", "qu", c.alias("score"))
        runs.save(root, rows)
        first = score("shift", F.col("target")).unionByName(score("target", F.col("target")))
        runs.save(root, source="baselines", forecasts=scored.select(*shown.columns).unionByName(shown), gates=first)
        runs.save(root, source="gates", forecasts=gates.bayes_gates(rows).where("split = 'eval'").select(*shown.columns), gates=score("shift", -F.col("context_shift_mean")).where("split <> 'train'"))
        T.write_text(spark, f"{root}/done", "")
    return runs.load(spark, root)


@query
def run_scores(spark, sf_dir):
    """Scores of all forecasts of a run whose sources are merged at loading."""
    return _gate_nmse(_run(spark, sf_dir).joined())


@query
def run_gates(spark, sf_dir):
    """How often the gates of a run take the context forecast, and how often rightly."""
    return runs.gate_shares(_run(spark, sf_dir)).select("split", "gate", "n", *r6("taken_pct", "right_pct"))


@query
def feature_file(spark, sf_dir):
    """The feature table of all splits written as CSV and read back by its own columns."""
    folder = f"{T.application_folder(spark)}/features-{T.fingerprint(read(spark, sf_dir, 'events'))}.csv"
    table = metrics.feature_table(payload_of(spark, sf_dir))
    if not T.exists(spark, f"{folder}/_SUCCESS"):
        S.write_csv(table, folder)
    out = spark.read.csv(folder, header=True, schema=table.schema)
    names = ("forecast_disagreement", "query_mean", "query_std", "neighbour_mean_mean", "neighbour_mean_std", "neighbour_std_mean", "neighbour_std_std")
    return out.select("split", "qt", "qu", "context_better", "neighbours", *r6("base_loss", "context_loss", "oracle_loss"), *r6(*names))


# Prediction tables as inputs.


@query
def payload_shapes(spark, sf_dir):
    return payloads.validate(payload_of(spark, sf_dir))


@query
def missing_splits(spark, sf_dir):
    return payloads.missing_splits(payload_of(spark, sf_dir, ("train", "eval")))


@query
def payload_alignment(spark, sf_dir):
    rows, ends = all_windows(spark, sf_dir)
    asked = queries_of(rows, ends).select("split", F.col("t").alias("qt"), F.col("series_id").alias("qu"))
    return payloads.aligned(asked, payload_of(spark, sf_dir))


@query
def merged_predictions(spark, sf_dir):
    rows = payload_of(spark, sf_dir)
    first = rows.select("split", "qt", "qu", F.lit("shown").alias("method"), F.col("pred").alias("yhat"))
    later = rows.where("split = 'eval'").select("split", "qt", "qu", F.lit("shown").alias("method"), F.col("pred_ctx").alias("yhat"))
    return by_step(payloads.merge([first, later]), "yhat")


@query
def head_samples(spark, sf_dir):
    return payloads.head(payload_of(spark, sf_dir), 40).select("split", "qt", "qu")


@query
def random_samples(spark, sf_dir):
    return payloads.sample(payload_of(spark, sf_dir), 60, seed=7).select("split", "qt", "qu")


@query
def single_precision(spark, sf_dir):
    return payloads.single(series(spark, sf_dir), "value").select("t", "series_id", *r6("value"))


@query
def plot_weights(spark, sf_dir):
    w = payloads.plot_weights(F.transform("nbrs", lambda n: n["distance"]))
    rows = payload_of(spark, sf_dir).select("split", "qt", "qu", F.posexplode(w).alias("r", "w"))
    return rows.select("split", "qt", "qu", (F.col("r") + 1).cast("long").alias("rank"), *r6("w"))


@query
def dashboard_features(spark, sf_dir):
    return payloads.dashboard_features(payload_of(spark, sf_dir)).select("split", "qt", "qu", *r6(*gates.SCALAR))


@query
def optional_columns(spark, sf_dir):
    rows = payload_of(spark, sf_dir)
    has = {"disagreement": (("pred", "pred_ctx"), A.mse("pred_ctx", "pred")), "memory": (("memory",), F.lit(1.0)), "scale": (("sd",), F.col("sd"))}
    out = payloads.with_optional(rows, has)
    return out.select("split", "qt", "qu", *r6(*[c for c in has if c in out.columns]))


@query
def method_labels(spark, sf_dir):
    names = {"vanilla": "plain", "context_forecast": "context"}
    rows = payloads.labelled(_means(spark, sf_dir).select("method").distinct(), names, patterns={"^horizon_(.*)$": "H $1"})
    return rows.select("method", "label")


@query
def gate_choice(spark, sf_dir):
    """Scores and targets of one step's boosted classifier; fitted, so without SQL."""
    return gates.select_score(gates.gate_scores(payload_of(spark, sf_dir), HORIZON), "classifier", 0)


@query
def ridge_pair(spark, sf_dir):
    """Ridge of the targets on the plain and the context forecast, by split and step."""
    rows = payload_of(spark, sf_dir).select("split", F.posexplode(F.arrays_zip("pred", "pred_ctx", "y")).alias("h", "z"))
    rows = rows.select("split", "h", F.array("z.pred", "z.pred_ctx").alias("f"), F.col("z.y").alias("target"))
    fitted = adapters.ridge(rows, 2, L2, ["split", "h"])
    return fitted.select("split", F.col("h").cast("long").alias("h"), *(F.round(F.col("beta")[i], 5).alias(f"b{i}") for i in (0, 1)))


# Report and mixture.


#: Steps of the settings that the reports compare, by name.
SETTINGS = {"48_6": 6, "48_12": 12}


def _records(spark, sf_dir) -> DataFrame:
    """Result records read back from a tree of metric files: a dataset a series, a setting a number of steps."""
    root = f"{T.application_folder(spark)}/results-{T.fingerprint(read(spark, sf_dir, 'events'))}"
    if not T.exists(spark, f"{root}/done"):
        names = series(spark, sf_dir).select(F.col("series_id").alias("qu"), F.col("series_name").alias("dataset")).distinct()
        scored = adapters.run(payload_of(spark, sf_dir), K, L2).where(F.col("method").isin(list(SIMPLE)))
        cut = F.array(*[F.struct(F.lit(n).alias("setting"), *[F.slice(c, 1, h).alias(c) for c in ("y", "yhat")]) for n, h in SETTINGS.items()])
        scored = scored.select("split", "method", "qu", "sd", F.explode(cut).alias("c")).select("split", "method", "qu", "sd", "c.*").join(names, "qu")
        state = metrics.evaluation_state(scored, ("dataset", "setting", "split", "method"))
        report.write_metrics(state.select("dataset", "setting", "split", "method", *[(F.col(f"{c}_sum") / F.col("n")).alias(c) for c in ("mse", "mae", "nmse")]), root, "adapters")
        T.write_text(spark, f"{root}/done", "")
    return report.discover(spark, root)


def _means(spark, sf_dir) -> DataFrame:
    means = report.averaged(report.filtered(_records(spark, sf_dir), "NMSE", "EVAL", methods=SIMPLE))
    return means.withColumn("method", F.substring_index("method", "/", -1))


@query
def results_pivot(spark, sf_dir):
    names = ["vanilla", "horizon_knn_mean", "context_forecast"]
    return report.pivoted(_means(spark, sf_dir), names).select("dataset", "setting", *r6(*names))


@query
def results_table(spark, sf_dir):
    """Cells and their averages by series, by setting and overall, with improvements beside them."""
    names = ["horizon_knn_mean", "context_forecast", "horizon_mix_scalar"]
    out = report.table(_means(spark, sf_dir), names, "vanilla")
    return out.select("level", "dataset", "setting", *r6(*names), *[F.round(f"{n}_pct", 5).alias(f"{n}_pct") for n in names])


@query
def csv_series(spark, sf_dir):
    """Hourly sums of the events written as a wide CSV with a sidecar, and loaded from it: two series dropped or renamed by its options."""
    events, long = read(spark, sf_dir, "events"), series(spark, sf_dir)
    root = f"{T.application_folder(spark)}/csv-{T.fingerprint(events)}"
    if not T.exists(spark, f"{root}/config.json"):
        names = [r[0] for r in long.select("series_name").distinct().orderBy("series_name").collect()]  # one row a series
        S.write_csv(long.groupBy("ts").pivot("series_name", names).agg(F.first("value")), f"{root}/events.csv")
        T.write_text(spark, f"{root}/config.json", '{"date_col": "ts", "drop_users": [1], "aggr": "sum", "aggr_period": "d", "wide": {"rename_users": true}}')
    return S.load_csv(spark, root, scope="wide").select("t", "ts", "series_id", "series_name", *r6("value"))


@query
def improvement_of_averages(spark, sf_dir):
    out = report.improvements(_means(spark, sf_dir), "vanilla")
    return out.select("level", "dataset", "setting", "method", *r6("value"), F.round("improvement_pct", 5).alias("improvement_pct"))


@query
def positive_only(spark, sf_dir):
    return report.positive_only(_means(spark, sf_dir), "vanilla").select("dataset", "setting", "method", *r6("value"))


@query
def best_flag(spark, sf_dir):
    return report.best_flags(_means(spark, sf_dir)).select("dataset", "setting", "method", "best")


@query
def scale_exponents(spark, sf_dir):
    return report.scale_exponents(_means(spark, sf_dir), "vanilla")


@query
def sweep_matrix(spark, sf_dir):
    means = _means(spark, sf_dir).withColumn("method", F.concat_ws("/", "setting", "method"))
    out = report.sweep_matrix(means, ["vanilla", "horizon_knn_mean", "missing"], list(SETTINGS), 2.0)
    return out.select("variant", "run", *r6("value"), F.round("improvement_pct", 5).alias("improvement_pct"))


@query
def adapter_identity_init(spark, sf_dir):
    return by_step(payload_of(spark, sf_dir).withColumn("yhat", mixture.identity_mixture()), "yhat")


@query
def adapter_loss(spark, sf_dir):
    rows = frame_of(spark, sf_dir)
    memory = F.zip_with("yw", "pred", lambda a, b: a - b)
    return mixture.loss(rows, F.col("pred_ctx"), F.col("ew"), memory).withColumn("loss", F.round("loss", 6))


@query
def attention_identity(spark, sf_dir):
    """The attention adapter before training: its forward pass must give the identity mixture."""
    model = attention.Adapter.fresh(LAGS, HORIZON, seed=3)
    return by_step(attention.apply(payload_of(spark, sf_dir, lookbacks=True), model), "yhat")


@query
def attention_adapter(spark, sf_dir):
    """The attention adapter with heads trained on the train split."""
    rows = payload_of(spark, sf_dir, lookbacks=True)
    model = attention.fit(rows.where("split = 'train'"), attention.Adapter.fresh(LAGS, HORIZON, seed=3), rounds=20)
    return _gate_nmse(attention.apply(rows, model))


@query
def patch_forecast(spark, sf_dir):
    """Forward pass of a patch transformer with seeded weights."""
    rows, ends = all_windows(spark, sf_dir)
    model = attention.PatchTransformer.fresh(LAGS, HORIZON, seed=5)
    rows = forecasts.batch_model(queries_of(rows, ends), model.forecast).select("split", F.col("t").alias("qt"), F.col("series_id").alias("qu"), "pred")
    return by_step(rows, "pred")


@query
def trained_mixture(spark, sf_dir):
    rows = frame_of(spark, sf_dir)
    fitted = mixture.fit_mixture(rows.where("split = 'train'"), HORIZON)
    return _gate_nmse(mixture.apply_mixture(rows, fitted))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in QUERIES if name in SQL}
