"""The time-series operators on hand-made values."""

import json
import math

import numpy as np
import pytest
from lagspark.functions import arrays as A
from lagspark.operators import adapters, forecasts, gates, metrics, mixture, report, retrieval, windows
from lagspark.sources import series as S
from pyspark.sql import functions as F


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def array(*x):
    return F.array(*[F.lit(float(v)) for v in x])


@pytest.fixture(scope="module")
def tiny(tmp_path_factory):
    folder = tmp_path_factory.mktemp("csv")
    lines = [f"2024-01-01 {h:02d}:00:00,{10 + h}.0,{20 - h}.0,{5 + h / 2}" for h in range(12)]
    (folder / "tiny.csv").write_text("date,user_a,user_b,temp\n" + "\n".join(lines) + "\n")
    return folder


def test_csv_load(spark, tiny):
    long = S.load_csv(spark, str(tiny), target_cols="user_a;user_b")
    assert long.count() == 24 and long.select("series_id").distinct().count() == 2
    w = windows.windows(long, 4, 2)
    assert w.count() == 2 * 7
    first = w.where("series_id = 0 AND t = 0").first()
    assert first["x"] == [10, 11, 12, 13] and first["y"] == [14, 15]
    named = S.load_csv(spark, str(tiny), "tiny", drop_users=["temp", 0], rename_users=True)
    assert {r[0] for r in named.select("series_name").distinct().collect()} == {"user_0"}
    with pytest.raises(KeyError):
        S.load_csv(spark, str(tiny), target_cols="nope")
    with pytest.raises(ValueError):
        S.load_csv(spark, str(tiny), drop_users=[0, 1, 2])


def test_config_and_lists(tmp_path, tiny):
    assert S.as_list("a, b;c") == ["a", "b", "c"] and S.as_list(None) == [] and S.first_given(None, 0, 1) == 0
    (tmp_path / "config.json").write_text(json.dumps({"aggr": "sum", "other": 1, "mine": {"aggr": "mean"}}))
    csv = str(tmp_path / "x.csv")
    assert S.load_config(csv) == {"aggr": "sum"} and S.load_config(csv, scope="mine") == {"aggr": "mean"}
    with pytest.raises(FileNotFoundError):
        S.load_config(csv, str(tmp_path / "none.json"))
    assert S.json_options('{"a": 1}') == {"a": 1} and S.json_options("") == {}
    assert S.drop_series(["a", "b", "1"], ["1", 0]) == ["b"]
    with pytest.raises(IndexError):
        S.drop_series(["a"], [-1])


def test_resample_fills_or_drops(spark):
    data = [("a", "2024-01-01 00:10:00", 1.0), ("a", "2024-01-01 02:10:00", 2.0), ("b", "2024-01-01 00:20:00", 3.0), ("b", "2024-01-01 02:40:00", 5.0), ("b", "2024-01-01 02:50:00", 7.0)]
    long = spark.createDataFrame(data, "series_name string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    summed = {(r["series_name"], r["ts"].hour): r["value"] for r in S.resample(long, "h", "sum").collect()}
    assert summed == {("a", 0): 1, ("a", 1): 0, ("a", 2): 2, ("b", 0): 3, ("b", 1): 0, ("b", 2): 12}
    for how, last in (("mean", 6.0), ("first", 5.0), ("last", 7.0)):
        got = {(r["series_name"], r["ts"].hour): r["value"] for r in S.resample(long, "h", how).collect()}
        assert len(got) == 4 and got["b", 2] == last
    assert S.resample(long, "h", None).count() == 5
    with pytest.raises(ValueError):
        S.resample(long, "h", "median")


def test_bounds_and_store(spark):
    assert windows.split_bounds(100) == (30, 65, 80, 100)
    with pytest.raises(ValueError):
        windows.parse_ratios("0.5,0.5")
    q = spark.createDataFrame([(80,), (20,)], "t long")
    fixed = retrieval.StorePolicy(4, 2, 1, 1, online=False, store_end=30)
    r = {x["t"]: x for x in retrieval.store_bounds(q, fixed).collect()}
    assert (r[80]["lo"], r[80]["hi"], r[80]["keep_n"]) == (0, 24, 25)
    near = retrieval.StorePolicy(4, 2, 1, 1, min_dates=25, max_dates=25)
    r = {x["t"]: x for x in retrieval.store_bounds(q, near).collect()}
    assert (r[80]["hi"], r[80]["keep_n"]) == (74, 25) and r[20]["keep_n"] == 0
    assert [x["t"] for x in retrieval.eligible(q, near, 3).collect()] == [80] and retrieval.eligible(q, near, 0).count() == 2
    with pytest.raises(ValueError, match="multiple"):
        retrieval.StorePolicy(4, 2, 2, 5)


def test_store_never_overlaps_the_query(spark):
    for period, stride in ((1, 1), (3, 6), (4, 4)):
        policy = retrieval.StorePolicy(5, 2, period, stride, max_dates=4)
        for r in retrieval.store_bounds(spark.range(60).withColumnRenamed("id", "t"), policy).where("keep_n > 0").collect():
            assert r["hi"] + 7 <= r["t"] and r["lo"] >= 0 and (r["hi"] - r["lo"]) % stride == 0 and (r["t"] - r["hi"]) % period == 0


def test_array_functions(spark):
    assert value(spark, A.transfer(array(14, 16), F.lit(10.0), F.lit(2.0), F.lit(5.0), F.lit(2.0))) == [9, 11]
    assert value(spark, A.transfer_residual(array(2, 4), F.lit(2.0), F.lit(2.0))) == [2, 4]
    assert math.isclose(value(spark, A.std(array(1, 3, 5))), math.sqrt(8 / 3))
    z = value(spark, A.instance_normal(array(1, 3, 5), A.mean(array(1, 3, 5)), A.std(array(1, 3, 5))))
    assert abs(np.mean(z)) < 1e-6 and abs(np.std(z) - 1) < 1e-6
    assert math.isclose(sum(value(spark, A.distance_weights(array(1, 2, 4)))), 1)
    assert value(spark, A.distance_weights(array(2, 2))) == [0.5, 0.5]
    assert value(spark, A.weighted(array(0.25, 0.75), F.array(array(4, 8), array(0, 4)))) == [1, 5]
    assert value(spark, A.nmse(array(0), array(2), F.lit(0.0))) == pytest.approx((2 / 1e-8) ** 2)


PAYLOAD = (
    "split string, qt long, qu long, x array<double>, y array<double>, mu double, sd double, pred array<double>, pred_ctx array<double>,"
    "nbrs array<struct<rank:bigint,nt:bigint,nu:bigint,distance:double,mu:double,sd:double,ys:array<double>,es:array<double>>>"
)


def hand(spark):
    n = [(1, 30, 3, 0.5, 10.0, 2.0, [9.0, 11.0], [2.0, 4.0])]
    return spark.createDataFrame([("eval", 42, 3, [3.0, 7.0], [9.0, 11.0], 5.0, 2.0, [7.0, 7.0], [8.0, 8.0], n)], PAYLOAD)


def test_hand_payload(spark):
    f = gates.gate_features(hand(spark)).first()
    assert [f[c] for c in ("context_shift_mean", "context_shift_std", "weighted_minus_pred_mean", "weighted_residual_mean")] == [1, 0, 3, 3]
    assert len(gates.SCALAR) == 15 and len(gates.with_shift_columns(gates.gate_features(hand(spark)), 2)[1]) == 15
    t = metrics.feature_table(hand(spark)).first()
    assert t["same_user_fraction"] == 1 and t["age_mean"] == 12 and t["neighbour_mean_mean"] == 10 and t["neighbour_mean_std"] == 0
    assert t["context_better"] and t["base_loss"] == 10 and t["context_loss"] == 5


def test_context_from_windows(spark):
    q = spark.createDataFrame([("eval", 42, 3, [3.0, 7.0], [9.0, 11.0], 5.0, 2.0)], "split string, t long, series_id long, x array<double>, y array<double>, mu double, sd double")
    w = spark.createDataFrame([(30, 3, [8.0, 12.0], [14.0, 16.0], 10.0, 2.0)], "t long, series_id long, x array<double>, y array<double>, mu double, sd double")
    near = spark.createDataFrame([("eval", 42, 3, 1, 30, 3, 0.5)], "split string, qt long, qu long, rank long, nt long, nu long, distance double")
    p = forecasts.payload(q, near, w, forecasts.persistence(2), forecasts.blended(2, 2)).first()
    assert p["nbrs"][0]["ys"] == [9, 11] and p["nbrs"][0]["es"] == [2, 4] and p["pred"] == [7, 7]
    assert p["pred_ctx"] == [0.5 * 3 + 4.5, 0.5 * 7 + 5.5]
    alone = forecasts.payload(q, near.limit(0), w, forecasts.persistence(2), forecasts.blended(2, 2)).first()
    assert alone["nbrs"] == [] and alone["pred_ctx"] == alone["pred"]
    with pytest.raises(ValueError):
        forecasts.load_model("oracle")
    scaled = value(spark, forecasts.load_model("persistence", "instance", horizon=2)(array(1, 5), None))
    assert scaled == pytest.approx([5, 5])


def test_ridge(spark):
    beta = lambda rows, p, l2: adapters.ridge(rows, p, l2).first()["beta"]
    rows = spark.createDataFrame([([1.0], 1.0), ([1.0], 1.0)], "f array<double>, target double")
    assert beta(rows, 1, 1.0) == pytest.approx([0.5])
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(4, 2)), rng.normal(size=4)
    fit = lambda k: beta(spark.createDataFrame([((x[i] * k).tolist(), float(y[i] * k)) for i in range(4)], "f array<double>, target double"), 2, 0.4)
    assert fit(1) == pytest.approx(fit(100))
    with pytest.raises(ValueError):
        beta(rows, 1, -1.0)


def test_oracles_keep_vanilla_on_ties(spark):
    data = [("eval", i, 0, [0.0], y, 0.0, 1.0, p, c, []) for i, (p, c, y) in enumerate((([0.0, 2.0], [1.0, 3.0], [1.0, 2.0]), ([10.0, 10.0], [8.0, 12.0], [9.0, 10.0])))]
    out = {(r["method"], r["qt"]): r["yhat"] for r in gates.oracles(spark.createDataFrame(data, PAYLOAD)).collect()}
    assert out["oracle_context_scalar", 0] == [0, 2] and out["oracle_context_scalar", 1] == [10, 10]
    assert out["oracle_context_horizon", 0] == [1, 2] and out["oracle_context_horizon", 1] == [10, 10]


def test_gates(spark):
    ones = spark.createDataFrame([(0.0, 1.0), (1.0, 1.0)], "x double, target double")
    assert {r["score"] for r in gates.fit_gate(ones, ["x"], "classifier").score(ones).collect()} == {0.5}
    data = spark.createDataFrame([(0.0, -4.0), (0.1, -1.0), (0.9, 1.0), (1.0, 4.0)] * 5, "x double, target double")
    for objective in ("regressor", "classifier"):
        scored = gates.fit_gate(data, ["x"], objective, iterations=5).score(data).groupBy(F.col("x") > 0.5).agg(F.avg("score").alias("s")).collect()
        assert all((r["s"] > 0) == r[0] for r in scored)
    with pytest.raises(ValueError):
        gates.fit_gate(data, ["x"], "ranker")


def test_roc(spark):
    s = spark.createDataFrame([(float(v), float(v)) for v in np.linspace(-1, 1, 6)], "score double, target double")
    r = gates.roc_auc(s).first()
    assert (r["auc"], r["accuracy"], r["n"]) == (1, 1, 6)
    tied = spark.createDataFrame([(0.5, 1.0), (0.5, -1.0), (0.5, 1.0), (0.5, -1.0)], "score double, target double")
    assert gates.roc_auc(tied).first()["auc"] == 0.5
    assert gates.roc_auc(spark.createDataFrame([(0.5, 1.0)], "score double, target double")).first()["auc"] is None


def test_improvement_of_averages(spark):
    data = [("a", "1_1", "ref", 1.0), ("b", "1_1", "ref", 9.0), ("a", "1_1", "new", 0.5), ("b", "1_1", "new", 8.1), ("a", "1_1", "oracle_x", 0.1), ("b", "1_1", "oracle_x", 0.1)]
    means = spark.createDataFrame(data, "dataset string, setting string, method string, value double")
    r = report.improvements(means, "ref").where("level = 'overall' AND method = 'new'").first()
    assert r["improvement_pct"] == pytest.approx(14)
    best = {(x["dataset"], x["method"]) for x in report.best_flags(means).where("best").collect()}
    assert best == {("a", "new"), ("b", "new")}
    text = report.render(means, ["ref", "new", "gone"], "ref")
    assert r"\textbf{" in text and "--" in text and r"14.00\%" in text


def test_result_tree(spark, tmp_path):
    base = tmp_path / "solar" / "168_24"
    (base / "direct" / "naive").mkdir(parents=True)
    (base / "run1" / "baselines").mkdir(parents=True)
    (base / "run1" / "adapter").mkdir()
    (base / "direct" / "naive" / "univariate_summary.json").write_text(json.dumps({"eval": {"mse": {"mean": 2.0, "std": 1.0}}}))
    (base / "run1" / "baselines" / "baseline_metrics.json").write_text(json.dumps([{"split": "eval", "baseline": "knn", "mse": 1.0, "mae": 2.0, "nmse": 3.0}]))
    (base / "run1" / "adapter" / "eval_metrics.json").write_text(json.dumps({"adapted_mse": 4.0, "vanilla_nmse": 5.0}))
    got = {(r["dataset"], r["setting"], r["method"], r["metric"]): r["value"] for r in report.discover(spark, str(tmp_path)).collect()}
    assert got["solar", "168_24", "direct/naive", "mse"] == 2 and got["solar", "168_24", "run1/knn", "nmse"] == 3
    assert got["solar", "168_24", "run1/adapter", "mse"] == 4 and got["solar", "168_24", "run1/vanilla", "nmse"] == 5


def test_payload_round_trip_and_mixture(spark, tmp_path):
    S.write_payload(hand(spark), str(tmp_path / "p"))
    assert S.read_payload(spark, str(tmp_path / "p"), ["eval"]).count() == 1 and S.read_payload(spark, str(tmp_path / "p"), ["train"]).count() == 0
    out = hand(spark).select(mixture.identity_mixture().alias("v")).first()["v"]
    e = math.exp(-6)
    assert out == pytest.approx([(7 + e * (8 + 14)) / (1 + 3 * e)] * 2)


def test_stream(spark, tmp_path):
    from lagspark.streaming import hourly

    events = [("a", f"2024-01-01 {h:02d}:{m:02d}:00", 1.0) for h in range(6) for m in (0, 30)]
    df = spark.createDataFrame(events, "event_type string, ts string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    hourly.append_to(stream, str(tmp_path / "out"), str(tmp_path / "cp"), "1 hour").awaitTermination(120)
    closed = {r["ts"].hour: r["value"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert closed and all(v == 2.0 for v in closed.values())


def test_blocked_join_equals_join(spark):
    rng = np.random.default_rng(2)
    data = [(s, t, rng.normal(size=4).tolist()) for s in range(3) for t in range(60)]
    store = spark.createDataFrame(data, "series_id long, t long, feat array<double>")
    q = store.where("t >= 40").withColumn("split", F.lit("eval"))
    policy = retrieval.StorePolicy(3, 1, 2, 4)
    for metric in retrieval.METRICS:
        a, b = (
            {(r["qt"], r["qu"], r["rank"]): (r["nt"], r["nu"]) for r in f.collect()}
            for f in (retrieval.knn_join(q, store, policy, 3, metric), retrieval.knn_blocks(q, store, policy, 3, metric, dates=4, series=2, query_dates=3))
        )
        assert a == b and len(a) == 60 * 3
