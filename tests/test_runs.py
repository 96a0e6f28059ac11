"""Run folders written and loaded, what they refuse, and the views of errors."""

import numpy as np
import pytest
from lagspark.operators import batches, metrics, retrieval, runs
from pyspark.sql import functions as F

PAYLOAD = "split string, qt long, qu long, y array<double>, sd double, pred array<double>, pred_ctx array<double>"


@pytest.fixture(scope="module")
def payload(spark):
    data = [(s, t, u, [1.0 + t, 2.0], 2.0, [1.0, 1.0], [2.0, 1.5 + u]) for s in ("train", "eval") for t in range(3) for u in range(2)]
    return spark.createDataFrame(data, PAYLOAD)


def of(payload, method, value):
    return payload.select("split", F.lit(method).alias("method"), "qt", "qu", F.array(F.lit(value), F.lit(value)).alias("yhat"))


def score(payload, gate, value):
    return payload.select("split", F.lit(gate).alias("gate"), "qt", "qu", F.lit(value).alias("score"))


def test_later_sources_replace_a_method_of_a_split(spark, payload, tmp_path):
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        runs.load(spark, root)
    runs.save(root, payload)
    bare = runs.load(spark, root)
    assert bare.forecasts.count() == bare.gates.count() == bare.history.count() == 0
    assert {r["method"] for r in bare.joined().collect()} == {"vanilla", "context_forecast"}
    runs.save(root, source="baselines", forecasts=of(payload, "a", 1.0).unionByName(of(payload, "b", 2.0)), gates=score(payload, "g", -1.0))
    history = spark.createDataFrame([(0, "loss", 3.0), (1, "loss", 2.0)], "round long, metric string, value double")
    runs.save(root, source="gates", forecasts=of(payload, "a", 9.0).where("split = 'eval'"), gates=score(payload, "g", 1.0).where("split = 'eval'"))
    runs.save(root, source="adapter", forecasts=of(payload, "adapted", 4.0).where("split = 'eval'"), history=history)
    run = runs.load(spark, root)
    found = {(r["split"], r["method"]): r["v"] for r in run.forecasts.groupBy("split", "method").agg(F.avg(F.col("yhat")[0]).alias("v")).collect()}
    assert found == {("train", "a"): 1.0, ("train", "b"): 2.0, ("eval", "b"): 2.0, ("eval", "a"): 9.0, ("eval", "adapted"): 4.0}
    assert run.joined().count() == 2 * 12 + 6 * 5
    shares = {r["split"]: r for r in runs.gate_shares(run).collect()}
    assert shares["eval"]["taken_pct"] == 100 and shares["train"]["taken_pct"] == 0
    assert [tuple(r) for r in run.history.orderBy("round").collect()] == [("adapter", 0, "loss", 3.0), ("adapter", 1, "loss", 2.0)]
    only = runs.load(spark, root, splits=["train"])
    assert {r["split"] for r in only.joined().select("split").distinct().collect()} == {"train"}
    with pytest.raises(ValueError, match="no split"):
        runs.load(spark, root, splits=["oracle"])
    with pytest.raises(ValueError, match="source"):
        runs.save(root, history=history)


@pytest.mark.parametrize("spoil", ["short", "lacking", "twice", "strange", "gate"])
def test_misaligned_runs_are_refused(spark, payload, tmp_path, spoil):
    root, good = str(tmp_path), of(payload, "a", 1.0)
    bad = {
        "short": good.withColumn("yhat", F.slice("yhat", 1, 1)),
        "lacking": good.where("NOT (split = 'eval' AND qt = 2 AND qu = 1)"),
        "twice": good.unionByName(good.where("split = 'eval' AND qt = 2 AND qu = 1")),
        "strange": good.withColumn("qt", F.when((F.col("split") == "eval") & (F.col("qt") == 2), 77).otherwise(F.col("qt"))),
        "gate": good,
    }[spoil]
    runs.save(root, payload)
    runs.save(root, source="baselines", forecasts=bad, gates=score(payload, "g", 1.0).where("qu = 0") if spoil == "gate" else None)
    with pytest.raises(ValueError, match="gate g of eval" if spoil == "gate" else "forecast a of eval"):
        runs.load(spark, root)


def test_views_equal_plain_numbers(spark):
    rng = np.random.default_rng(5)
    y, a, b = rng.normal(size=(3, 4, 6))
    a[0, 0] = np.nan
    data = [("eval", m, q, 0, y[q].tolist(), 0.5 + q, v[q].tolist()) for m, v in (("new", a), ("ref", b)) for q in range(4)]
    rows = spark.createDataFrame(data, "split string, method string, qt long, qu long, y array<double>, sd double, yhat array<double>")
    sd = np.array([0.5 + q for q in range(4)])[:, None]
    errors = lambda v: {"difference": v - y, "mse": (v - y) ** 2, "nmse": ((v - y) / sd) ** 2}
    for by, axis, key in (("h", 0, "h"), ("window", 1, "qt")):
        got = {(r["metric"], r[key]): r for r in metrics.views(rows, "ref", by).where("method = 'new'").collect()}
        for metric in metrics.ERRORS:
            one, ref = np.nanmean(errors(a)[metric], axis=axis), np.nanmean(errors(b)[metric], axis=axis)
            for i in range(len(one)):
                r = got[metric, i]
                assert np.allclose([r["direct"], r["improvement"], r["relative"]], [one[i], one[i] - ref[i], (one[i] - ref[i]) / ref[i]]), (by, metric, i)
    means = {r["metric"]: r for r in metrics.view_averages(rows, "ref").where("method = 'new'").collect()}
    one, ref = (np.nanmean(errors(v)["mse"], axis=1) for v in (a, b))
    assert np.isclose(means["mse"]["window_relative"], ((one - ref) / ref).mean())
    same = metrics.views(rows, "ref").where("method = 'ref' AND metric = 'mse'").collect()
    assert all(r["improvement"] == 0 and r["relative"] == 0 for r in same)
    with pytest.raises(ValueError):
        metrics.views(rows, "ref", "month")


def test_batches_come_back_and_lose_the_same(spark):
    nbrs = [(1, 7.0, [3.0, 5.0], [1.0, -1.0])]
    data = [("eval", 0, 0, [1.0, 3.0], [2.0, 6.0], 2.0, 0.5, [1.0, 1.0], [4.0, 2.0], nbrs), ("eval", 1, 0, [5.0, 5.0], [5.0, 6.0], 5.0, 0.0, [5.0, 5.0], [5.0, 7.0], [])]
    kind = "x array<double>, y array<double>, mu double, sd double, pred array<double>, pred_ctx array<double>, nbrs array<struct<rank:long, sd:double, ys:array<double>, es:array<double>>>"
    rows = spark.createDataFrame(data, f"split string, qt long, qu long, {kind}")
    made = batches.prepare(rows).orderBy("qt").collect()
    assert made[0]["x"] == [-2.0, 2.0] and made[0]["y"] == [0.0, 8.0] and made[0]["loss_scale"] == 1.0
    assert tuple(made[0]["nbrs"][0]) == (1, 7.0, [2.0, 6.0], [2.0, -2.0]) and made[1]["nbrs"] == []
    assert np.isclose(made[1]["y"][1], 1e8)  # a flat lookback: the deviation is clamped
    back = batches.restore(batches.prepare(rows), ["x", "y", "pred", "pred_ctx"]).orderBy("qt").collect()
    for r, want in zip(back, data):
        assert all(np.allclose(r[c], want[i]) for c, i in (("x", 3), ("y", 4), ("pred", 7), ("pred_ctx", 8)))
    losses = [[r["l"] for r in batches.prepare(rows, how).select("qt", batches.loss("pred").alias("l")).orderBy("qt").collect()] for how in batches.NORMALISATIONS]
    assert np.allclose(*losses) and np.isclose(losses[0][0], ((1 / 0.5) ** 2 + (5 / 0.5) ** 2) / 2)
    raw = batches.restore(batches.prepare(rows, "none"), ["pred"], "none")
    assert raw.drop("loss_scale").exceptAll(rows).isEmpty()
    for f in (lambda: batches.prepare(rows, "batch"), lambda: batches.restore(rows, ["pred"], "batch")):
        with pytest.raises(ValueError):
            f()


@pytest.mark.parametrize("wrong", [{"max_dates": 0}, {"max_windows": -1}, {"min_dates": -1}, {"n_series": 0}, {"history_start": 9, "history_end": 9}, {"min_dates": 3, "max_dates": 2},
                                   {"online": False, "store_start": 5, "store_end": 5}, {"stride": 0}, {"period": 5}])
def test_store_policies_are_checked(wrong):
    with pytest.raises(ValueError):
        retrieval.StorePolicy(**{"lags": 4, "horizon": 2, "period": 4, "stride": 8} | wrong)
