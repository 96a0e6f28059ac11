"""Registered queries against DuckDB on the smallest tables."""

import os

import duckdb
import numpy as np
import pytest
from lagspark.operators import gates
from lagspark.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
def rows(df):
    c = sorted(df.columns)
    return sorted(tuple("" if v is None or v != v else f"{v:.5g}" if isinstance(v, float) else str(v) for v in r) for r in df[c].itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("events", "orders", "lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", [n for n in sorted(registry.oracle_sql()) if not n.endswith("_all")])
def test_query_equals_sql(spark, con, name):
    want = con.execute(registry.oracle_sql()[name]).df()
    got = registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want) == rows(got)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_window_queries_take_every_window(spark):
    v = registry.series(spark, SF).toPandas().pivot(index="t", columns="series_id", values="value").sort_index()
    starts = {(u, t) for u in v.columns for t in range(len(v) - registry.LAGS - registry.HORIZON + 1)}
    u, t = max(starts)
    x = v[u].to_numpy()[t : t + registry.LAGS]
    y = v[u].to_numpy()[t + registry.LAGS : t + registry.LAGS + registry.HORIZON]
    z = (x - x.mean()) / (x.std() + 1e-8)
    trend = np.convolve(np.pad(x, 2, mode="edge"), np.ones(5) / 5, "valid")
    patch = [np.pad(x, (0, 8), mode="edge")[i : i + 16] for i in range(0, 41, 8)]
    basis = np.cos(np.outer(np.arange(48), np.arange(8)) * np.pi / 48)
    want = {"window_extract_all": {"x": x, "y": y}, "instance_norm_all": {"feat": z}, "patch_unfold_all": {"v": np.concatenate(patch)}, "moving_average_all": {"trend": trend, "residual": x - trend},
            "fourier_features": {"feat": np.abs(np.fft.fft(z))}, "encoder_features": {"feat": x @ basis}}
    for name, columns in want.items():
        out = registry.queries()[name](spark, SF).cache()
        assert {tuple(r) for r in out.select("series_id", "t").distinct().collect()} == starts, name
        one = out.where(f"series_id = {u} AND t = {t}").toPandas()
        one = one.sort_values([c for c in ("patch", "i") if c in one])
        for column, values in columns.items():
            got = np.array(one[column][0] if name == "encoder_features" else one[column].dropna(), float)
            assert got.shape == values.shape and np.allclose(got, values, atol=1e-5), (name, column)
        out.unpersist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_boosted_gates_fit_all_rounds_and_steps(spark, monkeypatch):
    fits = []

    def fit(rows, features, objective="regressor", target="target", iterations=300, rate=0.03, depth=4, seed=1):
        fits.append((objective, target, iterations, rate))
        return gates.Gate(constant=1.0)

    monkeypatch.setattr(gates, "fit_gate", fit)
    methods = {r["method"] for r in registry.queries()["boosted_gates"](spark, SF).collect()}
    assert {f"boosted_context_{o}_{k}" for o in ("regressor", "classifier") for k in ("scalar", "horizon")} <= methods
    assert len(fits) == 2 * (1 + registry.HORIZON) and {f[2:] for f in fits} == {(300, 0.03)}


def test_entry_point_lists_everything():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and "knn_euclidean" in names
