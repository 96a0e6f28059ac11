"""Result trees written and read back, tables with levels, scales and sweeps, and CSV files from any store."""

import json
import os

import pytest
from lagspark import tables
from lagspark.operators import report
from lagspark.sources import series as S
from lagspark.sources import tables as T


@pytest.fixture(scope="module")
def means(spark):
    data = [(d, s, m, v) for d, s, vs in (("a", "2_1", (1.0, 0.5, 0.1)), ("a", "10_1", (4.0, 5.0, 0.1)), ("B", "2_1", (1000.0, 900.0, None))) for m, v in zip(("ref", "new", "oracle_x"), vs)]
    return spark.createDataFrame(data, "dataset string, setting string, method string, value double").cache()


def test_levels_beside_the_cells(means):
    rows = {(r["level"], r["dataset"], r["setting"]): r for r in report.table(means, ["new", "oracle_x", "gone"], "ref").collect()}
    assert len(rows) == 3 + 2 + 2 + 1
    assert rows["cell", "a", "2_1"]["new_pct"] == pytest.approx(50) and rows["cell", "B", "2_1"]["oracle_x_pct"] is None
    assert rows["dataset", "a", None]["new"] == pytest.approx(2.75) and rows["dataset", "a", None]["new_pct"] == pytest.approx(-10)
    # Improvement of averages, not average of improvements.
    assert rows["overall", None, None]["new_pct"] == pytest.approx((1005 - 905.5) / 1005 * 100)
    assert all(r["gone"] is None and r["gone_pct"] is None for r in rows.values())


def test_improvement_does_not_depend_on_the_order_of_sums(spark, tmp_path):
    columns = "dataset string, setting string, method string, value double"
    data = [(d, "2_1", m, v) for m, vs in (("ref", (0.1, 0.2, 0.3)), ("same", (0.3, 0.2, 0.1)), ("new", (0.1, 0.2, 0.2))) for d, v in zip("abc", vs)]
    folder = str(tmp_path)

    def turned(batches):  # in the other order each time, as fetches from several executors may come
        rows, n = list(batches), 0
        while True:
            try:
                os.close(os.open(f"{folder}/{n}", os.O_CREAT | os.O_EXCL))
                break
            except FileExistsError:
                n += 1
        for b in rows[:: 1 - n % 2 * 2]:
            yield b.take(list(range(b.num_rows))[:: 1 - n % 2 * 2])

    some = spark.createDataFrame(data, columns).coalesce(1).mapInArrow(turned, columns)
    # 0.1 + 0.2 + 0.3 is more than 0.3 + 0.2 + 0.1: a reference summed twice would improve on itself and come twice.
    for _ in range(2):
        overall = {r["method"]: r["improvement_pct"] for r in report.improvements(some, "ref").where("level = 'overall'").collect()}
        assert overall["ref"] == 0 and abs(overall["same"]) < 1e-9 and overall["new"] == pytest.approx(100 / 6)
        for rows in (some, spark.createDataFrame(data, columns).coalesce(1)):
            assert sorted(r["method"] for r in report.positive_only(rows, "ref").collect()) == ["new"] * 3 + ["ref"] * 3
        some.count()


def test_rendered_table(means):
    names = report.column_order(["oracle_x", "new", "Zed", "ref"], "ref")
    assert names == ["ref", "new", "Zed", "oracle_x"]
    text = report.render(means, names, "ref", scales={"B": 2, "a/10_1": 1}, levels=("dataset", "overall")).split("\n")
    lines = [x for x in text if "&" in x]
    assert lines[1].startswith("a & 2\\_1 &") and lines[2].startswith("a & 10\\_1 ($10^{1}$) & \\textbf{0.40} & 0.50") and lines[3].startswith("B & 2\\_1 ($10^{2}$) & 10.00 & \\textbf{9.00} & -- & --")
    assert lines[4].startswith("Dataset & a & 0.00\\% & -10.00\\%") and lines[6].startswith("Overall &  & 0.00\\% & 9.90\\%")


def test_tree_and_commands(spark, tmp_path):
    scores = spark.createDataFrame([("solar", s, "eval", m, v, v, v) for s, m, v in (("2_1", "knn", 1.0), ("2_1", "ridge", 2.0), ("4_1", "knn", 3.0))], "dataset string, setting string, split string, method string, mse double, mae double, nmse double")
    report.write_metrics(scores, str(tmp_path), "run1")
    assert json.loads((tmp_path / "solar" / "2_1" / "run1" / "baselines" / "baseline_metrics.json").read_text())[0]["baseline"] == "knn"
    found = {(r["setting"], r["method"], r["metric"]): r["value"] for r in report.discover(spark, str(tmp_path)).collect()}
    assert found["2_1", "run1/ridge", "mae"] == 2 and len(found) == 9
    o = tables.parse([str(tmp_path), "--reference", "run1/ridge", "--scales", "solar=1", "--levels", "setting"])
    assert o.scales == {"solar": 1} and "0.10" in open(tables.write_table(spark, o)).read()
    sweep = tables.parse([str(tmp_path), "--methods", "knn", "ridge", "--runs", "run1", "run2", "--reference-value", "2"])
    text = open(tables.write_table(spark, sweep)).read()
    assert "sweep" in tables.write_table(spark, sweep) and r"\textbf{2.00} (0.00\%) & --" in text
    for wrong in (["--scales", "solar"], ["--runs", "run1"]):
        with pytest.raises(SystemExit):
            tables.parse([str(tmp_path), *wrong])


def test_csv_of_parts_is_read_by_its_header(spark, tmp_path):
    rows = [(f"2024-01-01 0{h}:00:00", float(h), None if h == 2 else 1.0, h) for h in range(4)]
    spark.createDataFrame(rows, "when string, a double, b double, `c d` int").repartition(3).write.csv(str(tmp_path / "x.csv"), header=True)
    (tmp_path / "config.json").write_text('{"date_col": "when", "target_cols": ["c d", "a"]}')
    wide = S.read_wide(spark, str(tmp_path / "x.csv"), "when", ["a"])
    plan = wide._jdf.queryExecution().toString()
    assert "c d" not in plan.split("ReadSchema")[1] and dict(wide.dtypes) == {"ts": "timestamp", "a": "double"}
    out = S.load_csv(spark, f"file://{tmp_path}")
    assert sorted((r["t"], r["series_id"], r["series_name"], r["value"]) for r in out.collect()) == sorted([(t, 0, "c d", float(h)) for t, h in enumerate((0, 1, 3))] + [(t, 1, "a", float(h)) for t, h in enumerate((0, 1, 3))])
    with pytest.raises(KeyError):
        S.read_wide(spark, str(tmp_path / "x.csv"), "date")
    assert T.list_names(spark, str(tmp_path)) == ["config.json", "x.csv"] and T.list_names(spark, str(tmp_path / "none")) == []
