"""Result tables from a result tree: python -m lagspark.tables ROOT [options] writes LaTeX."""

from __future__ import annotations

import argparse
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from lagspark.operators import report


@dataclass
class Options:
    root: str
    metric: str = "mse"
    split: str = "eval"
    reference: str = "direct/persistence"
    datasets: list[str] = field(default_factory=list)
    settings: list[str] = field(default_factory=list)
    methods: list[str] = field(default_factory=list)
    per_dataset: dict[str, list[str]] = field(default_factory=dict)
    positive_only: bool = False
    higher_is_better: bool = False
    decimals: int = 2
    scales: dict[str, int] = field(default_factory=dict)
    levels: list[str] = field(default_factory=lambda: ["overall"])
    runs: list[str] = field(default_factory=list)
    reference_value: float | None = None
    out: str = ""


def parse(arguments: list[str] | None = None) -> Options:
    p = argparse.ArgumentParser(description="Write a result table as LaTeX.")
    p.add_argument("root")
    p.add_argument("--metric", default=Options.metric)
    p.add_argument("--split", default=Options.split)
    p.add_argument("--reference", default=Options.reference)
    for name in ("datasets", "settings", "methods"):
        p.add_argument(f"--{name}", nargs="*", default=[])
    p.add_argument("--dataset-settings", nargs="*", default=[], metavar="DATASET=SETTING,SETTING", help="settings of one dataset in place of the global ones")
    p.add_argument("--positive-only", action="store_true")
    p.add_argument("--higher-is-better", action="store_true")
    p.add_argument("--decimals", type=int, default=Options.decimals)
    p.add_argument("--scales", nargs="*", default=[], metavar="DATASET[/SETTING]=EXPONENT", help="power of ten of some rows, in place of the median's")
    p.add_argument("--levels", nargs="*", default=["overall"], choices=["dataset", "setting", "overall"], help="improvement rows")
    p.add_argument("--runs", nargs="*", default=[], help="write the matrix of a sweep over these runs; --methods are then its variants")
    p.add_argument("--reference-value", type=float, help="what a sweep's improvements are against")
    p.add_argument("--out", default="")
    a = vars(p.parse_args(arguments))
    scales = {}
    for item in a.pop("scales"):
        name, _, exponent = item.rpartition("=")
        if not name or not exponent.lstrip("-").isdigit():
            p.error(f"{item!r} is not DATASET[/SETTING]=EXPONENT")
        scales[name] = int(exponent)
    if a["runs"] and (a["reference_value"] is None or not a["methods"]):
        p.error("a sweep needs --methods and --reference-value")
    own = {}
    for item in a.pop("dataset_settings"):
        name, _, some = item.partition("=")
        if not name or not some:
            p.error(f"{item!r} is not DATASET=SETTING,SETTING")
        own[name] = some.split(",")
    return Options(**a, per_dataset=own, scales=scales)


def means_of(spark: SparkSession, o: Options) -> DataFrame:
    """The averaged records that an options object selects."""
    records = report.discover(spark, o.root)
    means = report.averaged(report.filtered(records, o.metric, o.split, o.datasets, o.settings, o.per_dataset, o.methods))
    return report.positive_only(means, o.reference, o.higher_is_better) if o.positive_only else means


def write_table(spark: SparkSession, o: Options) -> str:
    """Write the table's LaTeX to o.out, or to results_<metric>.tex under the root; the driver holds its cells only."""
    means = means_of(spark, o)
    if o.runs:
        matrix = report.sweep_matrix(means, o.methods, o.runs, o.reference_value, o.higher_is_better)
        path = o.out or os.path.join(o.root, f"sweep_{o.metric.lower()}.tex")
        return _write(path, report.render_sweep(matrix, o.methods, o.runs, o.decimals, f"{o.metric} on {o.split}", f"tab:sweep-{o.metric.lower()}", o.higher_is_better))
    names = report.column_order([r["method"] for r in means.select("method").distinct().collect()], o.reference)  # column heads
    if not names:
        raise ValueError(f"no results under {o.root} match")
    path = o.out or os.path.join(o.root, f"results_{o.metric.lower()}.tex")
    text = report.render(means, names, o.reference, o.decimals, f"{o.metric} on {o.split}", f"tab:{o.metric.lower()}", o.higher_is_better, o.scales, tuple(o.levels))
    return _write(path, text)


def _write(path: str, text: str) -> str:
    with open(path, "w", encoding="utf-8") as file:
        file.write(text + "\n")
    return path


def main(arguments: list[str] | None = None) -> None:
    spark = SparkSession.builder.appName("result tables").getOrCreate()
    print(write_table(spark, parse(arguments)))


if __name__ == "__main__":
    main()
