"""Run folders: the prediction table of a run beside what adapters, gates and training have made of it.

A run is a folder of Parquet tables:

* predictions/ – the prediction table, by split;
* SOURCE/forecasts/ – (split, method, qt, qu, yhat) of adapters or gates, by split;
* SOURCE/gates/ – (split, gate, qt, qu, score), by split;
* SOURCE/history/ – (round, metric, value) of a training.

load() puts the sources together in the order of their names given: of a method or gate that
several sources have in a split, the last one's rows stand, all of them. What it gives is
aligned: a method has one forecast of the table's horizon for each of the split's queries.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagspark.functions import arrays as A
from lagspark.sources import tables as T

from .payloads import KEYS
from .windows import SPLITS

#: Sources in the order in which they are merged, and the one whose forecasts are optional beside them.
SOURCES, ADAPTER = ("baseline_adapters", "baselines", "gates"), "adapter"
FORECASTS = "split string, method string, qt long, qu long, yhat array<double>"
GATES = "split string, gate string, qt long, qu long, score double"
HISTORY = "source string, round long, metric string, value double"


@dataclass
class Run:
    """A loaded run; a part that no source has is an empty table."""

    payload: DataFrame
    forecasts: DataFrame
    gates: DataFrame
    history: DataFrame

    def joined(self) -> DataFrame:
        """(split, method, qt, qu, y, sd, yhat): every forecast with its target, the plain and the context forecast among them."""
        known = self.payload.select(*KEYS, "y", "sd", F.explode(F.map_from_arrays(F.array(F.lit("vanilla"), F.lit("context_forecast")), F.array("pred", "pred_ctx"))).alias("method", "yhat"))
        more = self.forecasts.where(~F.col("method").isin("vanilla", "context_forecast")).join(self.payload.select(*KEYS, "y", "sd"), list(KEYS))
        return known.unionByName(more)


def save(root: str, payload: DataFrame | None = None, source: str | None = None, forecasts: DataFrame | None = None, gates: DataFrame | None = None, history: DataFrame | None = None) -> None:
    """Write the prediction table of a run, or tables of one of its sources; each replaces what is there."""
    if payload is not None:
        payload.write.mode("overwrite").partitionBy("split").parquet(f"{root}/predictions")
    for name, rows, kind in (("forecasts", forecasts, FORECASTS), ("gates", gates, GATES), ("history", history, HISTORY)):
        if rows is None:
            continue
        if source is None:
            raise ValueError(f"{name} belong to a source")
        names = [c.split()[0] for c in kind.split(", ")]
        rows = rows.select(*[c for c in names if c != "source"])
        (rows.write.mode("overwrite").partitionBy("split") if "split" in names else rows.write.mode("overwrite")).parquet(f"{root}/{source}/{name}")


def last_wins(tables: list[DataFrame], by: Iterable[str]) -> DataFrame:
    """The rows of several tables; of those with equal values of by the last table's only, all of them.

    Tables are ranked by one row a table and value, so no row is shuffled to find the winners.
    """
    by = list(by)
    rows = reduce(DataFrame.unionByName, [t.withColumn("__order", F.lit(i)) for i, t in enumerate(tables)])
    last = rows.groupBy(*by).agg(F.max("__order").alias("__order"))
    return rows.join(last, [*by, "__order"], "left_semi").drop("__order")


def load(spark: SparkSession, root: str, splits: Iterable[str] | None = None, sources: Iterable[str] = SOURCES, adapter: str = ADAPTER) -> Run:
    """The run under root, restricted to the splits that are there (an error if none is), checked by check().

    Sources without a folder are passed over. Only folders of the wanted splits are read.
    """
    if not T.exists(spark, f"{root}/predictions/_SUCCESS"):
        raise FileNotFoundError(f"no predictions under {root}")
    wanted = list(SPLITS if splits is None else splits)
    payload = spark.read.parquet(f"{root}/predictions").where(F.col("split").isin(wanted))
    if payload.isEmpty():
        raise ValueError(f"no split of {', '.join(wanted)} is available under {root}")
    there = [s for s in dict.fromkeys((*sources, adapter)) if T.exists(spark, f"{root}/{s}")]

    def merged(name: str, key: str, kind: str) -> DataFrame:
        paths = [f"{root}/{s}/{name}" for s in there if T.exists(spark, f"{root}/{s}/{name}/_SUCCESS")]
        if not paths:
            return spark.createDataFrame([], kind)
        columns = [c.split()[0] for c in kind.split(", ")]
        return last_wins([spark.read.parquet(p).where(F.col("split").isin(wanted)).select(*columns) for p in paths], ("split", key))

    parts = [spark.read.parquet(f"{root}/{s}/history").withColumn("source", F.lit(s)) for s in there if T.exists(spark, f"{root}/{s}/history/_SUCCESS")]
    empty = spark.createDataFrame([], HISTORY)
    run = Run(payload, merged("forecasts", "method", FORECASTS), merged("gates", "gate", GATES), reduce(DataFrame.unionByName, parts, empty))
    check(run)
    return run


def alignment(run: Run) -> DataFrame:
    """(kind, split, name, n, odd): the distinct queries that a method or gate has, and its rows that repeat a query, lack one or are of another length.

    One join by key; a few numbers a method come out of it.
    """
    of = lambda rows, kind, name, size: rows.select(F.lit(kind).alias("kind"), F.col(name).alias("name"), *KEYS, size.alias("size"))
    rows = of(run.forecasts, "forecast", "method", F.size("yhat")).unionByName(of(run.gates, "gate", "gate", F.lit(None).cast("int")))
    keyed = rows.groupBy("kind", "name", *KEYS).agg(F.count("*").alias("c"), F.min("size").alias("lo"), F.max("size").alias("hi"))
    joined = keyed.join(run.payload.select(*KEYS, F.size("y").alias("h")), list(KEYS), "left")
    wrong = F.col("h").isNull() | (F.col("c") > 1) | F.coalesce((F.col("lo") != F.col("h")) | (F.col("hi") != F.col("h")), F.lit(False))
    return joined.groupBy("kind", "split", "name").agg(F.count_if(F.col("h").isNotNull()).alias("n"), F.count_if(wrong).alias("odd"))


def check(run: Run) -> None:
    """An error that names the methods and gates which do not match the prediction table."""
    sizes = run.payload.groupBy("split").agg(F.count("*").alias("size"))
    bad = alignment(run).join(sizes, "split", "left").where("odd > 0 OR size IS NULL OR n <> size").orderBy("kind", "split", "name").limit(20).collect()
    if bad:
        raise ValueError("not aligned with the predictions: " + ", ".join(f"{r['kind']} {r['name']} of {r['split']}" for r in bad))


def gate_shares(run: Run) -> DataFrame:
    """(split, gate, n, taken_pct, right_pct): how often a gate's score takes the context forecast, and how often that is right; ties of the forecasts don't count."""
    base, ctx = A.mse("pred", "y"), A.mse("pred_ctx", "y")
    rows = run.gates.join(run.payload.select(*KEYS, base.alias("base"), ctx.alias("ctx")), list(KEYS))
    takes = F.col("score") > 0
    right = F.when(F.abs(F.col("ctx") - F.col("base")) > 1e-12, ((F.col("ctx") < F.col("base")) == takes).cast("double"))
    return rows.groupBy("split", "gate").agg(F.count("*").alias("n"), (F.avg(takes.cast("double")) * 100).alias("taken_pct"), (F.avg(right) * 100).alias("right_pct"))
