"""Splits, windows, window features and array reshaping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagspark.functions import arrays as A

RATIOS = (0.3, 0.35, 0.15, 0.2)
SPLITS = ("train", "oracle", "eval")
#: Positions of a series that one task cuts into windows.
CHUNK = 8192


def parse_ratios(text: str | tuple) -> tuple[float, ...]:
    """Four ratios that sum to 1."""
    values = tuple(float(x) for x in (text.split(",") if isinstance(text, str) else text))
    if len(values) != 4 or abs(sum(values) - 1) > 1e-6:
        raise ValueError("four ratios that sum to 1 are needed")
    return values


def split_bounds(n: int, ratios=RATIOS) -> tuple[int, int, int, int]:
    """Ends of the four periods: cumulative ratios of n, halves to even."""
    a, b, c, _ = parse_ratios(ratios)
    return round(n * a), round(n * (a + b)), round(n * (a + b + c)), n


def bounds_table(series: DataFrame, ratios=RATIOS) -> DataFrame:
    """One row with the four ends, in Spark: bround is half-even like the driver's rule."""
    a, b, c, _ = parse_ratios(ratios)
    n = series.agg((F.max("t") + 1).alias("n"))
    end = lambda r: F.bround(F.col("n") * F.lit(float(r)), 0).cast("long")
    return n.select(end(a).alias("t0_end"), end(a + b).alias("t1_end"), end(a + b + c).alias("t2_end"), F.col("n").cast("long").alias("t3_end"))


def windows(series: DataFrame, lags: int, horizon: int, chunk: int = CHUNK) -> DataFrame:
    """(series_id, t, x, y) for every start with a whole window: one shuffle, by series and time chunk.

    Positions t are dense. A chunk also gets the first rows of the next one, which its last
    windows reach into, so a long series is many tasks.
    """
    span = lags + horizon
    chunk = max(chunk, span)
    own, place = F.floor(F.col("t") / chunk), F.pmod("t", F.lit(chunk))
    chunks = F.when(place < span - 1, F.array(own, own - 1)).otherwise(F.array(own))
    rows = series.select("series_id", "t", "value", F.explode(chunks).alias("__chunk"))
    w = Window.partitionBy("series_id", "__chunk").orderBy("t").rowsBetween(0, span - 1)
    found = rows.select("series_id", "t", "__chunk", F.collect_list("value").over(w).alias("v"))
    found = found.where((F.size("v") == span) & (F.col("__chunk") == own))
    return found.select("series_id", "t", F.slice("v", 1, lags).alias("x"), F.slice("v", lags + 1, horizon).alias("y"))


def placed(rows: DataFrame, stride: int, dates: int) -> DataFrame:
    """rows with the cell (phase, chunk) of a stored table: start modulo stride, and stretch of stride * dates starts."""
    return rows.withColumns({"phase": F.pmod("t", F.lit(stride)).cast("int"), "chunk": F.floor(F.col("t") / (stride * dates)).cast("int")})


def with_stats(rows: DataFrame, x: str = "x") -> DataFrame:
    """mu and sd (population) of the lookback."""
    return rows.withColumns({"mu": A.mean(x), "sd": A.std(x)})


def features(rows: DataFrame, space: str = "instance", lags: int | None = None) -> DataFrame:
    """feat: raw lookbacks, instance-normalised ones, or Fourier magnitudes of these (lags: their length)."""
    if space == "raw":
        return rows.withColumn("feat", F.col("x"))
    rows = rows if "mu" in rows.columns else with_stats(rows)
    rows = rows.withColumn("feat", A.instance_normal("x", "mu", "sd"))
    if space == "instance":
        return rows
    if space == "fourier":
        if not lags:
            raise ValueError("the Fourier space needs the number of lags")
        return rows.withColumn("feat", _magnitudes("feat", lags))
    raise ValueError(f"unknown space {space}")


def _magnitudes(column: str, n: int):
    """|DFT| of an array of n: products with a constant basis for half the frequencies, the others mirror them."""
    angle = 2 * np.pi / n * np.outer(np.arange(n // 2 + 1), np.arange(n))
    numbers = lambda row: F.array(*[F.lit(float(v)) for v in row])
    basis = F.array(*[F.struct(numbers(c).alias("c"), numbers(s).alias("s")) for c, s in zip(np.cos(angle), np.sin(angle))])
    half = F.transform(basis, lambda b: F.sqrt(F.pow(A.dot(column, b["c"]), F.lit(2.0)) + F.pow(A.dot(column, b["s"]), F.lit(2.0))))
    # Frequency n - f has the magnitude of f.
    return F.concat(half, F.reverse(F.slice(half, 2, (n - 1) // 2)))


def query_starts(rows: DataFrame, splits: str | tuple[str, ...], bounds: tuple[int, int, int, int], lags: int, horizon: int, stride: int, cell: int | None = None) -> DataFrame:
    """Windows that lie whole in a split's period, every stride positions from its start, with their split.

    Periods follow each other, so a window is in one split at most and all splits are one
    scan. cell is the length in positions of a stored table's chunks: other folders are not read.
    """
    splits = (splits,) if isinstance(splits, str) else tuple(splits)
    if not splits or not set(splits) <= set(SPLITS):
        raise ValueError(f"unknown split among {splits}")
    if stride <= 0:
        raise ValueError("a stride is positive")
    t, name, chunks = F.col("t"), F.lit(None).cast("string"), F.lit(False)
    for split in splits:
        at = SPLITS.index(split)
        lo, hi = bounds[at], bounds[at + 1] - lags - horizon
        name = F.when((t >= lo) & (t <= hi) & ((t - lo) % stride == 0), split).otherwise(name)
        if cell:
            chunks = chunks | F.col("chunk").between(lo // cell, max(lo, hi) // cell)
    first, last = min(bounds[SPLITS.index(s)] for s in splits), max(bounds[SPLITS.index(s) + 1] for s in splits)
    rows = rows.where(t.between(first, last))
    return (rows.where(chunks) if cell else rows).withColumn("split", name).where("split IS NOT NULL")


def patches(rows: DataFrame, length: int, step: int, x: str = "x") -> DataFrame:
    """patches: sub-windows of x, the end padded by repeating the last value step times."""
    padded = F.concat(F.col(x), F.array_repeat(F.element_at(x, -1), step))
    count = F.floor((F.size(x) + step - length) / F.lit(step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), count), lambda i: F.slice(padded, i * step + 1, F.lit(length)))
    return rows.withColumn("patches", cut)


def moving_average(rows: DataFrame, width: int, x: str = "x") -> DataFrame:
    """trend (centred mean over an edge-padded lookback) and residual = x - trend."""
    if width % 2 == 0:
        raise ValueError("the width is odd")
    half = (width - 1) // 2
    padded = F.concat(F.array_repeat(F.col(x)[0], half), F.col(x), F.array_repeat(F.element_at(x, -1), half))
    trend = F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: A.total(F.slice(padded, i, F.lit(width))) / width)
    return rows.withColumn("trend", trend).withColumn("residual", F.zip_with(x, "trend", lambda a, b: a - b))


def embed(rows: DataFrame, model, column: str = "feat", x: str = "x") -> DataFrame:
    """Encoder space: model maps a matrix of lookbacks to one of embeddings, a batch at a time."""
    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(list(np.asarray(model(np.stack(v.to_list())), float))) if len(v) else pd.Series([], dtype=object)

    return rows.withColumn(column, run(x))


__all__ = ["bounds_table", "embed", "features", "moving_average", "parse_ratios", "patches", "query_starts", "split_bounds", "windows", "with_stats"]
