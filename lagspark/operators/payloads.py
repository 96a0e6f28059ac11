"""Prediction tables as inputs: validation, sampling, merging, labels and optional columns.

Checks of shapes are one aggregation over sizes; no check collects rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lagspark.functions import arrays as A
from lagspark.sources.tables import numbered

from .windows import SPLITS

KEYS = ("split", "qt", "qu")
#: Columns of a prediction table that every consumer needs.
REQUIRED = (*KEYS, "x", "y", "mu", "sd", "pred", "pred_ctx", "nbrs")


def missing_splits(payload: DataFrame, required: Iterable[str] = SPLITS) -> DataFrame:
    """(split): the required splits that no row has."""
    wanted = payload.sparkSession.createDataFrame([(s,) for s in required], "split string")
    return wanted.exceptAll(payload.select("split").distinct())


def require_splits(payload: DataFrame, required: Iterable[str] = SPLITS) -> DataFrame:
    """payload restricted to the required splits; an error names those that it lacks, or that do not exist."""
    required = list(required)
    unknown = [s for s in required if s not in SPLITS]
    if unknown:
        raise ValueError(f"unknown splits {', '.join(unknown)}")
    lacking = [r["split"] for r in missing_splits(payload, required).collect()]  # a few names
    if lacking:
        raise ValueError(f"the payload lacks the splits {', '.join(sorted(lacking))}")
    return payload.where(F.col("split").isin(required))


def shapes(payload: DataFrame) -> DataFrame:
    """(split, n, lags, horizon, k) with the array lengths of each split; a length that varies is -1."""
    one = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise(-1).cast("long")
    return payload.groupBy("split").agg(F.count("*").alias("n"), one(F.size("x")).alias("lags"), one(F.size("y")).alias("horizon"), one(F.size("nbrs")).alias("k"))


def validate(payload: DataFrame, required: Iterable[str] = SPLITS) -> DataFrame:
    """shapes(), after checking columns, splits, lengths, neighbours and that all splits agree."""
    lacking = [c for c in REQUIRED if c not in payload.columns]
    if lacking:
        raise ValueError(f"the payload lacks the columns {', '.join(lacking)}")
    payload = require_splits(payload, required)
    h = F.size("y")
    odd = (F.size("pred") != h) | (F.size("pred_ctx") != h) | F.exists("nbrs", lambda n: (F.size(n["ys"]) != h) | (F.size(n["es"]) != h))
    by_key = payload.groupBy(*KEYS).agg(F.count("*").alias("c"), F.count_if(F.coalesce(odd, F.lit(True))).alias("o"))
    bad = by_key.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("twice")).first()
    if bad["n"]:
        raise ValueError(f"{bad['n']} rows hold arrays of unequal horizons")
    if bad["twice"]:
        raise ValueError(f"{bad['twice']} rows repeat a key")
    table = shapes(payload)
    seen = table.agg(*[F.min(c).alias(f"lo_{c}") for c in ("lags", "horizon", "k")], *[F.max(c).alias(f"hi_{c}") for c in ("lags", "horizon", "k")]).first()
    for c in ("lags", "horizon", "k"):
        if seen[f"lo_{c}"] is None or seen[f"lo_{c}"] <= 0 or seen[f"lo_{c}"] != seen[f"hi_{c}"]:
            raise ValueError(f"{c} is not one positive number over all splits")
    return table


def aligned(payload: DataFrame, other: DataFrame) -> DataFrame:
    """(split, n, other_n, both): rows of each split in both tables, and how many keys they share."""
    a, b = payload.select(*KEYS, F.lit(1).alias("a")), other.select(*KEYS).distinct().withColumn("b", F.lit(1))
    joined = a.join(b, list(KEYS), "full")
    return joined.groupBy("split").agg(F.count("a").alias("n"), F.count("b").alias("other_n"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def head(payload: DataFrame, most: int) -> DataFrame:
    """The first rows of each split by date and series; a per-split limit as Spark's partial top-k."""
    from pyspark.sql.window import Window

    rank = F.row_number().over(Window.partitionBy("split").orderBy("qt", "qu"))
    return payload.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def sample(payload: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """A seeded uniform draw of rows without repeats: those of the smallest digests of seed and key."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in KEYS]))
    return payload.withColumn("__digest", digest).orderBy("__digest", *KEYS).limit(most).drop("__digest")


def draw(payload: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n uniform draws with repeats: rows with draw, the number of the draw, from 0.

    Rows are numbered in the order of their keys by counts of ranges, and each draw looks up
    the row of a number that the digest of seed and draw gives: a join of n rows, whatever the
    table's size. No rows give no draws.
    """
    placed = numbered(payload.select(*KEYS), list(KEYS), "__place")
    total = placed.agg(F.count("*").alias("__n"))  # one row
    digest = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"))), 1, 13), 16, 10).cast("long")
    asked = payload.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total), F.lit(True)).where("__n > 0")
    asked = asked.select("draw", (digest % F.col("__n")).alias("__place"))
    return payload.join(placed.join(asked, "__place").drop("__place"), list(KEYS))


def merge(sources: list[DataFrame], keys: Iterable[str] = (*KEYS, "method")) -> DataFrame:
    """One row a key out of several tables; the last table that has the key wins. Columns may be missing from some."""
    if not sources:
        raise ValueError("there is a table at least")
    keys, out = list(keys), None
    for i, rows in enumerate(sources):
        rows = rows.withColumn("__order", F.lit(i))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (*keys, "__order")]
    last = out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__order").alias("__row"))
    return last.select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def load_predictions(spark: SparkSession, paths: list[str], splits: Iterable[str] | None = None) -> DataFrame:
    """Prediction tables of several Parquet folders merged in order, restricted to the splits that are there (an error if none)."""
    out = merge([spark.read.parquet(p) for p in paths])
    out = out.where(F.col("split").isin(list(splits))) if splits else out
    if out.isEmpty():
        raise ValueError("no split is available")
    return out


def labelled(rows: DataFrame, labels: dict[str, str], column: str = "method", name: str = "label", patterns: dict[str, str] | None = None) -> DataFrame:
    """rows with a short label: by exact name, else by the first pattern that matches, else the name itself."""
    found = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])[F.col(column)] if labels else F.lit(None).cast("string")
    for pattern, text in reversed((patterns or {}).items()):
        found = F.coalesce(found, F.when(F.col(column).rlike(pattern), F.regexp_replace(column, pattern, text)))
    return rows.withColumn(name, F.coalesce(found, F.col(column)))


def with_optional(rows: DataFrame, columns: dict[str, tuple[tuple[str, ...], Column]]) -> DataFrame:
    """rows with each named column whose inputs are all there."""
    return rows.withColumns({name: value for name, (inputs, value) in columns.items() if set(inputs) <= set(rows.columns)})


def single(rows: DataFrame, *columns: str) -> DataFrame:
    """rows with number columns at 32-bit precision, still as doubles."""
    return rows.withColumns({c: F.col(c).cast("float").cast("double") for c in columns})


def plot_weights(d: str | Column = "d") -> Column:
    """Weights of the plots: softmax of the negative distances, not scaled by their spread."""
    d = F.col(d) if isinstance(d, str) else d
    return A.softmax(F.transform(d, lambda x: -x))


def dashboard_features(payload: DataFrame) -> DataFrame:
    """The 15 gate features by name as the dashboard shows them: plot weights, means and deviations of finite values.

    Features that need neighbour residuals are left out if the payload has none.
    """
    finite = lambda x: F.filter(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    mean = lambda x: F.when(F.size(finite(x)) > 0, A.mean(finite(x)))
    std = lambda x: F.when(F.size(finite(x)) > 0, A.std(finite(x)))
    of = lambda c: F.transform("nbrs", lambda n: n[c].cast("double"))
    rows = payload.withColumn("w", plot_weights(F.transform("nbrs", lambda n: n["distance"])))
    has_residuals = "es" in payload.schema["nbrs"].dataType.elementType.fieldNames()
    shift = F.zip_with("pred_ctx", "pred", lambda a, b: a - b)
    weighted = A.weighted("w", F.transform("nbrs", lambda n: n["ys"]))
    columns = {
        "context_shift_mean": mean(shift),
        "context_shift_std": std(shift),
        "weighted_minus_pred_mean": mean(F.zip_with(weighted, "pred", lambda a, b: a - b)),
        "weighted_residual_mean": mean(A.weighted("w", F.transform("nbrs", lambda n: n["es"]))) if has_residuals else None,
        "query_mean": F.col("mu"),
        "query_std": F.col("sd"),
        "neighbour_mean_mean": mean(of("mu")),
        "neighbour_mean_std": std(of("mu")),
        "neighbour_std_mean": mean(of("sd")),
        "neighbour_std_std": std(of("sd")),
        "same_user_ratio": mean(F.transform("nbrs", lambda n: (n["nu"] == F.col("qu")).cast("double"))),
        "age_mean": mean(F.transform("nbrs", lambda n: (F.col("qt") - n["nt"]).cast("double"))),
        "weight_std": std(F.col("w")),
        "weight_max": F.array_max("w"),
        "distance_mean": mean(of("distance")),
    }
    return rows.select(*KEYS, *[c.alias(n) for n, c in columns.items() if c is not None])
