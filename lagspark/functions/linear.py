"""Linear systems as Catalyst expressions: one row a system, any number of rows and unknowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _at(matrix: Column, i: Column, j: Column) -> Column:
    return F.get(F.get(matrix, i), j)


def eliminate(matrix: Column, unknowns: Column) -> Column:
    """Gauss-Jordan on an augmented matrix of the given number of rows: a fold over pivots; a zero pivot gives nulls."""

    def step(m: Column, k: Column) -> Column:
        pivot = F.get(m, k)

        def line(row: Column, i: Column) -> Column:
            own = F.transform(row, lambda v: F.try_divide(v, F.get(row, k)))
            other = F.zip_with(row, pivot, lambda v, w: v - F.try_divide(F.get(row, k), F.get(pivot, k)) * w)
            return F.when(i == k, own).otherwise(other)

        return F.transform(m, line)

    return F.aggregate(F.sequence(F.lit(0), unknowns - 1), matrix, step)


def solve_ridge(sums: DataFrame, l2: float, xx: str = "xx", xy: str = "xy", n: str = "n", name: str = "beta") -> DataFrame:
    """sums with the ridge coefficients of each row: no intercept, features scaled by their root mean square.

    xx is the matrix of sums of products of the features, xy their sums with the target and n
    the number of rows behind them. A singular system (only without l2) gives nulls.
    """
    if l2 < 0:
        raise ValueError("l2 is not negative")
    p, every = F.size(xx), F.sequence(F.lit(0), F.size(xx) - 1)
    mean = lambda c: c / F.col(n)
    scale = F.transform(every, lambda i: F.greatest(F.sqrt(mean(_at(F.col(xx), i, i))), F.lit(1e-12)))
    scaled = lambda i, j: mean(_at(F.col(xx), i, j)) / F.get(F.col("__s"), i) / F.get(F.col("__s"), j) + F.when(i == j, float(l2)).otherwise(0.0)
    line = lambda i: F.concat(F.transform(every, lambda j: scaled(i, j)), F.array(mean(F.get(F.col(xy), i)) / F.get(F.col("__s"), i)))
    out = sums.withColumn("__s", scale).withColumn("__m", F.transform(every, line)).withColumn("__e", eliminate(F.col("__m"), p))
    return out.withColumn(name, F.transform(every, lambda i: _at(F.col("__e"), i, p) / F.get(F.col("__s"), i))).drop("__s", "__m", "__e")
