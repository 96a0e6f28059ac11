"""Prediction tables as a learner reads them: on each query's own scale, or as they are, and back again.

Everything is an array expression over a row, so nothing is shuffled. A neighbour's horizon and
residual are already on its query's scale; a residual has no level, so it is only divided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lagspark.functions import arrays as A

NORMALISATIONS = ("instance", "none")
#: Columns with a level and a scale, and fields of a neighbour with both and with a scale only.
LEVELS, NEIGHBOUR_LEVELS, NEIGHBOUR_SCALES = ("x", "y", "pred", "pred_ctx"), ("ys", "xs"), ("es",)


def _known(how: str) -> None:
    if how not in NORMALISATIONS:
        raise ValueError(f"unknown normalisation {how}")


def _forth(v: Column | str, level: bool = True) -> Column:
    s, mu = A.clamped("sd"), F.col("mu") if level else F.lit(0.0)
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda e: (e - mu) / s)


def prepare(payload: DataFrame, how: str = "instance") -> DataFrame:
    """payload for a learner, with loss_scale: what its errors are divided by.

    Under "instance" windows, forecasts and neighbours are on the query's scale (deviation
    clamped) and loss_scale is 1; under "none" they stay and it is the clamped deviation. mu
    and sd stay those of the query, so that restore() needs nothing else; neighbours keep
    theirs. Columns and neighbour fields that a table lacks are passed over.
    """
    _known(how)
    if how == "none":
        return payload.withColumn("loss_scale", A.clamped("sd"))
    out = payload.withColumns({c: _forth(c) for c in LEVELS if c in payload.columns} | {"loss_scale": F.lit(1.0)})
    if "nbrs" not in payload.columns:
        return out
    fields = payload.schema["nbrs"].dataType.elementType.fieldNames()
    value = lambda n, c: _forth(n[c], c in NEIGHBOUR_LEVELS) if c in NEIGHBOUR_LEVELS + NEIGHBOUR_SCALES else n[c]
    return out.withColumn("nbrs", F.transform("nbrs", lambda n: F.struct(*[value(n, c).alias(c) for c in fields])))


def restore(rows: DataFrame, columns: list[str], how: str = "instance") -> DataFrame:
    """rows with forecasts of a learner back on the scale of the series."""
    _known(how)
    s = A.clamped("sd")
    return rows.withColumns({c: F.transform(c, lambda e: e * s + F.col("mu")) for c in columns}) if how == "instance" else rows


def loss(yhat: Column | str = "yhat", y: Column | str = "y") -> Column:
    """Mean squared error in loss_scale: of a prepared row it is the same under either normalisation."""
    at = lambda c: F.col(c) if isinstance(c, str) else c
    return A.mean(F.zip_with(at(yhat), at(y), lambda a, b: F.pow((a - b) / F.col("loss_scale"), F.lit(2.0))))
