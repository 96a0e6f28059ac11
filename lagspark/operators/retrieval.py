"""Store policies and exact k-nearest-neighbour joins of windows.

A query window may look at windows of all series that start on the same phase of the
period, that lie on the store's stride, and that end before its lookback starts (online) or
inside a fixed range. The policy is a few whole numbers a query date in closed form, so the
theta join is an equi-join on the phase with a range as residual condition.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lagspark.functions import arrays as A

METRICS = ("euclidean", "cosine", "pearson")
#: A block's strides in time and its series: at most their product of windows.
DATES, SERIES = 64, 64


@dataclass(frozen=True)
class StorePolicy:
    """Which windows a query may look at."""

    lags: int
    horizon: int
    period: int = 24
    stride: int = 24
    online: bool = True
    align: bool = True
    store_start: int = 0
    store_end: int = 0  # end of a fixed store
    history_start: int = 0
    history_end: int | None = None
    min_dates: int | None = None
    max_dates: int | None = None
    max_windows: int | None = None
    n_series: int = 1

    def __post_init__(self):
        if self.stride <= 0 or self.period <= 0:
            raise ValueError("strides and periods are positive")
        if self.align and self.stride % self.period:
            raise ValueError("the stride is no multiple of the period")
        if self.lags < 0 or self.horizon < 0 or self.n_series <= 0:
            raise ValueError("lags and horizon are not negative, and there is a series at least")
        if any(cap is not None and cap <= 0 for cap in (self.max_dates, self.max_windows)):
            raise ValueError("caps on dates and windows are positive")
        if self.min_dates is not None and self.min_dates < 0:
            raise ValueError("min_dates is not negative")
        if self.history_end is not None and self.history_start >= self.history_end:
            raise ValueError("a history starts before it ends")
        if self.min_dates is not None and self.max_dates is not None and self.min_dates > self.max_dates:
            raise ValueError("min_dates is over max_dates")
        if not self.online and self.store_start >= self.store_end:
            raise ValueError("a fixed store starts before it ends")

    @property
    def span(self) -> int:
        return self.lags + self.horizon


def store_bounds(queries: DataFrame, policy: StorePolicy, qt: str = "t") -> DataFrame:
    """queries with lo, hi and keep_n, the oldest and newest store start and their number (0: none)."""
    p, q = policy, F.col(qt)
    first = F.lit(max(0 if p.online else p.store_start, p.history_start))
    last = q - p.span if p.online else F.lit(p.store_end - p.span)
    if p.history_end is not None:
        last = F.least(last, F.lit(p.history_end - p.span))
    if p.align:
        first = first + F.pmod(q - first, F.lit(p.period))
    out = queries.withColumns({"__first": first.cast("long"), "__last": last.cast("long")})
    if p.align:
        out = out.withColumn("__last", F.col("__last") - F.pmod(F.col("__last") - F.col("__first"), F.lit(p.period)))
    n = F.when(F.col("__last") < F.col("__first"), 0).otherwise(F.floor((F.col("__last") - F.col("__first")) / p.stride) + 1)
    if p.online:
        n = F.when(q < p.span, 0).otherwise(n)
    out = out.withColumn("__n", n.cast("long"))
    kept = F.col("__n")
    if p.max_dates is not None:
        kept = F.least(kept, F.lit(p.max_dates))
    if p.max_windows is not None:
        kept = F.least(kept, F.lit(p.max_windows // p.n_series))
    if p.min_dates is not None:
        kept = F.when(F.col("__n") < p.min_dates, 0).otherwise(kept)
    out = out.withColumn("keep_n", F.greatest(kept, F.lit(0)).cast("long"))
    lo = F.col("__first") + (F.col("__n") - F.col("keep_n")) * p.stride
    hi = F.col("__first") + (F.col("__n") - 1) * p.stride
    some = F.col("keep_n") > 0
    return out.withColumns({"lo": F.when(some, lo), "hi": F.when(some, hi)}).drop("__first", "__last", "__n")


def eligible(queries: DataFrame, policy: StorePolicy, k: int, qt: str = "t") -> DataFrame:
    """Queries whose store is not empty; all of them for k = 0."""
    return queries if k == 0 else store_bounds(queries, policy, qt).where("keep_n > 0").drop("lo", "hi", "keep_n")


def prepared(rows: DataFrame, metric: str) -> DataFrame:
    """feat ready for the metric: unit length for cosine, centred before that for pearson."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    if metric == "pearson":
        rows = rows.withColumn("feat", A.centred("feat", A.mean("feat")))
    return rows if metric == "euclidean" else rows.withColumn("feat", A.unit("feat"))


def distance(metric: str, a: str, b: str) -> Column:
    return F.sqrt(A.squared_distance(a, b)) if metric == "euclidean" else F.lit(1.0) - A.dot(a, b)


def knn_join(queries: DataFrame, store: DataFrame, policy: StorePolicy, k: int, metric: str = "euclidean") -> DataFrame:
    """(split, qt, qu, rank, nt, nu, distance): the k nearest store windows of each query window.

    queries and store have series_id, t and feat. The join is on the phase (and the stride's
    residue where it is coarser); ties go to the smaller series, then to the earlier start.
    """
    q = store_bounds(prepared(queries, metric), policy).where("keep_n > 0")
    q = q.select("split", F.col("t").alias("qt"), F.col("series_id").alias("qu"), F.col("feat").alias("qf"), "lo", "hi")
    s = prepared(store, metric).select(F.col("t").alias("nt"), F.col("series_id").alias("nu"), F.col("feat").alias("sf"))
    q = q.withColumn("phase", F.pmod("lo", F.lit(policy.stride)))
    s = s.withColumn("phase", F.pmod("nt", F.lit(policy.stride)))
    pairs = q.join(s, (q["phase"] == s["phase"]) & (s["nt"] >= q["lo"]) & (s["nt"] <= q["hi"]))
    near = pairs.select("split", "qt", "qu", "nt", "nu", distance(metric, "qf", "sf").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("split", "qt", "qu").orderBy("distance", "nu", "nt"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("split", "qt", "qu", "rank", "nt", "nu", "distance")


def needed_chunks(asked: DataFrame, width: int) -> DataFrame:
    """(phase, chunk): the cells of the store, by phase and stretch of width positions, that some query may look at."""
    spans = asked.groupBy("phase", F.floor(F.col("t") / width).alias("at")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    cells = F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))
    return spans.select(F.col("phase").cast("int").alias("phase"), F.explode(cells.cast("array<int>")).alias("chunk")).distinct()


def within(store: DataFrame, asked: DataFrame, policy: StorePolicy, dates: int) -> DataFrame:
    """The store's rows in the cells that are needed.

    A stored table of windows (``windows.placed`` with the same stride and dates) is partitioned
    by these cells: there the cells are broadcast, at most as many as the table has folders, so
    that only their folders are read.
    """
    cells = needed_chunks(asked, policy.stride * dates)
    if {"phase", "chunk"} <= set(store.columns):
        return store.join(F.broadcast(cells), ["phase", "chunk"], "left_semi")
    own = store.withColumns({"phase": F.pmod("t", F.lit(policy.stride)).cast("int"), "chunk": F.floor(F.col("t") / (policy.stride * dates)).cast("int")})
    return own.join(cells, ["phase", "chunk"], "left_semi").drop("phase", "chunk")


def summaries(rows: DataFrame, metric: str) -> DataFrame:
    """One row a block (phase, c, b) of rows: its number, starts, bounds, centroid, radius, and how far its shortest vector is from unit length."""

    def run(table: pa.Table) -> pa.Table:
        x = np.array(table.column("feat").to_pylist())
        centre = x.mean(axis=0)
        radius = np.sqrt(((x - centre) ** 2).sum(axis=1).max()) * (1 + 1e-12)
        short = 0.0 if metric == "euclidean" else max(0.0, 1 - float((x * x).sum(axis=1).min()))
        t, lo, hi = (table.column(c).to_numpy() for c in ("t", "lo", "hi"))
        keys = [table.column(c)[0].as_py() for c in ("phase", "c", "b")]
        values = [*keys, len(x), t.min(), t.max(), lo.min(), lo.max(), hi.min(), hi.max(), centre.tolist(), radius, short]
        return pa.table({n: pa.array([v]) for n, v in zip(names, values)})

    names = ["phase", "c", "b", "n", "t_min", "t_max", "lo_min", "lo_max", "hi_min", "hi_max", "centre", "radius", "short"]
    schema = ", ".join(f"{n} long" for n in names[:10]) + ", centre array<double>, radius double, short double"
    return rows.groupBy("phase", "c", "b").applyInArrow(run, schema)


def block_pairs(asked: DataFrame, store: DataFrame, k: int, metric: str, width: int) -> DataFrame:
    """(phase, qc, qb, sc, sb): the pairs of a query block and a store block that can hold a neighbour.

    A pair is left out if no start of the store block lies in a query's range, or if it is
    farther off than k windows are that every query of the block may use: those of the
    nearest store blocks that lie whole in all their ranges, by centroids and radii.
    """
    q, s = summaries(asked, metric), summaries(store, metric)
    q = q.select("phase", F.col("c").alias("qc"), F.col("b").alias("qb"), "lo_min", "lo_max", "hi_min", "hi_max", F.col("centre").alias("q_centre"), F.col("radius").alias("q_radius"), F.col("short").alias("q_short"))
    s = s.select("phase", F.col("c").alias("sc"), F.col("b").alias("sb"), "n", "t_min", "t_max", "centre", "radius", "short")
    q = q.withColumn("sc", F.explode(F.sequence(F.floor(F.col("lo_min") / width), F.floor(F.col("hi_max") / width))))
    pairs = q.join(s, ["phase", "sc"]).where("t_max >= lo_min AND t_min <= hi_max")
    gap, spread = F.sqrt(A.squared_distance("q_centre", "centre")), F.col("q_radius") + F.col("radius")
    least, most = F.greatest(gap - spread, F.lit(0.0)), gap + spread
    if metric != "euclidean":  # of unit vectors the distance is half the squared one
        least, most = least * least / 2, most * most / 2 + (F.col("q_short") + F.col("short")) / 2
    pairs = pairs.withColumns({"least": least * (1 - 1e-9) - 1e-9, "most": most * (1 + 1e-9) + 1e-9})
    usable = F.when((F.col("t_min") >= F.col("lo_max")) & (F.col("t_max") <= F.col("hi_min")), F.col("n")).otherwise(0)
    block = Window.partitionBy("phase", "qc", "qb")
    enough = F.sum(usable).over(block.orderBy("most").rangeBetween(Window.unboundedPreceding, Window.currentRow)) >= k
    pairs = pairs.withColumn("enough", F.when(enough, F.col("most"))).withColumn("limit", F.min("enough").over(block))
    return pairs.where("limit IS NULL OR least <= limit").select("phase", "qc", "qb", "sc", "sb")


def dealt(queries: DataFrame, store: DataFrame, policy: StorePolicy, k: int, metric: str = "euclidean", dates: int = DATES, series: int = SERIES, query_dates: int | None = None) -> DataFrame:
    """Query and store rows, each once for each pair of blocks that it takes part in.

    A block holds the windows of one phase that start within ``dates`` strides of each other
    and belong to ``series`` neighbouring series, so its size is bounded whatever the table.
    Only summaries of blocks are paired; rows are dealt out after that.
    """
    stride, width = policy.stride, policy.stride * dates
    q = store_bounds(prepared(queries, metric), policy).where("keep_n > 0")
    if not policy.online:  # a fixed store may be declared beyond the windows that there are
        edge = store.agg(F.min("t").alias("__a"), F.max("t").alias("__b"))  # one row
        q = q.join(F.broadcast(edge), F.lit(True)).withColumns({"lo": F.greatest("lo", F.col("__a") + F.pmod(F.col("lo") - F.col("__a"), F.lit(stride))), "hi": F.least("hi", "__b")}).where("lo <= hi")
    block = lambda per: (F.floor(F.col("t") / (stride * per)).alias("c"), F.floor(F.col("series_id") / series).alias("b"))
    asked = q.select(F.lit(True).alias("asks"), "split", "series_id", "t", "feat", "lo", "hi", F.pmod("lo", F.lit(stride)).alias("phase"), *block(query_dates or dates))
    none = F.lit(0).cast("long")
    kept = prepared(within(store, asked, policy, dates), metric).select(
        F.lit(False).alias("asks"), F.lit("").alias("split"), "series_id", "t", "feat", none.alias("lo"), none.alias("hi"), F.pmod("t", F.lit(stride)).alias("phase"), *block(dates)
    )
    pairs = block_pairs(asked, kept, k, metric, width)
    ends = F.array(F.struct(F.lit(True).alias("asks"), F.col("qc").alias("c"), F.col("qb").alias("b")), F.struct(F.lit(False).alias("asks"), F.col("sc").alias("c"), F.col("sb").alias("b")))
    both = pairs.withColumn("end", F.explode(ends)).select("phase", "qc", "qb", "sc", "sb", "end.*")
    return asked.unionByName(kept).join(both, ["phase", "asks", "c", "b"])


def knn_blocks(queries: DataFrame, store: DataFrame, policy: StorePolicy, k: int, metric: str = "euclidean", **blocks: int) -> DataFrame:
    """knn_join for large stores: the pairs of blocks that can hold a neighbour meet in matrix products.

    A pair of blocks returns at most k rows a query, and a window merges them. Differences
    are summed exactly for the window pairs that a product with an error bound does not rule
    out. A store of bounded history is read, and dealt out, only where queries look.
    """

    def tile(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        a, b = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        found: dict[str, list] = {c: [] for c in ("split", "qt", "qu", "nt", "nu", "distance")}
        if a.num_rows and b.num_rows:
            x, y = (np.array(t.column("feat").to_pylist()) for t in (a, b))
            lo, hi, qt, qu = (a.column(c).to_numpy() for c in ("lo", "hi", "t", "series_id"))
            nt, nu = b.column("t").to_numpy(), b.column("series_id").to_numpy()
            # Lengths play no part in angles, whatever a vector without a direction has.
            xx, yy = ((x * x).sum(axis=1), (y * y).sum(axis=1)) if metric == "euclidean" else (np.ones(len(x)), np.ones(len(y)))
            for s in range(0, len(x), 256):
                # One product for a slice of queries; what it surely rules out is not summed exactly.
                about = xx[s : s + 256, None] + yy - 2 * (x[s : s + 256] @ y.T)
                about[(nt < lo[s : s + 256, None]) | (nt > hi[s : s + 256, None])] = np.inf
                floor = np.partition(about, k - 1, axis=1)[:, k - 1 : k] if len(y) > k else np.full((len(about), 1), np.inf)
                slack = 1e-9 * (1 + yy.max() + xx[s : s + 256, None])
                i, j = np.nonzero((about <= floor + slack) & (about < np.inf))
                p = i + s
                d = np.sqrt(((y[j] - x[p]) ** 2).sum(axis=1)) if metric == "euclidean" else 1 - (y[j] * x[p]).sum(axis=1)
                order = np.lexsort((nt[j], nu[j], d, p))
                i, j, p, d = i[order], j[order], p[order], d[order]
                starts = np.concatenate([[0], np.nonzero(np.diff(p))[0] + 1]) if len(p) else np.empty(0, int)
                place = np.arange(len(p)) - np.repeat(starts, np.diff(np.append(starts, len(p))))
                j, p, d = j[place < k], p[place < k], d[place < k]
                found["split"].append(a.column("split").take(pa.array(p)).to_pylist())
                for name, values in (("qt", qt[p]), ("qu", qu[p]), ("nt", nt[j]), ("nu", nu[j]), ("distance", d)):
                    found[name].append(values)
        kinds = [pa.string(), *[pa.int64()] * 4, pa.float64()]
        return pa.table([pa.array([x for part in v for x in part], t) for v, t in zip(found.values(), kinds)], names=list(found))

    rows = dealt(queries, store, policy, k, metric, **blocks)
    tiles = rows.groupBy("phase", "qc", "qb", "sc", "sb").applyInArrow(tile, "split string, qt long, qu long, nt long, nu long, distance double")
    rank = F.row_number().over(Window.partitionBy("split", "qt", "qu").orderBy("distance", "nu", "nt"))
    return tiles.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k).select("split", "qt", "qu", "rank", "nt", "nu", "distance")


def lookup(neighbours: DataFrame, windows: DataFrame, stride: int | None = None, dates: int = DATES) -> DataFrame:
    """neighbours with their windows' lookback xc and horizon yc and the lookback's mu_c, sd_c.

    With the stride that a stored table is partitioned by, its cells are part of the key.
    """
    cells = ["phase", "chunk"] if stride else []
    w = windows.select(*cells, F.col("t").alias("nt"), F.col("series_id").alias("nu"), F.col("x").alias("xc"), F.col("y").alias("yc"), F.col("mu").alias("mu_c"), F.col("sd").alias("sd_c"))
    if not stride:
        return neighbours.join(w, ["nt", "nu"])
    placed = neighbours.withColumns({"phase": F.pmod("nt", F.lit(stride)).cast("int"), "chunk": F.floor(F.col("nt") / (stride * dates)).cast("int")})
    return placed.join(w, ["phase", "chunk", "nt", "nu"]).drop("phase", "chunk")


def leave_one_out(found: DataFrame) -> DataFrame:
    """For each neighbour the other neighbours' windows on its own scale, as context."""
    a = found.select("split", "qt", "qu", "rank", F.col("mu_c").alias("mu_a"), F.col("sd_c").alias("sd_a"))
    b = found.select("split", "qt", "qu", F.col("rank").alias("other"), F.concat("xc", "yc").alias("w"), F.col("mu_c").alias("mu_b"), F.col("sd_c").alias("sd_b"))
    pairs = a.join(b, ["split", "qt", "qu"]).where("rank <> other")
    scaled = pairs.withColumn("w", A.transfer("w", "mu_b", "sd_b", "mu_a", "sd_a"))
    each = scaled.groupBy("split", "qt", "qu", "rank").agg(F.array_sort(F.collect_list(F.struct("other", "w"))).alias("c"))
    return each.select("split", "qt", "qu", "rank", F.transform("c", lambda c: c["w"]).alias("context"))
