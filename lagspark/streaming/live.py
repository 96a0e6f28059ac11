"""Windows and neighbours kept up to date from a stream of events.

Closed hourly bins (hourly.hourly) arrive batch by batch. A batch adds its bins, the windows
that end in its hours and the neighbours of the newest window of each series to three tables,
each batch in a folder of its own: a batch that is run again after a failure writes the same
folders again and reads only those before it. Besides its own bins a batch reads the last
L + H - 1 hours before it, which its first windows reach into. Hours without events hold 0,
from the first hour of all on; a series that appears later has zeros up to then, and its
windows of the past are added with it. So the tables do not depend on where batches are cut.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagspark.operators import retrieval, windows
from lagspark.sources.tables import exists, numbered

from .hourly import hourly


@dataclass(frozen=True)
class LiveWindows:
    """The foreachBatch function of a stream of closed bins."""

    root: str
    policy: retrieval.StorePolicy
    k: int
    metric: str = "euclidean"

    def read(self, spark: SparkSession, table: str, until: int | None = None) -> DataFrame | None:
        """A table's rows of the batches up to one; None while there is none."""
        path = f"{self.root}/{table}"
        if not exists(spark, path):
            return None
        rows = spark.read.parquet(path)
        return rows if until is None else rows.where(F.col("batch") <= until)

    def write(self, rows: DataFrame, table: str, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/batch={batch}")

    def __call__(self, closed: DataFrame, batch: int) -> None:
        spark = closed.sparkSession
        if closed.isEmpty():
            return
        earlier = self.read(spark, "bins", batch - 1)
        last = earlier.agg(F.max("ts")).first()[0] if earlier is not None else None
        self.write(closed.select("ts", "series_name", "value"), "bins", batch)
        rows = self.new_windows(self.read(spark, "bins", batch), batch, last is not None)
        self.write(rows, "windows", batch)
        self.write(self.newest_neighbours(self.read(spark, "windows", batch)), "neighbours", batch)

    def new_windows(self, bins: DataFrame, batch: int, continued: bool) -> DataFrame:
        """(series_name, t, x, y, mu, sd, feat) of the windows that the batch completes."""
        span = self.policy.span
        edges = bins.agg(F.min("ts").alias("origin"), F.max("ts").alias("front"), F.max(F.when(F.col("batch") < batch, F.col("ts"))).alias("last"))  # one row
        hours = lambda c: F.expr(f"timestampdiff(HOUR, origin, {c})")
        known = bins.groupBy("series_name").agg(F.min("batch").alias("since")).join(F.broadcast(edges), F.lit(True))
        # The first window that was not whole before; all of them for a series that is new.
        first = F.when(F.col("since") < batch, F.greatest(hours("last") - span + 2, F.lit(0))).otherwise(0) if continued else F.lit(0)
        cells = known.select("series_name", first.cast("long").alias("first"), hours("front").alias("end"))
        cells = cells.select("series_name", F.explode(F.sequence("first", "end")).alias("t"), F.lit(0.0).alias("value"))
        placed = bins.join(F.broadcast(edges), F.lit(True)).where(hours("ts") >= (F.greatest(hours("last") - span + 2, F.lit(0)) if continued else 0))
        placed = placed.select("series_name", hours("ts").alias("t"), F.coalesce("value", F.lit(0.0)).alias("value"))
        series = cells.unionByName(placed).groupBy("series_name", "t").agg(F.sum("value").alias("value"))
        rows = windows.windows(series.withColumnRenamed("series_name", "series_id"), self.policy.lags, self.policy.horizon)
        return windows.features(windows.with_stats(rows)).withColumnRenamed("series_id", "series_name")

    def newest_neighbours(self, stored: DataFrame) -> DataFrame:
        """(series_name, t, rank, of_series, of_t, distance) for the newest window of each series."""
        ids = numbered(stored.select("series_name").distinct(), "series_name", "series_id")
        rows = stored.join(ids, "series_name")
        newest = stored.agg(F.max("t").alias("newest"))  # one row
        queries = rows.join(F.broadcast(newest), F.col("t") == F.col("newest")).withColumn("split", F.lit("live")).drop("newest")
        near = retrieval.knn_blocks(queries, rows, self.policy, self.k, self.metric)
        own, other = (ids.select(F.col("series_id").alias(c), F.col("series_name").alias(n)) for c, n in (("qu", "series_name"), ("nu", "of_series")))
        return near.join(own, "qu").join(other, "nu").select("series_name", F.col("qt").alias("t"), "rank", "of_series", F.col("nt").alias("of_t"), "distance")


def start(events: DataFrame, live: LiveWindows, checkpoint: str, lateness: str = "2 hours"):
    """A query that runs over what has arrived and stops."""
    writer = hourly(events, lateness).writeStream.outputMode("append").foreachBatch(live)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
