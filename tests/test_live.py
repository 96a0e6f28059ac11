"""Streams in any cut of batches against one batch over all closed bins."""

import numpy as np
import pytest
from lagspark.operators import retrieval, windows
from lagspark.sources import series as S
from lagspark.streaming import live
from pyspark.sql import functions as F

POLICY = retrieval.StorePolicy(4, 2, 2, 2)


def events():
    """Thirty hours of two series, a third one from hour 12 on, hours without events, and rows that are late but in time."""
    rng = np.random.default_rng(1)
    rows = [(s, h * 60 + int(m), round(float(rng.normal()), 3)) for h in range(30) if h not in (7, 8, 19) for s in "ab" for m in rng.integers(0, 60, 2)]
    rows += [("c", h * 60 + 5, float(h)) for h in range(12, 30, 2)] + [("a", 30 * 60 + 300, 1.0)]
    late = [(i, r) for i, r in enumerate(rows) if i % 11 == 5 and r[1] < 1700]
    for i, r in reversed(late):  # half an hour late, within the two hours allowed
        rows.remove(r)
        rows.insert(next((j for j, x in enumerate(rows) if x[1] > r[1] + 30), len(rows)), r)
    return sorted(rows, key=lambda r: r[1] + 30 * (r in [x for _, x in late]))


@pytest.mark.parametrize("cuts", [1, 4])
def test_any_cut_gives_the_batch_result(spark, tmp_path, cuts):
    rows = events()
    frame = lambda part: spark.createDataFrame(part, "event_type string, m long, value double").select("event_type", F.timestamp_seconds(F.lit(1704067200) + F.col("m") * 60).alias("ts"), "value")
    for i, part in enumerate(np.array_split(np.arange(len(rows)), cuts)):
        frame([rows[j] for j in part]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_type string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    function = live.LiveWindows(f"file://{tmp_path}/out", POLICY, 3)
    live.start(stream, function, str(tmp_path / "checkpoint")).awaitTermination(200)
    got = function.read(spark, "windows")

    # One batch over the bins that have closed: hours up to the newest event less two hours.
    closed = frame(rows).where(F.col("ts") < F.timestamp_seconds(F.lit(1704067200 + 30 * 3600)))
    long = S.event_series(closed.withColumn("event_id", F.lit(0)))
    want = windows.features(windows.with_stats(windows.windows(long, 4, 2))).join(long.select("series_id", "series_name").distinct(), "series_id")
    plain = lambda df: sorted((r["series_name"], r["t"], tuple(np.round(r["x"], 6)), tuple(np.round(r["y"], 6))) for r in df.collect())
    assert plain(got) == plain(want) and got.count() == 3 * 25

    newest = want.where("t = 24").withColumn("split", F.lit("live"))
    near = sorted((r["qu"], r["rank"], r["nu"], r["nt"]) for r in retrieval.knn_join(newest, want, POLICY, 3).collect())
    last = function.read(spark, "neighbours").where("t = 24")
    assert sorted(("abc".index(r["series_name"]), r["rank"], "abc".index(r["of_series"]), r["of_t"]) for r in last.collect()) == near

    # A batch that is run again changes nothing.
    batch = got.agg(F.max("batch")).first()[0]
    before = plain(got)
    again = spark.read.parquet(f"file://{tmp_path}/out/bins/batch={batch}").collect()
    function(spark.createDataFrame(again, "ts timestamp, series_name string, value double"), batch)
    assert plain(function.read(spark, "windows")) == before
