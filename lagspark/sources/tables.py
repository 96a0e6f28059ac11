"""Tables that outlive a job: checkpoints, tables stored once an application, and models by version.

All of them lie in the folder that the cluster names in spark.checkpoint.dir, which driver and
executors share, so a lost executor costs no more than reading a file again.
"""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; on a local master a temporary one if none is set, elsewhere that is an error."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lagspark-")
    sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df worked out once, its lineage replaced by files."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return bool(fs.exists(where))


def list_names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, in order; none if there is no such folder."""
    where, fs = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, from any store that Spark reads."""
    return "\n".join(r[0] for r in spark.read.option("wholetext", "true").text(path).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, in any store that Spark writes to; its folders are made."""
    where, fs = _path(spark, path)
    fs.mkdirs(where.getParent())
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def fingerprint(df: DataFrame) -> str:
    """A digest of the names, sizes and times of the files that df reads: changes when they do."""
    spark, marks = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        where, fs = _path(spark, name)
        status = fs.getFileStatus(where)
        marks.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.md5("\n".join(marks).encode()).hexdigest()


def application_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tables-{spark.sparkContext.applicationId}"


def stored(spark: SparkSession, name: str, make: Callable[[], DataFrame], by: tuple[str, ...] = (), slices: Column | None = None) -> DataFrame:
    """The table make() gives, written once an application under a name and partitioned by some columns.

    Another query of the application that asks for the name reads the files. A table appears
    whole or not at all: it is written beside its place and moved there.
    """
    path = f"{application_folder(spark)}/{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        draft = f"{path}-{uuid.uuid4().hex}"
        rows = make()
        # One writer a partition value and slice of rows, so that files are neither tiny nor without bound.
        rows = rows.repartition(*by, *([] if slices is None else [slices])) if by else rows
        rows.write.partitionBy(*by).parquet(draft)
        (source, fs), (target, _) = _path(spark, draft), _path(spark, path)
        if not fs.rename(source, target) and not exists(spark, f"{path}/_SUCCESS"):
            raise OSError(f"{draft} cannot be moved to {path}")
    return spark.read.parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete what this application has stored."""
    where, fs = _path(spark, application_folder(spark))
    fs.delete(where, True)


def numbered(keys: DataFrame, column: str | list[str], name: str, ranges: int | None = None) -> DataFrame:
    """Distinct keys with their places from 0 in the order of a column (or some).

    Keys are dealt by ranges and cut there, so that ranges stay as they are; counts by range
    are summed up, and a key's place is the sum before its range and its place within it. No
    task sees more than a range, or one row a range. There are as many ranges as the session
    has shuffle partitions, unless given.
    """
    order = [column] if isinstance(column, str) else column
    ranges = ranges or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(keys.repartitionByRange(ranges, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("__range", before.alias("__before"))  # one row a range
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order)) - 1
    placed = dealt.withColumn("__own", own).join(F.broadcast(starts), "__range")
    return placed.withColumn(name, (F.col("__before") + F.col("__own")).cast("long")).drop("__range", "__own", "__before")


# Models by version.


def save_model(rows: DataFrame, root: str, name: str, **about: str) -> int:
    """Write a fitted model's rows as the next version of its table and return the version.

    A version is a folder of its own, so readers of older ones are not disturbed; about is
    kept as columns of every row (method, split or parameters, as text).
    """
    spark = rows.sparkSession
    version = (latest_version(spark, root, name) or 0) + 1
    rows = rows.withColumns({k: F.lit(v) for k, v in about.items()})
    rows.write.mode("errorifexists").parquet(f"{root}/{name}/version={version}")
    return version


def latest_version(spark: SparkSession, root: str, name: str) -> int | None:
    """The newest version that was written whole."""
    where, fs = _path(spark, f"{root}/{name}")
    if not fs.exists(where):
        return None
    found = [s.getPath().getName() for s in fs.listStatus(where)]
    whole = [int(n[8:]) for n in found if re.fullmatch(r"version=\d+", n) and exists(spark, f"{root}/{name}/{n}/_SUCCESS")]
    return max(whole, default=None)


def load_model(spark: SparkSession, root: str, name: str, version: int | None = None) -> DataFrame:
    """The rows of a version of a model, the newest by default."""
    version = latest_version(spark, root, name) if version is None else version
    if version is None or not exists(spark, f"{root}/{name}/version={version}"):
        raise FileNotFoundError(f"no model {name} {'' if version is None else f'of version {version} '}under {root}")
    return spark.read.parquet(f"{root}/{name}/version={version}")
