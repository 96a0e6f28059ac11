"""Helpers shared by the training-data operators."""

from __future__ import annotations

import codecs
import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The fixed word pattern of the windowed operators: runs without ASCII white space.
PLAIN_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer's file; LAGSPARK_TOKENIZERS names another folder."""
    folder = os.environ.get("LAGSPARK_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def checkpoint_dir(spark: SparkSession) -> None:
    """Make sure that a checkpoint folder is set.

    A cluster names a shared folder in ``spark.checkpoint.dir``. Where that is unset, a
    temporary folder takes its place on a local master, whose executors are this process;
    on any other master that is an error, as executors could not read each other's files.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lagspark-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """df computed once, its lineage replaced by files in the checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results in the file system that its path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    return unused(df, f"__{name}")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it while df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(id_col: str = "doc_id"):
    """True for the quarter of the ids that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def as_text(value: bytes | None) -> str:
    """Text of UTF-8 bytes; null is empty and each invalid byte becomes U+FFFD."""
    if value is None:
        return ""
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError:
        return value.decode("utf-8", "one_each")


def _one_each(error: UnicodeError) -> tuple[str, int]:
    return "�", error.start + 1


codecs.register_error("one_each", _one_each)
