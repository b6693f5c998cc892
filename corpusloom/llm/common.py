"""Shared folder, written intermediate tables and input columns for the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session gets a temporary folder; a cluster session is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    where = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the tables that written() made within it, but for lasting ones.

    What is to be kept must be written by then: a DataFrame that still reads the others is lost.
    """
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.pop()
        for path in made:
            remove_folder(spark, path)


def written(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    if _SCRATCH and not lasting:
        _SCRATCH[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most: int = 1_000_000) -> DataFrame:
    """A written table as a broadcast side of a join if it has few rows; as it is, for a shuffled join, if not."""
    return F.broadcast(df) if df.count() <= most else df


def joined(left: DataFrame, right: DataFrame, on: list[str], spread: Column, how: str = "inner", salts: int = 16, most: int = 1_000_000) -> DataFrame:
    """left.join(right, on, how), where right is a written table with one row for each key.

    A small right side is broadcast. Beyond that both sides are dealt by key and a salt, which is the
    hash of ``spread`` of left's row, so that a key with many rows of left is no single task.
    """
    if right.count() <= most:
        return left.join(F.broadcast(right), on, how)
    salt = free_name(left, "salt")
    dealt = left.withColumn(salt, F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return dealt.join(right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), [*on, salt], how).drop(salt)


def remove(df: DataFrame) -> None:
    """Deletes the folder of a table made by written()."""
    files = df.inputFiles()
    if files:
        remove_folder(df.sparkSession, files[0].rpartition("/")[0])


def remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast(T.StringType()), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that the table does not use, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
