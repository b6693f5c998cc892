"""Numbers of input rows, so that rows which share a key, or have none, stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The column of the numbers. A table that has it keeps its own, so that operators can be chained.
ROW = "loom_row"


def numbered(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The columns with a number of each input row.

    The numbers follow Spark's partitions, so reading the same files again gives the same ones.
    """
    if ROW not in docs.columns:
        docs = docs.withColumn(ROW, F.monotonically_increasing_id())
    return docs.select(ROW, *(c for c in columns if not isinstance(c, str) or c != ROW))


def spread(docs: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by the hash of the keys, or of the row's number, over spark.sql.shuffle.partitions tasks.

    A file is read by as few tasks as it has row groups, however many rows they hold. So what is costly
    for each row is worked out after this; give it only the columns that are needed.
    """
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), *(keys or (ROW,)))


def by_row(key: str) -> list[str]:
    """The columns that name one input row."""
    return [ROW] if key == ROW else [ROW, key]


def names_of(docs: DataFrame, key: str) -> list[str]:
    """The columns that name a row in a result with one row for each: the number only where docs has it."""
    return by_row(key) if ROW in docs.columns else [key]
