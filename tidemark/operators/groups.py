"""Groups that several rules ask for: rows that share a key, and runs of consecutive numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared(rows: DataFrame, key: str, first: Column) -> DataFrame:
    """The rows whose key others have too, with n (rows of the key) and first (the smallest). Keys are counted by partial aggregates that are joined back, so the rows of a hot key stay spread."""
    groups = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(first).alias("first")).filter("n > 1")
    return rows.join(groups, key)


def islands(rows: DataFrame, by: str, at: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """by, island, first, last, n of each run of consecutive numbers: number less rank stays the same within a run. carried: columns that are the same for all rows of by."""
    rows = rows.withColumn("island", F.col(at) - F.row_number().over(W.partitionBy(by).orderBy(at)))
    return rows.groupBy(by, "island").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), *(F.first(c).alias(c) for c in carried))
