"""Ranks of rows within groups of any size, by ranges: no task holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize


def dealt(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """df by ranges of group and order, nulls first, with part, the range, and seq, which rises in order and by one within a part.

    Rows equal in all of these are told apart by their place in the input, so any number of them are split like others.
    """
    keys = [group, *order, "_at"]
    ranged = df.withColumn("_at", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")
    return materialize(ranged.withColumn("part", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()))


def starts(rows: DataFrame, group: str) -> DataFrame:
    """Of dealt rows: group, part, first (the least seq there), before (rows of the group in earlier parts) and n (rows of the group).

    A group has as many rows here as parts it reaches into.
    """
    own = Window.partitionBy(group)
    held = rows.groupBy(group, "part").agg(F.min("seq").alias("first"), F.count("*").alias("held"))
    before = F.sum("held").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("held")
    return held.withColumn("before", before).withColumn("n", F.sum("held").over(own)).drop("held")


def ranked(rows: DataFrame, at: DataFrame, group: str) -> DataFrame:
    """dealt rows with rank, from 0, and what else starts has of their group and part."""
    own = at.withColumnsRenamed({group: "_group", "part": "_part"})
    met = rows.join(own, F.col(group).eqNullSafe(F.col("_group")) & (F.col("part") == F.col("_part"))).drop("_group", "_part")
    return met.withColumn("rank", F.col("before") + F.col("seq") - F.col("first")).drop("before", "first", "seq")
