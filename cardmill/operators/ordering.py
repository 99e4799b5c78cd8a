"""Positions and running sums that stay parallel when one group holds much of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardmill.session import by_shuffle, cut_lineage

CHUNK = 65_536


def running_total(
    df: DataFrame, group: Sequence[str], at: str, amount: str, name: str, width: int = CHUNK
) -> DataFrame:
    """Inclusive running sum of ``amount`` over integer ``at`` per group, in two levels.

    Rows fall into chunks of ``width`` consecutive ``at`` values. Chunk totals are aggregated before they
    are shuffled and summed up per group; the window over rows only ever sees one chunk.
    """
    chunked = df.withColumn("_chunk", F.floor(F.col(at) / width))
    totals = chunked.groupBy(*group, "_chunk").agg(F.sum(amount).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "_chunk", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*group, "_chunk").orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return (
        chunked.join(by_shuffle(offsets), [*group, "_chunk"])
        .withColumn(name, F.col("_offset") + F.sum(amount).over(inside))
        .drop("_chunk", "_offset")
    )


def position_in_group(df: DataFrame, group: Sequence[str], at: str, name: str, width: int = CHUNK) -> DataFrame:
    """1-based position by the unique integer ``at`` within its group."""
    return running_total(df.withColumn("_one", F.lit(1)), group, at, "_one", name, width).drop("_one")


def global_position(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Dense 0-based position in a total order over the whole table.

    Rows are range-partitioned and sorted; the partition sizes, one row each, give every partition
    its offset. The sorted rows are checkpointed so that both passes see the same partitions.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut_lineage(
        ranged.withColumn("_part", F.spark_partition_id()).withColumn(
            "_local", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)
        )
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count("*").alias("_n"))
        .select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    # One row per partition: bounded by the number of tasks, never by the data.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_part", "_local", "_offset")
    )
