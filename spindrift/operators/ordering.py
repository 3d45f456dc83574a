"""Running totals and places in a global order, without one task per group: any group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.session import written


def running_total(rows: DataFrame, group: Sequence[str], order: Sequence[Column], weight: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``weight`` over the rows of the same group up to and with this one, in ``order``.

    The rows are put in order by range over all groups, so a large group spans many partitions; the sums of those
    slices (one row a group and partition) give each slice its start. Null groups are groups of their own.
    """
    keys = [F.col(c) for c in group]
    asc = [c for c in order]
    placed = rows.withColumn("_w", weight).repartitionByRange(*keys, *asc).withColumn("_p", F.spark_partition_id())
    placed, _ = written(placed, "ordered")
    slices = placed.groupBy(*group, "_p").agg(F.sum("_w").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(
        *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o")
    )
    own = Window.partitionBy("_p", *group).orderBy(*asc).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    on = [F.col("_p") == F.col("_q"), *[F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)]]
    return (
        placed.withColumn("_r", F.sum("_w").over(own))
            .join(starts, on, "left")
            .withColumn(name, F.col("_o") + F.col("_r"))
            .select(*rows.columns, name)
    )
