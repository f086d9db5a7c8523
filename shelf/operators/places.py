"""Numbering rows within groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelf.scratch import materialize


def places(df: DataFrame, group: str, order: str, name: str = "place") -> DataFrame:
    """Add the place of each row in its group, from 0, in two steps.

    Rows are sorted over all tasks at once, so a group that holds most of them lies in many tasks, and each task's part of
    it is numbered from where the part before it ends.
    """
    ranged = df.repartitionByRange(group, order).sortWithinPartitions(group, order)
    # the number of the task and, in the lower 33 bits, of the row in it
    rows = materialize(ranged.withColumn("_at", F.monotonically_increasing_id()), "places")
    rows = rows.withColumn("_part", F.shiftright("_at", 33))
    runs = rows.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_begin"), F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy("_g").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("_g", "_p", (F.col("_begin") - F.coalesce(earlier, F.lit(0))).alias("_zero"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return rows.join(runs, same).withColumn(name, F.col("_at") - F.col("_zero")).select(*df.columns, name)
