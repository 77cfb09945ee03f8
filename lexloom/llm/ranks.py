"""Positions of rows inside groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.scratch import materialize

#: monotonically_increasing_id() has the partition above this bit, and the row in it below.
_PART_BIT = 33


def positions(rows: DataFrame, group: str, order: list[str | Column], name: str = "pos") -> DataFrame:
    """rows and `name`: the place (from 0) of each row in its group by `order` (ascending, nulls first).

    Rows are sorted over ranges of (group, order), so a group that holds most rows lies in many ranges.  What is
    summed over a group is one count for each of its ranges.  Rows that are equal in group and order are told
    apart by their place in the input, so they may fill several ranges too.  `rows` is read twice: pass a table.
    `group` must not be null.  An empty table gives an empty table.
    """
    names = rows.columns
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    sorted_rows = tied.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    ordered = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id()), "ordered")
    part = F.shiftright("_at", _PART_BIT)
    runs = ordered.groupBy(group, part.alias("_part")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(group).orderBy("_part")) - F.col("_n")
    shifts = materialize(runs.select(group, "_part", (before - F.col("_first")).alias("_shift")), "shifts")
    return ordered.withColumn("_part", part).join(shifts, [group, "_part"]).select(*names, (F.col("_at") + F.col("_shift")).alias(name))
