"""Positions of rows in a total order within each group, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadentia.llm.common import written


def in_order(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows as a written table with place, a long that ascends in the order of `by` (nulls first) over the whole table.

    Rows are dealt by ranges, so a hot key spreads over many tasks, and a number of their own breaks the ties of rows that are
    equal in all of `by`, so that the ranges can split any run of them."""
    by = [*by, "own_number"]
    numbered = rows.withColumn("own_number", F.monotonically_increasing_id())
    placed = numbered.repartitionByRange(*by).sortWithinPartitions(*by).drop("own_number")
    return written(placed.withColumn("place", F.monotonically_increasing_id()), name)


def in_groups(placed: DataFrame, group: str, name: str) -> DataFrame:
    """The columns of a table of in_order() whose order begins with `group`, without place but with rank (long, from 0) and n
    (rows of the group); a null group is a group.

    A row's place, less that of the group's first row in its part, is raised by the group's counts in the parts before.  The table
    of counts has a row per part and group; Spark joins it by its measured size."""
    placed = placed.withColumn("part", F.shiftright("place", 33))
    counts = placed.groupBy("part", F.col(group).alias("of_group")).agg(F.count("*").alias("here"), F.min("place").alias("first"))
    whole = Window.partitionBy("of_group")
    along = whole.orderBy("part")
    starts = counts.select(
        F.col("part").alias("of_part"), "of_group", (F.sum("here").over(along) - F.col("here") - F.col("first")).alias("shift"), F.sum("here").over(whole).alias("n")
    )
    at = (F.col("part") == F.col("of_part")) & F.col(group).eqNullSafe(F.col("of_group"))
    ranked = placed.join(written(starts, f"{name}-starts"), at).withColumn("rank", F.col("place") + F.col("shift"))
    return ranked.drop("part", "of_part", "of_group", "place", "shift")


def ranked(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """The columns of rows with rank and n, by `order` within `group`."""
    return in_groups(in_order(rows, [group, *order], f"{name}-placed"), group, name)
