"""Running values and ranks over ordered groups of any size: within blocks or ranges first, then over their totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import cut

_ROW = 33  # bits of the row's number within its partition in monotonically_increasing_id


def carried(df: DataFrame, keys: list[str], block: Column, order: list[str], value: Column, name: str, before: bool = False) -> DataFrame:
    """df with column `name`: the largest value among its group's rows up to each row, or up to the one before it.

    block is a number that never falls along the order. Windows run within a block, and over the blocks' maxima.
    """
    df = df.withColumn("_block", block).withColumn("_v", value)
    here = Window.partitionBy(*keys, "_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    most = df.groupBy(*keys, "_block").agg(F.max("_v").alias("_m"))
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    most = most.select(*keys, "_block", F.max("_m").over(earlier).alias("_before"))
    out = df.withColumn("_local", F.max("_v").over(here)).join(most, [*keys, "_block"])
    return out.withColumn(name, F.coalesce("_local", "_before")).drop("_v", "_local", "_before", "_block")


def ranked(df: DataFrame, group: str, order: list[str | Column]) -> DataFrame:
    """df with `rank`, from 1 within each group (nulls are one) in this order, and `of`, the group's rows.

    The rows are sorted over ranges of (group, order) and written once; ranks are places in a range plus the group's rows
    in earlier ranges, so no group is sorted in one task.
    """
    at = F.monotonically_increasing_id()
    rows = cut(df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("_at", at)).withColumn("_part", F.shiftright("_at", _ROW))
    parts = rows.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    earlier = w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_done"), F.sum("_n").over(w).alias("of"))
    out = rows.join(parts, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_done") + 1).alias("rank"), "of")


def capped(df: DataFrame, group: str, order: list[str | Column], most: int) -> tuple[DataFrame, DataFrame]:
    """The first `most` rows of each group, and (group, kept, total, truncated) of each."""
    r = ranked(df, group, order)
    counts = df.groupBy(group).agg(F.count("*").alias("total"))
    report = counts.select(group, F.least("total", F.lit(most)).cast("long").alias("kept"), "total", (F.col("total") > most).alias("truncated"))
    return r.where(F.col("rank") <= most).select(*df.columns), report
