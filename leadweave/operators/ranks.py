"""Places within groups that don't put a group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.sources.shared import written


def with_place(df: DataFrame, groups: list[str], order: list[Column], place: str = "place", size: str | None = None) -> DataFrame:
    """df with each row's place within its group, from 1, by an order that leaves no ties; `size` adds the group's rows.

    Rows are dealt out by ranges of group and order, so a group with most of the rows is spread over as many
    tasks as its share. A range counts its rows of each group; what earlier ranges have of a group is
    added in front. Ranges are written, so that both steps see the same ones. Null groups are one group.
    """
    part = "_range"
    ranged = written(df.repartitionByRange(*groups, *order).withColumn(part, F.spark_partition_id()), "ranges")
    counts = ranged.groupBy(*groups, part).agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*groups).orderBy(part)  # a row per range of a group
    offsets = counts.withColumn("_before", F.sum("_rows").over(before) - F.col("_rows"))
    if size:
        offsets = offsets.withColumn(size, F.sum("_rows").over(Window.partitionBy(*groups)))
    offsets = offsets.select(*(F.col(g).alias(f"_{g}") for g in groups), F.col(part).alias("_of"), "_before", *([size] if size else []))
    same = F.col(part) == F.col("_of")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_{g}"))
    within = ranged.withColumn("_nth", F.row_number().over(Window.partitionBy(part, *groups).orderBy(*order)))
    out = within.join(offsets, same).withColumn(place, (F.col("_nth") + F.col("_before")).cast("bigint"))
    return out.select(*df.columns, place, *([size] if size else []))


def grouped_median(df: DataFrame, groups: list[str], value: str, out: str = "median") -> DataFrame:
    """(groups, out): the median of the values of each group that are there, exactly; null where none is.

    The mean of the middle two of an even number. No task holds a group's values: only the rows at the middle places are kept.
    """
    tie = "_row"
    some = df.where(F.col(value).isNotNull()).select(*groups, value).withColumn(tie, F.monotonically_increasing_id())
    placed = with_place(some, groups, [F.col(value), F.col(tie)], "_place", "_size")
    middle = placed.where("_place in (floor((_size + 1) / 2), floor((_size + 2) / 2))").groupBy(*groups).agg(F.avg(value).alias(out))
    every = df.select(*groups).distinct()
    met = F.lit(True)
    for g in groups:
        met = met & F.col(f"_{g}").eqNullSafe(F.col(g))
    return every.toDF(*(f"_{g}" for g in groups)).join(middle, met, "left").select(*(F.col(f"_{g}").alias(g) for g in groups), out)
