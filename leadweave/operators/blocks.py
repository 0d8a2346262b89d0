"""Large blocks of a similarity join, split so that their pairs spread over tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of the left side that a part of a block has, about.
PART_ROWS = 1000


def split_blocks(left: DataFrame, right: DataFrame, keys: list[str], part_rows: int = PART_ROWS, by: list[str] | None = None) -> tuple[DataFrame, DataFrame, list[str]]:
    """(left, right, keys with the part): each pair of rows with equal keys has equal keys once, as before.

    A block of n rows on the left is cut into n / part_rows parts, by a hash of the row or of its columns `by`, and the right
    rows of such a block are copied to each. Sizes come from partial counts; the few large blocks are all that is joined back.
    """
    sizes = left.groupBy(*keys).agg(F.ceil(F.count("*") / part_rows).cast("int").alias("_parts")).where("_parts > 1")
    parts = F.coalesce("_parts", F.lit(1))
    cut = left.join(sizes, keys, "left").withColumn("_part", F.pmod(F.xxhash64(*(by or left.columns)), parts).cast("int")).drop("_parts")
    copied = right.join(sizes, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return cut, copied, [*keys, "_part"]
