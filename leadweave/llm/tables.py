"""Tables of the operators: given ones, and written ones between steps in the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leadweave.sources.shared import written

__all__ = ["fresh", "read", "written"]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{i or ''}" for i in range(len(taken) + 1)) if n not in taken)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
