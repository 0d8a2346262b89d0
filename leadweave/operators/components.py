"""Connected components of an edge table in logarithmic rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from leadweave.sources.shared import step_path


def _counted(edges: DataFrame) -> tuple[DataFrame, dict]:
    """The edges from a written table, and what tells it from another: its rows and the sum of their hashes."""
    path, seen = step_path(edges.sparkSession, "edges"), Observation()
    edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
    return edges.sparkSession.read.schema(edges.schema).parquet(path), seen.get


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id that an edge names; component is the smallest id reachable.

    Alternates large-star and small-star steps, so a long chain takes a logarithmic number of rounds
    and a hub is reduced by a partial minimum before the shuffle. Each round is one job that writes to the
    folder in spark.checkpoint.dir and counts what it writes, until that doesn't change. Edges with a null
    end and loops add nothing; repeated edges do no harm; no edges give no rows.
    """
    now, seen = _counted(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        now, state = _counted(_small_star(_large_star(now)))
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    members = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return members.unionByName(roots)
