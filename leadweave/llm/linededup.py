"""Line dedup by site-relative frequency: lines that stand on a large share of a host's pages go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.tables import fresh, written

#: Rows of the boilerplate table up to which it is broadcast (about 24 bytes each).
BROADCAST_ROWS = 200_000


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def drop_site_lines(
    df: DataFrame, host: Column, text_col: str = "text", ratio: float = 0.2, min_pages: int = 2, min_chars: int = 1, salts: int = 16,
    removed_col: str | None = None,
) -> DataFrame:
    r"""df with the lines of text_col dropped that stand on more than `ratio` of their host's pages.

    A line is a \n-split part of the text, compared without outer spaces; the share is pages of the
    host that contain it at least once, divided by all its pages; a line at the ratio itself stays. A line
    on fewer than `min_pages` pages stays, so that a host of one page keeps its text, and so do blank
    lines. Null hosts count as one host, null texts stay null, empty texts empty; a text has no limit;
    repeated rows are pages of their own; an empty table gives no rows. All columns of df come back, in
    order, whatever their names; `removed_col` adds the number of lines dropped.

    Lines are counted by (host, hash) with partial sums, so a hot host is spread by its lines. The
    table of boilerplate lines is broadcast if it has at most BROADCAST_ROWS rows; else rows meet it
    by host in a shuffle, salted so that a hot host's pages spread over `salts` tasks.
    """
    site, lines, drop, salt, mine = (fresh(df, x) for x in ("host", "lines", "drop", "salt", "mine"))
    text = F.col(f"`{text_col}`")
    base = df.withColumns({site: F.coalesce(host.cast("string"), F.lit("")), lines: F.split(F.coalesce(text, F.lit("")), "\n", -1)})
    said = F.filter(lines, lambda x: F.length(F.trim(x)) >= min_chars)
    keys = F.array_distinct(F.transform(said, _key))
    counted = base.select(F.col(site).alias("host"), F.explode(keys).alias("line")).groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= min_pages)
    pages = base.groupBy(F.col(site).alias("host")).agg(F.count("*").alias("pages"))
    # Written once: its size is checked below, and it is small against the pages.
    often = written(counted.join(pages, "host").where(F.col("n") > ratio * F.col("pages")).select("host", "line"), "lines")
    listed = often.groupBy(F.col("host").alias(site)).agg(F.collect_set("line").alias(drop))  # at most lines per page / ratio of a host
    if often.count() <= BROADCAST_ROWS:
        met = base.join(F.broadcast(listed), site, "left")
    else:
        spread = listed.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = base.withColumn(salt, F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")).join(spread, [site, salt], "left")
    # By a hash table once a page; the few that it has are then sought line by line.
    met = met.withColumn(mine, F.array_intersect(keys, F.coalesce(F.col(drop), F.expr("cast(array() as array<bigint>)"))))
    keep = F.filter(lines, lambda x: ~(F.array_contains(mine, _key(x)) & (F.length(F.trim(x)) >= min_chars)))
    new = F.when((F.size(mine) == 0) | text.isNull(), text).otherwise(F.array_join(keep, "\n"))
    out = [new.alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if removed_col:
        out.append(F.when(F.size(mine) == 0, F.lit(0)).otherwise(F.size(lines) - F.size(keep)).cast("bigint").alias(removed_col))
    return met.select(out)
