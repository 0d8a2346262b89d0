"""Imports: reference tables, dealer lists with row errors, merges, stored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.functions.normalize import address_norm, domain_key, name_norm, row_digest, zip5
from leadweave.operators.geography import with_box
from leadweave.operators.routing import sized

REASONS = ("customer", "dnc", "dealer", "competitor", "other")
REQUIRED = {
    "dealers": ("dealer_id", "dealer_name", "branch_id", "lat", "lon"),
    "territories": ("dealer_id", "level", "code"),
    "suppression": ("company_name",),
}
LISTED_ERRORS = 50


def load_counties(df: DataFrame) -> DataFrame:
    """Counties with their rings and box."""
    return with_box(df.select(F.lpad("geoid", 5, "0").alias("geoid"), F.trim("name").alias("name"), F.lpad("statefp", 2, "0").alias("statefp"), "rings"))


def load_cbsa(df: DataFrame) -> DataFrame:
    """Rows with an area and a county; codes padded and joined, texts trimmed."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    fine = df.where(~blank("cbsa_code") & ~blank("state_code") & ~blank("county_code") & F.trim("cbsa_code").rlike(r"^\d{5}$"))
    geoid = F.concat(F.lpad(F.trim("state_code"), 2, "0"), F.lpad(F.trim("county_code"), 3, "0"))
    return fine.select(F.trim("cbsa_code").alias("cbsa_code"), *(F.trim(c).alias(c) for c in ("cbsa_title", "area_type")), geoid.alias("county_geoid"), *(F.trim(c).alias(c) for c in ("county_name", "state_name", "central_outlying")))


def load_zcta_county(spark: SparkSession, path: str) -> DataFrame:
    """Pipe-delimited file, a byte order mark on its first header dropped; rows without both codes are dropped."""
    df = spark.read.csv(path, sep="|", header=True, inferSchema=False)
    return zcta_county(df.toDF(*(c.lstrip("﻿").strip() for c in df.columns)))


def zcta_county(df: DataFrame) -> DataFrame:
    a, b = F.trim("GEOID_ZCTA5_20"), F.trim("GEOID_COUNTY_20")
    return df.where((F.coalesce(a, F.lit("")) != "") & (F.coalesce(b, F.lit("")) != "")).select(F.lpad(a, 5, "0").alias("zcta5"), F.lpad(b, 5, "0").alias("county_geoid")).distinct()


def required_columns(df: DataFrame, kind: str) -> DataFrame:
    """df with trimmed, lower-case headers, without all-blank rows; fails if a header is missing."""
    named = df.toDF(*(c.strip().lower() for c in df.columns))
    missing = [c for c in REQUIRED[kind] if c not in named.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    filled = F.lit(False)
    for c in named.columns:
        if c != "row":
            filled = filled | (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "")
    return named.where(filled)


def _split(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    checked = df.withColumn("error", error)
    return checked.where("error is null").drop("error"), checked.where("error is not null").select("row", "error")


def import_dealers(df: DataFrame, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects). owners (branch_id, dealer_id) are known branches: another dealer can't take one over."""
    need = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    rows = df.withColumns({"dealer_id": F.lower(F.trim("dealer_id")), "branch_id": F.lower(F.trim("branch_id")), "lat": F.col("lat").try_cast("double"), "lon": F.col("lon").try_cast("double"), "state": F.upper(F.trim("state")), "zip": zip5(F.col("zip"))})
    if owners is not None:
        rows = rows.join(sized(owners.select("branch_id", F.col("dealer_id").alias("_owner"))), "branch_id", "left")
    else:
        rows = rows.withColumn("_owner", F.lit(None).cast("string"))
    # In one file the first row of a branch says whose it is.
    first = Window.partitionBy("branch_id").orderBy("row")
    rows = rows.withColumn("_first", F.first("dealer_id").over(first))
    error = (
        F.when(need("dealer_id"), "dealer_id is required").when(need("dealer_name"), "dealer_name is required").when(need("branch_id"), "branch_id is required")
        .when(F.col("lat").isNull() | ~F.col("lat").between(-90, 90), "lat is not a latitude").when(F.col("lon").isNull() | ~F.col("lon").between(-180, 180), "lon is not a longitude")
        .when(F.coalesce("_owner", "_first") != F.col("dealer_id"), "branch belongs to another dealer")
    )
    good, bad = _split(rows, error)
    return good.drop("_owner", "_first"), bad


def import_territories(df: DataFrame, dealers: DataFrame, branches: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = df.withColumns({"dealer_id": F.lower(F.trim("dealer_id")), "branch_id": F.nullif(F.lower(F.trim("branch_id")), F.lit("")), "level": F.lower(F.trim("level")), "code": F.trim("code"), "_p": F.nullif(F.trim("priority"), F.lit(""))})
    rows = rows.join(sized(dealers.select("dealer_id", F.lit(True).alias("_known")).distinct()), "dealer_id", "left")
    rows = rows.join(sized(branches.select("branch_id", F.col("dealer_id").alias("_owner"))), "branch_id", "left").withColumn("priority", F.when(F.col("_p").isNull(), 1).otherwise(F.col("_p").try_cast("int")))
    error = (
        F.when(F.col("_known").isNull(), "unknown dealer").when(F.col("branch_id").isNotNull() & F.col("_owner").isNull(), "unknown branch").when(F.col("_owner") != F.col("dealer_id"), "branch of another dealer")
        .when(~F.coalesce(F.col("level").isin("zip", "county"), F.lit(False)), "level is zip or county").when(~F.coalesce(F.col("code").rlike(r"^\d{5}$"), F.lit(False)), "code has five digits")
        .when(F.col("priority").isNull() | (F.col("priority") < 1), "priority is a whole number from 1")
    )
    good, bad = _split(rows, error)
    return good.drop("_known", "_owner", "_p"), bad


def import_suppression(df: DataFrame, default_reason: str | None = None) -> tuple[DataFrame, DataFrame]:
    if default_reason is not None and default_reason not in REASONS:
        raise ValueError("unknown reason")
    reason = F.coalesce(F.nullif(F.lower(F.trim("reason")), F.lit("")), F.lit(default_reason), F.lit("other"))
    rows = df.withColumns({"name_norm": name_norm(F.col("company_name")), "domain_key": domain_key(F.col("domain")), "zip5": zip5(F.col("zip")), "address_norm": address_norm(F.col("address")), "reason": reason})
    error = F.when(F.coalesce(F.trim("company_name"), F.lit("")) == "", "company_name is required").when(F.col("name_norm") == "", "company_name has no letters or digits").when(~F.col("reason").isin(*REASONS), "unknown reason")
    good, bad = _split(rows, error)
    return good.withColumn("rule_id", row_digest("s_", F.col("name_norm"), F.col("domain_key"), F.col("zip5"), F.col("address_norm"))), bad


def merge_list(current: DataFrame, incoming: DataFrame, key: str, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """(merged, counts): upsert by key, of repeated keys in a file the last row; `replace` drops keys the file doesn't name.

    current and incoming have the same columns, incoming `row` besides. A repeated key counts as updated.
    """
    last = Window.partitionBy(key).orderBy(F.desc("row"))
    new = incoming.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn", "row")
    kept = current.join(new.select(key), key, "left_anti")
    merged = new if replace else kept.unionByName(new)
    known = current.select(F.col(key), F.lit(1).alias("_old"))
    tally = incoming.groupBy(key).agg(F.count("*").alias("n")).join(known, key, "left").agg(
        F.coalesce(F.sum(F.when(F.col("_old").isNull(), 1).otherwise(0)), F.lit(0)).alias("imported"),
        F.coalesce(F.sum(F.when(F.col("_old").isNull(), F.col("n") - 1).otherwise(F.col("n"))), F.lit(0)).alias("updated"),
    )
    gone = kept.agg((F.count("*") if replace else F.lit(0).cast("bigint") * F.count("*")).alias("removed"))
    return merged, tally.crossJoin(gone)  # one row each


def listed_errors(rejects: DataFrame) -> DataFrame:
    return rejects.orderBy("row").limit(LISTED_ERRORS)


def numbered(df: DataFrame, order: list[Column], start: Column | int = 0, out: str = "number") -> DataFrame:
    """Contiguous numbers in a global order without one task for all: sizes of range partitions are added up in front."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    within = ranged.withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_size"))
    # A row per partition.
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_size")
    return within.join(F.broadcast(offsets), "_part").withColumn(out, (F.col("_n") + F.col("_before") + start).cast("bigint")).drop("_part", "_n", "_before")


def store_candidates(deduped: DataFrame, sites: DataFrame, leads: DataFrame, campaign_id: str | None = None) -> DataFrame:
    """New lead rows: of places the campaign has none of; duplicates as such; known sites keep their company; ids go on from the largest.

    Without a campaign_id, deduped has a column of that name, and every campaign counts on for itself.
    """
    if campaign_id is not None:
        deduped = deduped.withColumn("campaign_id", F.lit(campaign_id))
    new = deduped.join(leads.select("campaign_id", "site_id"), ["campaign_id", "site_id"], "left_anti")
    company = sites.select("site_id", F.col("company_id").alias("_known"))
    met = new.join(company, "site_id", "left").withColumn("company_id", F.coalesce("_known", row_digest("co_", F.col("component")))).drop("_known")
    every = numbered(met, [F.col("campaign_id"), F.col("site_id")])
    first = every.groupBy("campaign_id").agg(F.min("number").alias("_first"))
    top = leads.groupBy("campaign_id").agg(F.max(F.substring("lead_id", 2, 12).try_cast("bigint")).alias("_top"))
    out = every.join(first.join(top, "campaign_id", "left"), "campaign_id")
    number = (F.col("number") - F.col("_first") + 1 + F.coalesce("_top", F.lit(0))).cast("string")
    return out.select("campaign_id", F.concat(F.lit("L"), F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("lead_id"), "site_id", "company_id", F.when(F.col("is_primary"), "candidate").otherwise("duplicate").alias("status"))


def clear_candidates(leads: DataFrame, research: DataFrame, campaign: str | DataFrame) -> DataFrame:
    """leads without the candidates, duplicates and suppressed that have no research, of a campaign or of a table of campaign_id."""
    if isinstance(campaign, str):
        cleared, rest = leads.where(F.col("campaign_id") == campaign), leads.where(F.col("campaign_id") != campaign)
    else:
        cleared, rest = leads.join(campaign.select("campaign_id"), "campaign_id", "left_semi"), leads.join(campaign.select("campaign_id"), "campaign_id", "left_anti")
    goes = F.col("status").isin("candidate", "duplicate", "suppressed")
    studied = research.select("campaign_id", "lead_id").distinct()
    kept = cleared.where(~goes).unionByName(cleared.where(goes).join(studied, ["campaign_id", "lead_id"], "left_semi").select(leads.columns))
    return rest.select(leads.columns).unionByName(kept.select(leads.columns))
