"""Segments, signals, features and the explainable weighted score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions.geo import MILE_M, distance_m
from leadweave.operators.routing import sized

# Signal types that tell of buying, default weights, tier cuts.
BUYING = ("permit", "hiring", "expansion", "news", "funding", "contract")
FEATURES = ("segment", "size", "facility", "signals", "proximity", "confidence")
WEIGHTS = (0.25, 0.15, 0.20, 0.25, 0.05, 0.10)
TIER_A, TIER_B, CAP_WITHOUT_SIGNAL = 80, 65, 79
RESEARCH = "facilityFit struct<level:string>, employeeEstimate struct<value:int>, llmAdjustment int"


def month_number(text: Column) -> Column:
    """Year * 12 + month of YYYY-MM or YYYY-MM-DD, null for anything else."""
    good = text.rlike(r"^\d{4}-(0[1-9]|1[0-2])(-\d{2})?$")
    return F.when(good, F.substring(text, 1, 4).cast("int") * 12 + F.substring(text, 6, 2).cast("int"))


def is_qualifying(kind: Column, date_text: Column, as_of_month: int) -> Column:
    age = F.lit(as_of_month) - month_number(date_text)
    return F.coalesce(kind.isin(*BUYING) & age.between(0, 11), F.lit(False))


def qualifying_signals(signals: DataFrame, as_of_month: int) -> DataFrame:
    return signals.groupBy("lead_id").agg(F.count_if(is_qualifying(F.col("type"), F.col("date_text"), as_of_month)).alias("n_signals"))


def top_signal(signals: DataFrame, as_of_month: int) -> DataFrame:
    """(lead_id, top_signal): qualifying first, then the latest month, then type; text cut at 90 characters."""
    order = Window.partitionBy("lead_id").orderBy(F.desc(is_qualifying(F.col("type"), F.col("date_text"), as_of_month)), F.desc_nulls_last(month_number(F.col("date_text"))), "type", "event_id")
    short = F.when(F.length("text") > 90, F.concat(F.substring("text", 1, 90), F.lit("…"))).otherwise(F.col("text"))
    line = F.concat(F.initcap("type"), F.lit(": "), short, F.lit(" ("), F.col("date_text"), F.lit(")"))
    return signals.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("lead_id", line.alias("top_signal"))


def match_segment(leads: DataFrame, segments: DataFrame) -> DataFrame:
    """(lead_id, match, segment, segment_min): taxonomy beats a keyword in the name, then profile order.

    segments: pos, segment, categories, keywords, min_employees; a profile's handful of rows, whose
    values are met by equality, and by substring for keywords.
    """
    path = F.transform(F.col("hierarchy"), F.lower)
    subject = leads.select("lead_id", F.lower("name").alias("name"), F.array_distinct(F.concat(path, F.array(F.lower("leaf")))).alias("path"))
    cats = sized(segments.select("pos", "segment", "min_employees", F.explode("categories").alias("c")).withColumn("c", F.lower("c")))
    words = sized(segments.select("pos", "segment", "min_employees", F.explode("keywords").alias("w")).withColumn("w", F.lower("w")))
    by_path = subject.select("lead_id", F.explode("path").alias("c")).join(cats, "c").select("lead_id", F.lit(0).alias("kind"), "pos", "segment", "min_employees")
    by_word = subject.join(words, F.col("name").contains(F.col("w"))).select("lead_id", F.lit(1).alias("kind"), "pos", "segment", "min_employees")
    best = by_path.unionByName(by_word).groupBy("lead_id").agg(F.min(F.struct("kind", "pos", "segment", "min_employees")).alias("s"))
    return best.select("lead_id", F.when(F.col("s.kind") == 0, "taxonomy").otherwise("keyword").alias("match"), F.col("s.segment").alias("segment"), F.col("s.min_employees").alias("segment_min"))


def research_facts(docs: DataFrame, column: str = "document") -> DataFrame:
    """docs with level, employees and adjustment; unknown levels and documents that can't be read give null."""
    read = F.from_json(column, RESEARCH)
    level = F.lower(read["facilityFit"]["level"])
    return docs.withColumns({"level": F.when(level.isin("high", "medium", "low", "unknown"), level), "employees": read["employeeEstimate"]["value"], "adjustment": read["llmAdjustment"]})


def extract_features(leads: DataFrame, branches: DataFrame, research: DataFrame, signals: DataFrame, segments: DataFrame, as_of_month: int, profile_min: int | None = None) -> DataFrame:
    """A wide row per lead; before enrichment the keyword count is null and the site not reachable."""
    place = sized(branches.select("branch_id", "dealer_id", "branch_lat", "branch_lon"))
    miles = distance_m(F.col("lat"), F.col("lon"), F.col("branch_lat"), F.col("branch_lon")) / MILE_M
    facts = research_facts(research).select("lead_id", "level", "employees", "adjustment")
    return (
        leads.join(match_segment(leads, segments), "lead_id", "left").join(facts, "lead_id", "left")
        .join(qualifying_signals(signals, as_of_month), "lead_id", "left").join(place, ["branch_id", "dealer_id"], "left")
        .withColumns({"n_signals": F.coalesce("n_signals", F.lit(0)), "branch_miles": miles, "min_employees": F.coalesce(F.col("segment_min"), F.lit(profile_min).cast("int")), "keyword_count": F.lit(None).cast("int"), "reachable": F.lit(False)})
        .drop("branch_lat", "branch_lon")
    )


def score_features(df: DataFrame) -> DataFrame:
    """df with the six values v_*, each from 0 to 1."""
    c = F.col
    segment = F.when(c("match") == "taxonomy", 1.0).when(c("match") == "keyword", 0.8).when(c("match") == "website", 0.6).otherwise(0.2)
    size = F.when(c("employees").isNull() | c("min_employees").isNull(), 0.5).when(c("employees") >= c("min_employees"), 1.0).when(c("employees") * 2 >= c("min_employees"), 0.5).otherwise(0.1)
    facility = (
        F.when(c("level") == "high", 1.0).when(c("level") == "medium", 0.75).when(c("level") == "low", 0.5).when(c("level") == "unknown", 0.4)
        .when(c("keyword_count").isNull(), 0.4).when(c("keyword_count") == 0, 0.2).when(c("keyword_count") == 1, 0.5).when(c("keyword_count") == 2, 0.75).otherwise(1.0)
    )
    signals = F.when(c("n_signals") == 0, 0.0).when(c("n_signals") == 1, 0.6).otherwise(1.0)
    near = F.when(c("branch_miles").isNull(), 0.0).when(c("branch_miles") <= 25, 1.0).when(c("branch_miles") <= 50, 0.6).otherwise(0.3)
    sure = F.lit(0.7) * c("confidence") + F.when(c("reachable"), 0.3).otherwise(0.0)
    return df.withColumns(dict(zip([f"v_{f}" for f in FEATURES], (segment, size, facility, signals, near, sure), strict=True)))


def score(df: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """df with base, adjust, total, grade and capped_from: a sum in fixed order, rounded half away from zero."""
    w = [F.col(f"w_{f}") if f"w_{f}" in df.columns else F.lit(x) for f, x in zip(FEATURES, weights, strict=True)]
    term = [F.col(f"v_{f}") * x for f, x in zip(FEATURES, w, strict=True)]
    base = F.round((term[0] + term[1] + term[2] + term[3] + term[4] + term[5]) * 100.0).cast("int")
    adjust = F.greatest(F.lit(-15), F.least(F.lit(15), F.coalesce("adjustment", F.lit(0))))
    free = F.greatest(F.lit(0), F.least(F.lit(100), base + adjust))
    capped = F.when(F.col("n_signals") == 0, F.least(free, F.lit(CAP_WITHOUT_SIGNAL))).otherwise(free)
    out = df.withColumns({"base": base, "adjust": adjust, "total": capped, "capped_from": F.when(capped < free, free)})
    return out.withColumn("grade", F.when(F.col("total") >= TIER_A, "A").when(F.col("total") >= TIER_B, "B").otherwise("C"))


def score_breakdown(df: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """A row per lead and feature: value, weight, contribution to 4 decimals; columns w_* go before `weights`."""
    w = [F.col(f"w_{f}") if f"w_{f}" in df.columns else F.lit(x) for f, x in zip(FEATURES, weights, strict=True)]
    each = F.array(*(F.struct(F.lit(i).alias("pos"), F.lit(f).alias("feature"), F.round(F.col(f"v_{f}"), 4).alias("value"), x.alias("weight"), F.round(F.col(f"v_{f}") * x * 100.0, 4).alias("contribution")) for i, (f, x) in enumerate(zip(FEATURES, w, strict=True))))
    return df.select("lead_id", F.inline(each))


def resolve_weights(campaigns: DataFrame) -> DataFrame:
    """campaigns (campaign_id, override_json, profile_json) with six weights, or an error.

    The override goes before the profile, that before the default; a missing key is 0. Keys must be
    known, values lie between 0 and 1 and sum to 1 within 0.001.
    """
    chosen = F.coalesce("override_json", "profile_json")
    given = F.from_json(chosen, "map<string,double>")
    total = F.aggregate(F.map_values(given), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    error = (
        F.when(chosen.isNull(), F.lit(None)).when(given.isNull(), "not a map of weights")
        .when(F.size(F.array_except(F.map_keys(given), F.array(*map(F.lit, FEATURES)))) > 0, "unknown key")
        .when(F.exists(F.map_values(given), lambda x: x.isNull() | (x < 0) | (x > 1)), "value outside 0 to 1")
        .when(F.abs(total - 1.0) > 0.001, "sum is not 1")
    )
    w = {f"w_{f}": F.when(error.isNull(), F.when(chosen.isNull(), F.lit(x)).otherwise(F.coalesce(F.element_at(given, f), F.lit(0.0)))) for f, x in zip(FEATURES, WEIGHTS, strict=True)}
    return campaigns.withColumns(w | {"error": error})


def score_campaign(scored: DataFrame) -> DataFrame:
    """Rows whose score or tier differs from the stored one; duplicates and suppressed leads aside."""
    return scored.where("status not in ('duplicate', 'suppressed')").where(~(F.col("score").eqNullSafe(F.col("total")) & F.col("tier").eqNullSafe(F.col("grade"))))


def score_leads(features: DataFrame, weights: DataFrame) -> DataFrame:
    """Leads scored with the weights of their campaign, as resolve_weights gives them; leads of a campaign with an error aren't scored."""
    fine = weights.where("error is null").select("campaign_id", *(f"w_{f}" for f in FEATURES))
    return score(score_features(features.join(sized(fine), "campaign_id")))


def score_summary(scored: DataFrame, *keys: str) -> DataFrame:
    live = F.col("status").isin("duplicate", "suppressed") == F.lit(False)
    grade = F.col("grade")
    differs = ~(F.col("score").eqNullSafe(F.col("total")) & F.col("tier").eqNullSafe(grade))
    return scored.groupBy(*keys).agg(
        F.count_if(live).alias("scored"), F.count_if(F.col("status") == "suppressed").alias("skipped"), F.count_if(live & differs).alias("changed"),
        *(F.count_if(live & (grade == g)).alias(f"tier_{g.lower()}") for g in "ABC"),
    )
