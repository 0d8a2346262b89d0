"""Suppression and dealer routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.functions.geo import distance_m
from leadweave.functions.similarity import letters, may_reach, similarity
from leadweave.operators.blocks import split_blocks
from leadweave.operators.ranks import with_place
from leadweave.sources.shared import written

#: Bytes, by the statistics of its plan, of a rule or dealer list up to which it is broadcast.
BROADCAST_BYTES = 8 << 20
#: Degrees of a side of the cells in which leads look for their closest branch.
NEAR_CELL = 0.02


def sized(df: DataFrame) -> DataFrame:
    """df with a broadcast hint if its plan says that it is small; no job runs for that.

    What the plan can't tell is joined by shuffle, and adaptive execution broadcasts it if it turns out small.
    """
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return F.broadcast(df) if int(str(size)) <= BROADCAST_BYTES else df


def match_suppression(subjects: DataFrame, rules: DataFrame, threshold: float = 0.92, whole: bool = False) -> DataFrame:
    """(lead_id, rule_id, kind, reason, similarity) of the first hit: domain, then name, then fuzzy; within a kind by rule id.

    subjects: lead_id, name_norm, domain_key, zip5. rules: rule_id, name_norm, domain_key, zip5, reason.
    A fuzzy hit needs equal ZIPs, an exact name only where the rule has one. An empty name stops after
    the domain. `whole` is the form of the similarity. Distinct (name, ZIP) pairs are compared once, however many subjects and rules share them, in
    parts of large ZIPs, and only those whose letters allow the similarity go to the function.
    """
    s = subjects.select("lead_id", F.col("name_norm").alias("sn"), F.col("domain_key").alias("sd"), F.col("zip5").alias("sz"))
    r = rules.select("rule_id", F.col("name_norm").alias("rn"), F.col("domain_key").alias("rd"), F.col("zip5").alias("rz"), "reason")
    by_domain = s.join(r.groupBy("rd").agg(F.min_by(F.struct("rule_id", "reason"), "rule_id").alias("r")), F.expr("sd = rd")).select("lead_id", F.lit(0).alias("kind"), "r.*", F.lit(1.0).alias("similarity"))
    named = s.where("sn <> ''")
    # Of the rules with one name, or one name and ZIP, the first by id is met, however many there are.
    lead_rule = F.min_by(F.struct("rule_id", "reason"), "rule_id").alias("r")
    hit = lambda df: df.select("lead_id", F.lit(1).alias("kind"), "r.*", F.lit(1.0).alias("similarity"))
    anywhere = r.where("rn <> '' and rz is null").groupBy("rn").agg(lead_rule)
    there = r.where("rn <> '' and rz is not null").groupBy("rn", "rz").agg(lead_rule)
    exact = hit(named.join(anywhere, F.expr("sn = rn"))).unionByName(hit(named.join(there, F.expr("sn = rn and sz = rz"))))
    keys = named.where("sz is not null").select("sn", F.col("sz").alias("z")).distinct().withColumn("sl", letters(F.col("sn")))
    left, right, block = split_blocks(keys, there.select("rn", F.col("rz").alias("z"), "r", letters(F.col("rn")).alias("rl")), ["z"])
    close = (
        left.join(right, block).where("sn <> rn").where(may_reach(F.col("sn"), F.col("rn"), F.col("sl"), F.col("rl"), threshold))
        .withColumn("similarity", similarity(F.col("sn"), F.col("rn"), whole)).where(F.col("similarity") >= threshold)
        .groupBy("sn", F.col("z").alias("sz")).agg(F.min_by(F.struct("r.rule_id", "r.reason", "similarity"), "r.rule_id").alias("r"))
    )
    fuzzy = named.join(close, ["sn", "sz"]).select("lead_id", F.lit(2).alias("kind"), "r.rule_id", "r.reason", "r.similarity")
    hits = by_domain.unionByName(exact).unionByName(fuzzy)
    first = hits.groupBy("lead_id").agg(F.min_by(F.struct("kind", "rule_id", "reason", "similarity"), F.struct("kind", "rule_id")).alias("h")).select("lead_id", "h.*")
    return first.withColumn("kind", F.element_at(F.array(*map(F.lit, ("domain", "name", "fuzzy"))), F.col("kind") + 1))


def apply_suppression(leads: DataFrame, hits: DataFrame) -> DataFrame:
    """leads after suppression and release, with `changed`, `newly` and `restored`.

    Duplicates aren't touched. A hit lead becomes suppressed and remembers its status; it keeps a dealer
    only as an override. A suppressed lead without a hit gets its remembered status back, else candidate.
    """
    met = leads.join(hits.select("lead_id", F.col("rule_id").alias("h_rule"), F.col("reason").alias("h_reason")), "lead_id", "left")
    live, hit, was = F.col("status") != "duplicate", F.col("h_rule").isNotNull(), F.col("status") == "suppressed"
    on, off = live & hit, live & ~hit & was
    keeps = F.coalesce(F.col("assignment") == "override", F.lit(False))
    new = {
        "status": F.when(on, "suppressed").when(off, F.coalesce("pre_status", F.lit("candidate"))).otherwise(F.col("status")),
        "pre_status": F.when(on, F.when(was, F.col("pre_status")).otherwise(F.col("status"))).when(off, F.lit(None)).otherwise(F.col("pre_status")),
        "suppress_reason": F.when(on, F.col("h_reason")).when(off, F.lit(None)).otherwise(F.col("suppress_reason")),
        "dealer_id": F.when(on & ~keeps, F.lit(None)).otherwise(F.col("dealer_id")),
        "branch_id": F.when(on & ~keeps, F.lit(None)).otherwise(F.col("branch_id")),
        "assignment": F.when(on & ~keeps, F.lit(None)).otherwise(F.col("assignment")),
    }
    same = F.lit(True)
    for c, e in new.items():
        same = same & F.col(c).eqNullSafe(e)
    flags = {"changed": ~same, "newly": on & ~was, "was_approved": on & ~was & (F.col("status") == "approved"), "restored": off}
    return met.withColumns({f"_{c}": e for c, e in (new | flags).items()}).select(
        *(F.col(f"_{c}").alias(c) if c in new else F.col(c) for c in leads.columns), *(F.col(f"_{c}").alias(c) for c in flags), "h_reason"
    )


def suppression_summary(after: DataFrame) -> DataFrame:
    """A row per reason and one for all (null reason): suppressed, changed, approvals newly suppressed, restored."""
    count = lambda c: F.count_if(c)
    now = F.col("status") == "suppressed"
    total = after.agg(count(now).alias("suppressed"), count("changed").alias("changed"), count("was_approved").alias("approvals"), count("restored").alias("restored")).withColumn("reason", F.lit("(all)"))
    by = after.where(now).groupBy(F.coalesce("suppress_reason", F.lit("(none)")).alias("reason")).agg(F.count("*").alias("suppressed"), count("changed").alias("changed"), count("was_approved").alias("approvals"), count("restored").alias("restored"))
    return total.select(*by.columns).unionByName(by)


def leading_rules(rules: DataFrame) -> DataFrame:
    """The rules of each (level, code) that can win: those of the least priority, and of equal places the first by dealer and branch."""
    least = rules.groupBy("level", "code").agg(F.min("priority").alias("_least"))
    # Null-safe, since a null priority comes before all others; a null level or code meets no lead.
    top = rules.join(least.toDF("_level", "_code", "_least"), F.expr("level = _level and code = _code")).where(F.col("priority").eqNullSafe(F.col("_least")) | F.col("priority").isNull())
    return top.groupBy("level", "code", "priority", "branch_lat", "branch_lon").agg(F.min_by(F.struct("dealer_id", "branch_id"), F.struct("dealer_id", F.coalesce("branch_id", F.lit("")))).alias("_r")).select("_r.*", "level", "code", "priority", "branch_lat", "branch_lon")


def assign_territory(leads: DataFrame, territories: DataFrame, branches: DataFrame) -> DataFrame:
    """(lead_id, dealer_id, branch_id, level, miles): ZIP rules before county rules, then priority, distance, dealer, branch."""
    place = branches.select("branch_id", F.col("dealer_id").alias("owner"), "branch_lat", "branch_lon")
    rules = territories.join(place, ["branch_id"], "left").where("owner is null or owner = dealer_id")
    rules = sized(leading_rules(rules.select("dealer_id", "branch_id", "level", "code", "priority", "branch_lat", "branch_lon")))
    subject = leads.select("lead_id", "lat", "lon", F.explode(F.array(F.struct(F.lit("zip").alias("level"), F.col("postcode").alias("code")), F.struct(F.lit("county").alias("level"), F.col("county_fips").alias("code")))).alias("at")).select("lead_id", "lat", "lon", "at.*")
    far = F.coalesce(distance_m(F.col("lat"), F.col("lon"), F.col("branch_lat"), F.col("branch_lon")), F.lit(float("inf")))
    met = subject.join(rules, ["level", "code"]).withColumn("m", far)
    order = F.struct(F.when(F.col("level") == "zip", 0).otherwise(1).alias("l"), "priority", "m", "dealer_id", F.coalesce("branch_id", F.lit("")).alias("b"))
    return met.groupBy("lead_id").agg(F.min_by(F.struct("dealer_id", "branch_id", "level", (F.col("m") / 1609.344).alias("miles")), order).alias("t")).select("lead_id", "t.*")


def assign_dealers(leads: DataFrame, territories: DataFrame, branches: DataFrame) -> DataFrame:
    """leads with dealers given to candidates; overrides stay; none found is a gap. Adds `changed`."""
    found = assign_territory(leads.where("status = 'candidate'"), territories, branches).select("lead_id", F.col("dealer_id").alias("td"), F.col("branch_id").alias("tb"))
    met = leads.join(found, "lead_id", "left")
    act = (F.col("status") == "candidate") & ~F.coalesce(F.col("assignment") == "override", F.lit(False))
    new = {
        "dealer_id": F.when(act, F.col("td")).otherwise(F.col("dealer_id")), "branch_id": F.when(act, F.col("tb")).otherwise(F.col("branch_id")),
        "assignment": F.when(act, F.when(F.col("td").isNull(), "gap").otherwise("auto")).otherwise(F.col("assignment")),
    }
    same = F.lit(True)
    for c, e in new.items():
        same = same & F.col(c).eqNullSafe(e)
    return met.withColumns({f"_{c}": e for c, e in new.items()} | {"_changed": ~same}).select(*(F.col(f"_{c}").alias(c) if c in new else F.col(c) for c in leads.columns), F.col("_changed").alias("changed"))


def assignment_counts(after: DataFrame) -> DataFrame:
    live = after.where("status = 'candidate'")
    kind = F.col("assignment")
    return live.agg(F.count_if(kind == "auto").alias("assigned"), F.count_if(kind == "gap").alias("gaps"), F.count_if(kind == "override").alias("overrides"), F.count_if("changed").alias("changed"))


def lead_counts_by_dealer(leads: DataFrame, dealers: DataFrame) -> DataFrame:
    counted = leads.where("status = 'candidate' and dealer_id is not null").groupBy("dealer_id").agg(F.count("*").alias("leads"))
    return counted.join(dealers, "dealer_id").select("dealer_id", "dealer_name", "leads").orderBy("dealer_id")


def near_branches(points: DataFrame, places: DataFrame) -> DataFrame:
    """(dealer_id, lat, lon, b, branch_lat, branch_lon): points (dealer_id, lat, lon) with the dealer's places (dealer_id, branch_lat, branch_lon, b) that can be their closest.

    Points in a cell of NEAR_CELL degrees share their places: with r the cell's radius around its middle and d the
    least distance of a place from there, those no farther from it than d + 2 r. What has no coordinates has no distance, which
    is before all others, so such points and places meet all.
    """
    lat, lon, blat, blon = (F.col(c) for c in ("lat", "lon", "branch_lat", "branch_lon"))
    celled = points.withColumns({"_row": F.floor(lat / NEAR_CELL), "_col": F.floor(lon / NEAR_CELL)})
    known, nowhere = "_row is not null and _col is not null", "branch_lat is null or branch_lon is null"
    placed, key = celled.where(known), ["dealer_id", "_row", "_col"]
    mid = (F.col("_row") + 0.5) * NEAR_CELL, (F.col("_col") + 0.5) * NEAR_CELL
    cells = placed.groupBy(*key).agg(F.max(distance_m(lat, lon, *mid)).alias("r"))
    far = cells.join(places.where(f"not ({nowhere})"), "dealer_id").withColumn("d", distance_m(*mid, blat, blon))
    least = far.groupBy(*key).agg((F.min("d") + 2 * F.first("r")).alias("most"))
    # A millimetre and a part in a million for rounding.
    close = far.join(least, key).where(F.col("d") <= F.col("most") * 1.000001 + 0.001).select(*key, "b", "branch_lat", "branch_lon")
    pairs = placed.join(close, key).drop("_row", "_col").unionByName(placed.drop("_row", "_col").join(places.where(nowhere), "dealer_id"))
    return pairs.unionByName(celled.where(f"not ({known})").drop("_row", "_col").join(places, "dealer_id"))


def nearest_branch(leads: DataFrame, branches: DataFrame) -> DataFrame:
    """(lead_id, branch_id, metres) of the chosen dealer's closest branch; ties by id.

    Branches of a dealer at one point are met as the first of them, leads of a dealer at one point once.
    """
    own = leads.where("dealer_id is not null").select("lead_id", "dealer_id", "lat", "lon")
    places = written(branches.where("dealer_id is not null").groupBy("dealer_id", "branch_lat", "branch_lon").agg(F.min("branch_id").alias("b")), "branches")
    points = written(own.select("dealer_id", "lat", "lon").distinct(), "points")
    m = distance_m(F.col("lat"), F.col("lon"), F.col("branch_lat"), F.col("branch_lon")).alias("m")
    best = near_branches(points, places).groupBy("dealer_id", "lat", "lon").agg(F.min(F.struct(m, "b")).alias("x"))
    met = own.join(best.toDF("_d", "_lat", "_lon", "x"), F.expr("dealer_id = _d and lat <=> _lat and lon <=> _lon"))
    return met.groupBy("lead_id").agg(F.min("x").alias("x")).select("lead_id", F.col("x.b").alias("branch_id"), F.col("x.m").alias("metres"))


def coverage_gap_report(leads: DataFrame) -> DataFrame:
    """Gap leads by county and category, with sums by county and in all (null for what is summed over)."""
    gaps = leads.where("status = 'candidate' and assignment = 'gap'")
    by = gaps.rollup("county_fips", "leaf").agg(F.count("*").alias("gap_leads"), F.grouping_id().cast("int").alias("level"))
    # A rollup of no rows has no row, and the sum of all is one even then.
    every = gaps.agg(F.lit(None).cast("string").alias("county_fips"), F.lit(None).cast("string").alias("leaf"), F.count("*").alias("gap_leads"), F.lit(3).alias("level"))
    return by.where("level <> 3").unionByName(every)


def dealer_capacity(leads: DataFrame, caps: DataFrame) -> DataFrame:
    """(lead_id, dealer_id, place, mailed): the best scored within the dealer's cap now, the rest later."""
    met = leads.where("dealer_id is not null and status in ('candidate', 'approved')").select("lead_id", "dealer_id", "score").join(sized(caps), "dealer_id")
    placed = with_place(met, ["dealer_id"], [F.desc_nulls_last("score"), F.col("lead_id")])
    return placed.select("lead_id", "dealer_id", F.col("place").cast("int").alias("place"), (F.col("place") <= F.col("cap")).alias("mailed"))
