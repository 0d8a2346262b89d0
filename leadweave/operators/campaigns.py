"""The search of candidates as one chain, for all campaigns of a table at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.functions import geo
from leadweave.operators import dedupe, places, routing
from leadweave.sources import imports
from leadweave.sources.shared import written

#: Columns of a lead that a search leaves empty until routing.
OPEN = ("pre_status", "suppress_reason", "assignment", "dealer_id", "branch_id")


@dataclass
class Known:
    """What a search goes on from: stored leads and research, sites with their companies, rules, dealers' places and territories."""

    leads: DataFrame
    research: DataFrame
    sites: DataFrame
    rules: DataFrame
    territories: DataFrame
    branches: DataFrame


def find_candidates(profiles: DataFrame, scopes: DataFrame, matched: DataFrame, raw: DataFrame, counties: DataFrame, known: Known, release: str, whole: bool = False, per_state: int | None = None) -> DataFrame:
    """New leads of every campaign, suppressed and routed: (campaign_id, lead_id, site_id, status, dealer_id, branch_id, assignment, ...).

    profiles: (campaign_id, profile_json). scopes: (campaign_id, county_fips). matched and raw are the places as
    find_for_campaigns and places_to_sites take them, of the same ids. Profiles -> targets; places -> those
    that fit -> sites -> groups within a campaign -> stored -> suppressed -> routed. Profiles, scopes and
    targets stay tables, so nothing depends on how many campaigns there are. `whole` is the form of the similarity of names.
    Every place that fits becomes a lead, unless `per_state` is the most that a campaign takes of a state.
    """
    scopes = written(scopes.select("campaign_id", "county_fips").distinct(), "scopes")
    found = written(places.find_for_campaigns(matched, counties, scopes, places.profile_targets(profiles), per_state), "found")
    flat = places.places_to_sites(raw.join(found.select("id").distinct(), "id", "left_semi"), release).drop("payload_json", "state")
    flat = flat.withColumn("gh7", geo.geohash(F.col("lat"), F.col("lon")))
    sites = written(found.select("campaign_id", F.col("id").alias("site_id"), "county_fips").join(flat, "site_id"), "sites")
    deduped = written(dedupe.dedupe(sites, "campaign_id", whole), "deduped")
    old = imports.clear_candidates(known.leads, known.research, profiles)
    stored = imports.store_candidates(deduped, known.sites, old)
    more = deduped.select("campaign_id", "site_id", "name_norm", "domain_key", "zip5", "lat", "lon", "leaf", "confidence", "county_fips")
    leads = stored.join(more, ["campaign_id", "site_id"]).withColumn("postcode", F.col("zip5")).withColumns({c: F.lit(None).cast("string") for c in OPEN})
    # Lead ids are those of a campaign; while campaigns share a table they need the campaign as well.
    leads = written(leads.withColumns({"number": F.col("lead_id"), "lead_id": F.concat_ws(dedupe.SEPARATOR, "campaign_id", "lead_id")}), "leads")
    hits = routing.match_suppression(leads.select("lead_id", "name_norm", "domain_key", "zip5"), known.rules, whole=whole)
    after = routing.apply_suppression(leads, hits).select(leads.columns)
    return routing.assign_dealers(after, known.territories, known.branches).withColumn("lead_id", F.col("number")).drop("number")
