"""Similarity joins, covers, searches of many campaigns, ranks, regressions and pooled lifts, on worked cases."""

import json
import math
import pathlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave.functions.geo import inside_rings
from leadweave.functions.similarity import jaro_winkler, letters, may_reach
from leadweave.operators import dedupe, geography, measure, places, ranks, routing
from leadweave.operators.blocks import split_blocks
from leadweave.operators.campaigns import Known, find_candidates

WORDS = "acme bayou coastal delta evergreen frontier gulf harbor logistics steel roofing signs electric storage marine glass farms north pine river".split()


def company_names(n, seed=1):
    r = random.Random(seed)
    names = {}
    while len(names) < n:
        name = " ".join(r.sample(WORDS, r.randint(1, 3))) + (f" {r.randint(1, 999)}" if r.random() < 0.5 else "")
        names[name] = None
        if r.random() < 0.1:
            names[name + r.choice("sxé")] = None
    return list(names)[:n]


def test_letter_bound_loses_no_pair_and_leaves_few(spark):
    names = company_names(300) + ["a", "aa", "aaaaaaaaa", "aaaaaaaab", "é", "日本語", "日本", "x" * 50, "x" * 49 + "y"]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("l", letters(F.col("name")))
    pairs = df.toDF("a", "x").crossJoin(df.toDF("b", "y")).where("a < b")
    for threshold in (0.8, 0.9, 0.92):
        left = {(r["a"], r["b"]) for r in pairs.where(may_reach(F.col("a"), F.col("b"), F.col("x"), F.col("y"), threshold)).select("a", "b").collect()}
        similar = {(a, b) for a in names for b in names if a < b and jaro_winkler(a, b) >= threshold}
        assert similar <= left
    assert len(left) < len(names) ** 2 / 20


def test_parts_of_a_block_meet_every_pair_once(spark):
    left = spark.range(250).select(F.col("id").alias("a"), F.when(F.col("id") < 200, 1).otherwise(F.col("id")).alias("k"))
    right = spark.range(220).select(F.col("id").alias("b"), F.when(F.col("id") < 150, 1).otherwise(F.col("id")).alias("k"))
    cut, copied, keys = split_blocks(left, right, ["k"], part_rows=30)
    got = [(r["a"], r["b"]) for r in cut.join(copied, keys).select("a", "b").collect()]
    assert len(got) == len(set(got)) and set(got) == {(r["a"], r["b"]) for r in left.join(right, "k").select("a", "b").collect()}
    assert cut.where("k = 1").select("_part").distinct().count() == 7


def test_fuzzy_edges_of_many_names_at_one_point(spark):
    names = company_names(250, 3)
    sites = spark.createDataFrame([(f"s{i:04d}", n, 29.0, -95.0) for i, n in enumerate(names)], "site_id string, name_norm string, lat double, lon double")
    got = {(r["a"], r["b"]) for r in dedupe.fuzzy_edges(sites).collect()}
    assert got == {(f"s{i:04d}", f"s{j:04d}") for i in range(len(names)) for j in range(i) if jaro_winkler(names[i], names[j]) >= 0.92}


def test_rules_of_one_name_meet_a_lead_once(spark):
    subjects = spark.createDataFrame([(f"l{i}", "acme", None, "77001" if i % 2 else None) for i in range(60)], "lead_id string, name_norm string, domain_key string, zip5 string")
    rules = spark.createDataFrame([(f"r{i:03d}", "acme", None, None if i == 50 else "77001", "dnc") for i in range(1, 80)], "rule_id string, name_norm string, domain_key string, zip5 string, reason string")
    got = {r["lead_id"]: (r["rule_id"], r["kind"]) for r in routing.match_suppression(subjects, rules).collect()}
    assert got == {f"l{i}": ("r001" if i % 2 else "r050", "name") for i in range(60)}


def test_groups_stay_within_a_campaign(spark):
    rows = [("c1", "a", "x", "d.com", 0.5), ("c1", "b", "y", "d.com", 0.9), ("c2", "a", "x", "d.com", 0.5), ("c2", "c", "x", None, float("nan")), ("c3", "b", "y", "d.com", None)]
    sites = spark.createDataFrame([(*r, "gh", 29.0, -95.0) for r in rows], "campaign_id string, site_id string, name_norm string, domain_key string, confidence double, gh7 string, lat double, lon double")
    got = sorted((r["campaign_id"], r["site_id"], r["component"], r["rule"], r["is_primary"]) for r in dedupe.dedupe(sites, "campaign_id").collect())
    assert got == [("c1", "a", "a", "domain", False), ("c1", "b", "a", "domain", True), ("c2", "a", "a", "name-place", False), ("c2", "c", "a", "name-place", True), ("c3", "b", "b", "none", True)]


def test_cover_tells_what_whole_rings_tell(spark):
    r = random.Random(3)

    def blob(x, y, radius, n):
        turn = [2 * math.pi * i / n for i in range(n)]
        points = [(x + radius * r.uniform(0.6, 1) * math.cos(t), y + radius * r.uniform(0.6, 1) * math.sin(t)) for t in turn]
        return [*points, points[0]]

    square = [(-95.0, 30.0), (-94.5, 30.0), (-94.5, 30.5), (-95.0, 30.5), (-95.0, 30.0)]
    hole = [(-94.9, 30.1), (-94.6, 30.1), (-94.6, 30.4), (-94.9, 30.4), (-94.9, 30.1)]
    shapes = {f"{i:05d}": [blob(-95 + r.uniform(-1, 1), 30 + r.uniform(-1, 1), r.uniform(0.05, 1.2), n)] for i, n in enumerate([3, 5, 60, 700])} | {"00100": [square], "00101": [square, hole], "00102": []}
    counties = spark.createDataFrame([(k, [[(float(x), float(y)) for x, y in ring] for ring in v]) for k, v in shapes.items()], "geoid string, rings array<array<struct<lon:double,lat:double>>>")
    spots = [(r.uniform(-97, -93), r.uniform(28, 32)) for _ in range(1500)] + [(-95.5 + 0.125 * i, 29.5 + 0.125 * j) for i in range(13) for j in range(13)] + shapes["00002"][0]
    points = spark.createDataFrame([(i, float(x), float(y), "k") for i, (x, y) in enumerate(spots)], "id int, lon double, lat double, k string")
    got = {(x["id"], x["county_fips"]) for x in geography.point_in_county(points, counties).collect()}
    boxed = geography.with_box(counties)
    inside = points.crossJoin(boxed).where("lon > xmin and lon < xmax and lat > ymin and lat < ymax").where(inside_rings(F.col("lon"), F.col("lat"), F.col("rings")))
    assert got == {(x["id"], x["geoid"]) for x in inside.select("id", "geoid").collect()}
    cover = geography.county_cover(counties).where("county_fips = '00003'")
    # A filled cell has no edges, and no part has nearly all of them.
    assert cover.where("_k = 0 and _parts is not null").count() == 0
    assert cover.select(F.max(F.expr("aggregate(_parts, 0, (a, p) -> greatest(a, size(p.edges)))")).alias("m")).first()["m"] < 350


def test_targets_of_many_campaigns_equal_one_search_each(spark):
    r = random.Random(5)
    names = [*company_names(80, 7), None, "", "A", "St", "steel"]
    leaves = ["build", "sign", None]
    rows = [(f"p{i:03d}", r.choice(names), None if i % 9 == 0 else ["services", r.choice(["x", "y", None])], r.choice(leaves), r.random()) for i in range(150)]
    table = spark.createDataFrame(rows, "id string, name string, hierarchy array<string>, leaf string, confidence double")
    asks = {
        "c1": dict(categories=["build"], keywords=["STEEL "], not_categories=[], not_keywords=[], floor=0.2), "c2": dict(categories=[], keywords=["a", "st"], not_categories=["sign"], not_keywords=["marine", "ro"], floor=0.5),
        "c3": dict(categories=["y"], keywords=["no such word"], not_categories=["x"], not_keywords=[], floor=0.6), "c4": dict(categories=["nothing"], keywords=[], not_categories=[], not_keywords=["a"], floor=0.0), "c5": dict(categories=[], keywords=["steel", "harbor"], not_categories=[], not_keywords=["s 1"], floor=0.1),
    }
    targets = [(c, kind, v) for c, a in asks.items() for kind, key in (("category", "categories"), ("keyword", "keywords"), ("not_category", "not_categories"), ("not_keyword", "not_keywords")) for v in a[key]] + [(c, "min_confidence", str(a["floor"])) for c, a in asks.items()]
    got = {(x["campaign_id"], x["id"]) for x in places.match_targets(table, spark.createDataFrame(targets, "campaign_id string, kind string, value string")).collect()}
    want = set()
    for c, a in asks.items():
        kept = table.where(F.col("confidence") >= a["floor"])
        match = F.lit(False)
        if a["categories"]:
            match = match | places.category_match(F.col("hierarchy"), F.col("leaf"), a["categories"])
        if a["keywords"]:
            match = match | places.keyword_match(F.col("name"), a["keywords"])
        kept = kept.where(match)
        if a["not_categories"]:
            kept = kept.where(~places.category_match(F.col("hierarchy"), F.col("leaf"), a["not_categories"]))
        if a["not_keywords"]:
            kept = kept.where(~places.keyword_match(F.col("name"), a["not_keywords"]))
        want |= {(c, x["id"]) for x in kept.select("id").collect()}
    assert got == want and len({c for c, _ in want}) >= 3
    # Without short words, and without any.
    for some in ("value in ('build', 'STEEL ', 'harbor')", "kind = 'min_confidence'"):
        places.match_targets(table, spark.createDataFrame(targets, "campaign_id string, kind string, value string").where(some)).count()


def test_places_in_groups_and_medians(spark):
    r = np.random.default_rng(1)
    rows = [("hot", int(x)) for x in r.integers(0, 50, 700)] + [("few", 3), ("few", 9), ("one", 4), (None, 5), (None, 1), ("void", None)]
    df = spark.createDataFrame([(g, v, i) for i, (g, v) in enumerate(rows)], "g string, v int, i int")
    placed = ranks.with_place(df, ["g"], [F.desc_nulls_last("v"), F.col("i")], "place", "size").collect()
    want = {}
    for g in {g for g, _ in rows}:
        own = sorted((i for i, x in enumerate(rows) if x[0] == g), key=lambda i: (rows[i][1] is None, -(rows[i][1] or 0), i))
        want |= {i: (k, len(own)) for k, i in enumerate(own, 1)}
    assert {x["i"]: (x["place"], x["size"]) for x in placed} == want
    medians = {x["g"]: x["median"] for x in ranks.grouped_median(df, ["g"], "v").collect()}
    assert medians == {g: (float(np.median([v for h, v in rows if h == g and v is not None])) if g != "void" else None) for g in {g for g, _ in rows}}
    assert ranks.grouped_median(df.limit(0), ["g"], "v").count() == 0


def test_tables_of_steps_are_deleted_on_demand(spark):
    from leadweave.operators.components import connected_components
    from leadweave.sources.shared import drop_written, shared_folder, written

    drop_written(spark)
    folder = pathlib.Path(shared_folder(spark).removeprefix("file:"))
    before = {p.name for p in folder.iterdir()}
    kept = written(spark.range(5).toDF("a"), "mine").count() + connected_components(spark.createDataFrame([(1, 2), (2, 3)], "a int, b int")).count()
    new = {p.name for p in folder.iterdir()} - before
    assert kept == 8 and len(new) >= 3
    assert drop_written(spark) == len(new) and not {p.name for p in folder.iterdir()} & new
    assert drop_written(spark) == 0


def test_one_group_spreads_over_tasks(spark):
    df = spark.range(0, 20_000, 1, 4).select(F.lit("all").alias("g"), ((F.col("id") * 7919) % 20_011).alias("v"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = df.repartitionByRange("g", "v").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 4 and max(x["count"] for x in parts) < 8_000
        assert ranks.with_place(df, ["g"], [F.col("v"), F.col("id")]).where("place = 20000").count() == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_coefficients_of_all_segments_equal_those_of_one_fit_each(spark):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    r = np.random.default_rng(2)
    rows = []
    for s, (n, w) in {"a": (300, (2.0, -1.0)), "b": (200, (0.0, 3.0)), None: (150, (-2.0, 0.5)), "tiny": (20, (1.0, 1.0))}.items():
        x = r.normal(size=(n, 2)) * (1.0, 0.2)
        y = r.random(n) < 1 / (1 + np.exp(-(x @ np.array(w) + 0.3)))
        rows += [(s, float(a), float(b), 0.5, bool(t)) for (a, b), t in zip(x, y, strict=True)]
    rows += [("a", None, 1.0, 0.5, True), ("a", 1.0, 1.0, 0.5, None), ("same", 1.0, 1.0, 0.5, True)]
    df = spark.createDataFrame(rows, "segment string, f0 double, f1 double, f2 double, won boolean")
    got = {x["segment"]: list(x["beta"]) for x in measure.fit_coefficients(df, ["f0", "f1", "f2"]).collect()}
    assert set(got) == {"a", "b", None}
    for s, beta in got.items():
        own = df.where(F.col("segment").eqNullSafe(s)).dropna(subset=["f0", "won"]).withColumn("y", F.col("won").cast("double"))
        fit = LogisticRegression(labelCol="y", maxIter=500, tol=1e-12, regParam=0.01).fit(VectorAssembler(inputCols=["f0", "f1", "f2"], outputCol="features").transform(own))
        assert beta == pytest.approx([fit.intercept, *fit.coefficients], abs=1e-6) and beta[3] == 0  # the third doesn't vary


def test_pooled_lift_where_plain_sums_have_the_wrong_sign(spark):
    # Both campaigns gain by mail, but most mail went where few buy.
    rows = [("rare", "mail", 9000, 180), ("rare", "holdout", 1000, 10), ("often", "mail", 1000, 320), ("often", "holdout", 9000, 2700), ("nobody held", "mail", 500, 50), (None, "mail", 10, 1), (None, "holdout", 10, 0)]
    report = spark.createDataFrame(rows, "campaign_id string, cohort string, leads bigint, buyers bigint")
    got = measure.lift_by_campaign(report).collect()
    each = {x["campaign_id"]: x["lift"] for x in got if not x["pooled"]}
    pooled = next(x for x in got if x["pooled"])
    assert each["rare"] == pytest.approx(0.01) and each["often"] == pytest.approx(0.02) and each["nobody held"] is None and each[None] == pytest.approx(0.1)
    w = {"rare": 900.0, "often": 900.0, None: 5.0}
    assert pooled["lift"] == pytest.approx(sum(w[c] * each[c] for c in w) / sum(w.values()))
    plain = measure.lift(report.where("campaign_id in ('rare', 'often')")).first()["lift"]
    assert plain < 0 < pooled["lift"] and pooled["low"] < pooled["lift"] < pooled["high"]
    nothing = measure.lift_by_campaign(report.limit(0)).collect()
    assert len(nothing) == 1 and nothing[0]["pooled"] and nothing[0]["lift"] is None


def test_rebuilt_extract_computes_only_what_is_missing(spark, tmp_path):
    first = "struct<freeform:string,locality:string,postcode:string,region:string,country:string>"
    raw = spark.range(60).select(
        F.col("id").cast("string").alias("id"), F.lit("n").alias("name"), F.lit("b").alias("basic_category"), F.lit(None).cast("struct<primary:string>").alias("taxonomy"), F.lit(0.9).alias("confidence"), F.array(F.lit("w")).alias("websites"), F.array(F.lit("p")).alias("phones"),
        F.array(F.struct(*(F.lit("x").alias(c) for c in ("freeform", "locality", "postcode")), F.when(F.col("id") % 3 == 0, "LA").otherwise("TX").alias("region"), F.lit("US").alias("country"))).cast(f"array<{first}>").alias("addresses"),
        F.col("id").cast("double").alias("lon"), F.lit(30.0).alias("lat"), F.struct(F.col("id").cast("double").alias("xmin"), F.lit(30.0).alias("ymin")).alias("bbox"),
    )
    bounds = spark.createDataFrame([("TX", 0.0, 0.0, 40.0, 90.0), ("LA", 0.0, 0.0, 90.0, 90.0), ("OK", 0.0, 0.0, 90.0, 90.0)], "state string, west double, south double, east double, north double")
    path = str(tmp_path / "extract")
    files = lambda state: sorted(p.name for p in (tmp_path / "extract" / "release=r1" / f"state={state}").glob("*.parquet"))
    report = lambda df: {x["state"]: (x["step"], x["rows"]) for x in df.collect()}
    assert report(places.rebuild_extract(raw, bounds.where("state = 'TX'"), path, "r1")) == {"TX": ("build", 27)}
    before = files("TX")
    assert report(places.rebuild_extract(raw, bounds, path, "r1")) == {"TX": ("skip", 27), "LA": ("build", 20), "OK": ("build", 0)}
    assert files("TX") == before
    fails = raw.withColumn("name", F.raise_error(F.lit("raw is read")).cast("string"))
    assert report(places.rebuild_extract(fails, bounds.where("state <> 'OK'"), path, "r1")) == {"TX": ("skip", 27), "LA": ("skip", 20)}
    assert report(places.rebuild_extract(raw.where("id < 20 and id % 3 <> 0"), bounds.where("state <> 'OK'"), path, "r1", force=True)) == {"TX": ("build", 13), "LA": ("build", 0)}
    assert report(places.rebuild_extract(raw, bounds.where("state = 'LA'"), path, "r1")) == {"LA": ("build", 20)}
    assert spark.read.parquet(path).groupBy("state").count().count() == 2


def test_the_golden_chain(spark):
    """120 places: 117 in ten counties, 89 that fit, 86 without the excluded, 83 companies, 7 of them suppressed; 32, 24 and 19 routed, one gap."""
    size, step = 0.25, 0.02
    fips = [f"48{n:03d}" for n in (201, 157, 15, 473, 39, 71, 167, 339, 291, 407)]
    corner = {f: (-96.0 + 0.25 * (i % 5), 29.5 + 0.25 * (i // 5)) for i, f in enumerate(fips)} | {"48999": (-90.0, 29.5)}
    ring = lambda x, y: [[(x, y), (x + size, y), (x + size, y + size), (x, y + size), (x, y)]]
    counties = spark.createDataFrame([(f, f, ring(x, y)) for f, (x, y) in corner.items()], "geoid string, name string, rings array<array<struct<lon:double,lat:double>>>")
    owner = dict(zip(fips, ["gulf"] * 4 + ["bay"] * 3 + ["pine"] * 2, strict=False))
    rows, taken = [], {f: 0 for f in corner}

    def add(county, name, leaf="warehouse", parent="storage_facility", confidence=0.9, site=None, at=None, address="1 Main St", zip_code="77001"):
        n = taken[county] = taken[county] + 1
        lon, lat = at or (corner[county][0] + step * (n % 11 + 0.5), corner[county][1] + step * (n // 11 + 0.5))
        taxonomy = None if leaf is None else (leaf, ["services", parent, leaf], [])
        rows.append((f"fx_{len(rows):04d}", name, leaf, taxonomy, confidence, [site] if site else [], [], [(address, "Houston", zip_code, "TX", "US")], lon, lat))
        return lon, lat

    word = lambda i: "".join("bcdfgklmnprst"[i * k % 13] + "aeiou"[i * k % 5] for k in (1, 2, 3, 5)) + f" {i}"
    per = dict(zip(fips, (9, 8, 8, 7, 8, 8, 8, 10, 9, 1), strict=True))  # 76 that stay candidates
    number = 0
    for county, count in per.items():
        for _ in range(count):
            number += 1
            kind = number % 4
            # By hierarchy, by leaf, by a keyword alone, and by both.
            add(county, f"{word(number)} {'steel' if kind == 2 else 'works'}", "bakery" if kind == 2 else "warehouse" if kind else "cold_storage", "food" if kind == 2 else "storage_facility", site=f"https://www.co{number}.example" if number % 5 else f"https://facebook.com/co{number}", zip_code="77001-1234" if number % 7 == 0 else "77001", address=None if number % 11 == 0 else "1 Main St")
    gone = ["Gulf Lift Equipment", "Bayport Aerial Supply", "Pineland Equipment", "Coastal Crane & Rigging LLC", "Harbor Point Logistics Inc", "Northfield Storage Co", "Apex Aerial Rentals"]
    for i, name in enumerate(gone):
        add(fips[i], name, site=f"https://s{i}.example" if i < 3 else None, zip_code="77060" if i == 5 else "77002")
    lon, lat = rows[0][8], rows[0][9]
    add(fips[0], "Another Name Entirely", site="http://co1.example/about", at=(lon, lat + 0.0198))  # one domain, 2.2 km apart
    add(fips[0], rows[1][1].upper() + " LLC", at=(rows[1][8], rows[1][9] + 0.00014))  # one name, 15 m apart
    add(fips[0], "The " + rows[2][1], at=(rows[2][8], rows[2][9] + 0.0008))  # one name, 88 m apart
    add(fips[3], "Excluded One", leaf="self_storage"), add(fips[4], "Excluded steel Two", leaf="self_storage"), add(fips[5], "Marine steel Three")
    for i in range(28):
        add(fips[i % 9], f"{word(200 + i)} {'steel' if i < 8 else 'bakery'}", "bakery" if i < 20 else None, "food", confidence=0.59 if i < 8 else 0.95)
    for i in range(3):
        add("48999", f"{word(300 + i)} steel")
    assert len(rows) == 120 and sum(corner["48999"][0] > r[8] for r in rows) == 117

    address = "array<struct<freeform:string,locality:string,postcode:string,region:string,country:string>>"
    raw = spark.createDataFrame(rows, f"id string, name string, basic_category string, taxonomy struct<primary:string,hierarchy:array<string>,alternates:array<string>>, confidence double, websites array<string>, phones array<string>, addresses {address}, lon double, lat double")
    matched = raw.select("id", "name", F.col("taxonomy.hierarchy").alias("hierarchy"), F.col("taxonomy.primary").alias("leaf"), "confidence", "lon", "lat", F.lit("TX").alias("state"))
    profile = json.dumps({"segments": [{"name": "A", "categories": ["storage_facility", "warehouse"], "keywords": []}, {"name": "B", "categories": [], "keywords": ["Steel"]}], "excludeCategories": ["self_storage"], "excludeKeywords": ["marine"]})
    profiles = spark.createDataFrame([("c1", profile)], "campaign_id string, profile_json string")
    scopes = spark.createDataFrame([("c1", f) for f in fips], "campaign_id string, county_fips string")
    no_exclusions = places.profile_targets(profiles).where("kind not like 'not_%'")
    assert places.find_for_campaigns(matched, counties, scopes, no_exclusions).count() == 89
    assert places.find_for_campaigns(matched, counties, scopes, places.profile_targets(profiles)).count() == 86

    rules = [(f"r{i}", normalized, f"s{i}.example" if i < 3 else None, "77060" if i == 5 else None, "dealer" if i < 3 else "dnc") for i, normalized in enumerate(["gulf lift equipment", "bayport aerial supply", "pineland equipment", "coastal crane and rigging", "harbor point logistics", "northfield storage", "apex aerial rentals"])]
    ids = "campaign_id string, lead_id string"
    known = Known(
        spark.createDataFrame([], f"{ids}, site_id string, status string"), spark.createDataFrame([], ids), spark.createDataFrame([], "site_id string, company_id string"), spark.createDataFrame(rules, "rule_id string, name_norm string, domain_key string, zip5 string, reason string"),
        spark.createDataFrame([(owner[f], f"{owner[f]}-1", "county", f, 1) for f in owner], "dealer_id string, branch_id string, level string, code string, priority int"), spark.createDataFrame([(f"{d}-1", d, 29.7, -95.4) for d in ("gulf", "bay", "pine")], "branch_id string, dealer_id string, branch_lat double, branch_lon double"),
    )
    leads = find_candidates(profiles, scopes, matched, raw, counties, known, "r1").collect()
    count = lambda f: sum(map(f, leads))
    assert len(leads) == 86 and count(lambda r: r["status"] != "duplicate") == 83 and count(lambda r: r["status"] == "suppressed") == 7 and count(lambda r: r["status"] == "candidate") == 76
    routed = {d: count(lambda r, d=d: r["status"] == "candidate" and r["dealer_id"] == d) for d in ("gulf", "bay", "pine", None)}
    assert routed == {"gulf": 32, "bay": 24, "pine": 19, None: 1} and count(lambda r: r["assignment"] == "gap") == 1
    assert sorted(r["lead_id"] for r in leads) == [f"L{i:04d}" for i in range(1, 87)]
