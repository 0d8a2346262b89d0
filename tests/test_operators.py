"""Operators on small tables: resolution, suppression, routing, scores, market, research, imports, measurement."""

import json

import pytest
from pyspark.sql import functions as F

from leadweave.functions import normalize
from leadweave.operators import dedupe, lists, market, measure, places, research, routing, scoring
from leadweave.operators.components import connected_components
from leadweave.sources import imports


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def test_components_of_a_chain_a_hub_and_no_edges(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 30)] + [(5, 5), (None, 3)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "a int, b int")), "id", "component"))
    assert set(got) == set(range(100, 161)) | set(range(1, 30))
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 1 for i in range(1, 30))
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def site(i, name, domain=None, lat=29.7, lon=-95.4, conf=0.8, gh="g1"):
    return (i, name, domain, lat, lon, conf, gh)


def test_dedupe_rules_and_order_independence(spark):
    data = [site("a", "acme", "acme.example"), site("b", "other", "acme.example", 29.72, conf=0.9), site("c", "bayou steel", lat=29.8), site("d", "bayou steel", lat=29.8001), site("e", "bayou steels", lat=29.8002, gh="g2"),
            site("f", "lonely", lat=30.2), site("g", "", lat=29.8), site("h", "", lat=29.8)]
    schema = "site_id string, name_norm string, domain_key string, lat double, lon double, confidence double, gh7 string"
    one = rows(dedupe.dedupe(spark.createDataFrame(data, schema)), "site_id", "component", "rule", "is_primary")
    two = rows(dedupe.dedupe(spark.createDataFrame(data[::-1], schema).repartition(3)), "site_id", "component", "rule", "is_primary")
    assert one == two
    assert {r[0]: r[1:] for r in one} == {"a": ("a", "domain", False), "b": ("a", "domain", True), "c": ("c", "name-place", True), "d": ("c", "name-place", False), "e": ("c", "name-place", False), "f": ("f", "none", True), "g": ("g", "none", True), "h": ("h", "none", True)}


def test_suppression_kinds_and_release(spark):
    subjects = spark.createDataFrame([("1", "acme", "a.example", "77001"), ("2", "acme", None, "77001"), ("3", "acme", None, "77002"), ("4", "bayou fulfilment", None, "77001"), ("5", "", None, "77001")], "lead_id string, name_norm string, domain_key string, zip5 string")
    rules = spark.createDataFrame([("r3", "x", "a.example", None, "dnc"), ("r1", "acme", None, "77001", "customer"), ("r2", "bayou fulfillment", None, "77001", "other")], "rule_id string, name_norm string, domain_key string, zip5 string, reason string")
    hits = routing.match_suppression(subjects, rules)
    assert rows(hits, "lead_id", "kind", "rule_id") == [("1", "domain", "r3"), ("2", "name", "r1"), ("4", "fuzzy", "r2")]
    leads = spark.createDataFrame([("1", "candidate", None, None, "auto", "d", "b"), ("2", "approved", None, None, "override", "d", "b"), ("3", "suppressed", "hold", "dnc", None, None, None), ("4", "duplicate", None, None, None, None, None), ("6", "suppressed", None, "dnc", None, None, None)],
                                  "lead_id string, status string, pre_status string, suppress_reason string, assignment string, dealer_id string, branch_id string")
    after = routing.apply_suppression(leads, hits)
    assert rows(after, "lead_id", "status", "pre_status", "dealer_id", "changed") == [("1", "suppressed", "candidate", None, True), ("2", "suppressed", "approved", "d", True), ("3", "hold", None, None, True), ("4", "duplicate", None, None, False), ("6", "candidate", None, None, True)]
    again = routing.apply_suppression(after.select(leads.columns), hits)
    assert again.where("changed").count() == 0


def test_zip_beats_county_and_unknown_branch_still_assigns(spark):
    leads = spark.createDataFrame([("1", 29.7, -95.4, "77001", "48201"), ("2", 29.7, -95.4, "77009", "48201"), ("3", 29.7, -95.4, "77010", "48999")], "lead_id string, lat double, lon double, postcode string, county_fips string")
    rules = spark.createDataFrame([("far", "gone", "zip", "77001", 9), ("near", "b1", "county", "48201", 1), ("tie", "b2", "county", "48201", 1)], "dealer_id string, branch_id string, level string, code string, priority int")
    branches = spark.createDataFrame([("b1", "near", 29.7, -95.4), ("b2", "tie", 30.0, -95.4)], "branch_id string, dealer_id string, branch_lat double, branch_lon double")
    assert rows(routing.assign_territory(leads, rules, branches), "lead_id", "dealer_id", "level") == [("1", "far", "zip"), ("2", "near", "county")]


def test_only_rules_that_can_win_meet_the_leads(spark):
    leads = spark.createDataFrame([("1", 29.61, -95.4, "77001", "48201"), ("2", 30.19, -95.4, "77009", "48201")], "lead_id string, lat double, lon double, postcode string, county_fips string")
    many = [(f"d{i % 7}", f"b{i:04d}", "county", "48201", 1 + i % 2) for i in range(2000)]
    rules = spark.createDataFrame(many, "dealer_id string, branch_id string, level string, code string, priority int")
    branches = spark.createDataFrame([(b, d, 29.0 + int(b[1:]) % 20 / 10, -95.4) for d, b, *_ in many], "branch_id string, dealer_id string, branch_lat double, branch_lon double")
    places = rules.join(branches, ["branch_id", "dealer_id"])
    assert routing.leading_rules(places).count() == 10 and routing.leading_rules(places).where("priority = 1 and dealer_id = 'd0'").count() == 10

    def first(lat):  # of all rules, none left out
        return min((p, round(abs(29.0 + int(b[1:]) % 20 / 10 - lat), 9), d, b) for d, b, _, _, p in many)[2:]

    got = {r["lead_id"]: (r["dealer_id"], r["branch_id"]) for r in routing.assign_territory(leads, rules, branches).collect()}
    assert got == {"1": first(29.61), "2": first(30.19)}


@pytest.mark.parametrize(("values", "adjustment", "signals", "total", "grade"), [((1, 1, 1, 1, 1, 1), 5, 2, 100, "A"), ((1, 1, 1, 0, 1, 1), 15, 0, 79, "B"), ((0.2, 0.5, 0.4, 0, 0, 0.45), -40, 0, 10, "C")])
def test_score(spark, values, adjustment, signals, total, grade):
    df = spark.createDataFrame([(*map(float, values), adjustment, signals)], "v_segment double, v_size double, v_facility double, v_signals double, v_proximity double, v_confidence double, adjustment int, n_signals int")
    r = scoring.score(df).first()
    assert (r["total"], r["grade"]) == (total, grade)


def test_score_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(0.645, 0.0, 0.0, 0.0, 0.0, 0.0, 0, 1)], "v_segment double, v_size double, v_facility double, v_signals double, v_proximity double, v_confidence double, adjustment int, n_signals int")
    assert scoring.score(df, (1.0, 0.0, 0.0, 0.0, 0.0, 0.0)).first()["base"] == 65


def test_signal_months(spark):
    df = spark.createDataFrame([("l", 1, "hiring", "2024-01"), ("l", 2, "hiring", "2023-02-28"), ("l", 3, "hiring", "2023-01"), ("l", 4, "hiring", "2024-02"), ("l", 5, "registry", "2024-01"), ("l", 6, "hiring", "soon"), ("l", 7, "hiring", None)], "lead_id string, event_id int, type string, date_text string")
    assert scoring.qualifying_signals(df, 2024 * 12 + 1).first()["n_signals"] == 2


def test_weights(spark):
    df = spark.createDataFrame([("a", '{"segment":0.5,"signals":0.5}', None), ("b", None, None), ("c", '{"x":1}', None), ("d", '{"size":0.9}', None), ("e", "broken", None)], "campaign_id string, override_json string, profile_json string")
    got = {r["campaign_id"]: (r["error"], r["w_segment"], r["w_size"]) for r in scoring.resolve_weights(df).collect()}
    assert got == {"a": (None, 0.5, 0.0), "b": (None, 0.25, 0.15), "c": ("unknown key", None, None), "d": ("sum is not 1", None, None), "e": ("not a map of weights", None, None)}


def test_size_labels_and_nested_bands(spark):
    bands = [("r", "c", "001", "All establishments"), ("r", "c", "212", "Establishments with less than 5 employees"), ("r", "c", "220", "Establishments with 5 to 9 employees"), ("r", "c", "260", "Establishments with 1,000 employees or more"), ("r", "c", "263", "Establishments with 1,500 to 2,499 employees"), ("r", "c", "999", "Establishments with 7 employees")]
    df = spark.createDataFrame(bands, "request_id string, code string, band string, label string")
    assert rows(market.parse_size_bands(df), "band", "lower", "upper") == [("001", None, None), ("212", 0, 4), ("220", 5, 9), ("260", 1000, None), ("263", 1500, 2499), ("999", 7, 7)]
    assert [r[0] for r in rows(market.partition_bands(df, ["request_id", "code"]), "band")] == ["212", "220", "260"]


def test_market_counts_unknown_as_unknown(spark):
    cbp = spark.createDataFrame([("4931", "48201", "001", "All establishments", 10), ("4931", "48201", "220", "Establishments with 5 to 9 employees", 3), ("4931", "48201", "241", "Establishments with 20 to 49 employees", 4)], "naics string, county_fips string, band string, label string, estab bigint")
    req = spark.createDataFrame([("q", 15), ("p", 60)], "request_id string, min_employees int")
    codes = spark.createDataFrame([("q", "4931"), ("q", "49311"), ("p", "4931")], "request_id string, code string")
    counties = spark.createDataFrame([("q", "48201"), ("q", "48999"), ("p", "48201")], "request_id string, county_fips string")
    got = {r["request_id"]: r for r in market.estimate_market(cbp, req, codes, counties).collect()}
    q = got["q"]
    assert (q["establishments"], q["with_min"], q["gap"], q["effective_min"], q["rounded_up"], q["absent"]) == (10, 4, 3, 20, True, 1)
    assert got["p"]["with_min"] is None


def test_decode_takes_the_first_of_repeated_columns_and_rejects_text(spark):
    body = '[["ESTAB","EMPSZES","EMPSZES_LABEL","NAICS2017","NAICS2017","state","county"],["5","001","All","4931","x","48","1"],["N","001","All","4931","x","48","3"]]'
    good, bad = market.decode_cbp(spark.createDataFrame([(body,)], "body string"))
    assert rows(good, "naics", "county_fips", "estab") == [("4931", "48001", 5)] and bad.count() == 1


def test_research_problems(spark):
    docs = spark.createDataFrame([("c", "ok", '{"status":"no_signal","summary":"long enough","rationale":"long enough"}'), ("c", "bad", "[1]"), ("c", "none", None)], "campaign_id string, lead_id string, document string")
    valid, wrong = research.validate_research(docs)
    assert rows(valid, "lead_id") == [("ok",)] and rows(wrong, "lead_id", "problem") == [("bad", "not a JSON object"), ("none", "not a JSON object")]


def test_null_name_or_taxonomy_drops_a_negated_match(spark):
    df = spark.createDataFrame([(1, None, ["a"], "a"), (2, "x", None, None), (3, "x", [None, "b"], "b"), (4, "x steel", ["a"], "a")], "id int, name string, h array<string>, leaf string")
    assert rows(df.where(~places.keyword_match(F.col("name"), ["STEEL"])), "id") == [(2,), (3,)]
    assert rows(df.where(~places.category_match(F.col("h"), F.col("leaf"), ["a"])), "id") == [(3,)]


def test_merge_counts_repeated_keys_as_updated(spark):
    current = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = spark.createDataFrame([(1, "b", 2), (2, "c", 2), (3, "c", 3)], "row int, k string, v int")
    merged, counts = imports.merge_list(current, new, "k", True)
    assert rows(merged, "k", "v") == [("b", 2), ("c", 3)] and rows(counts, "imported", "updated", "removed") == [(1, 2, 1)]


def test_numbers_are_contiguous(spark):
    got = rows(imports.numbered(spark.range(1000).select(F.col("id").cast("string").alias("s")), [F.col("s")]), "number", "s")
    assert [n for n, _ in sorted(got)] == list(range(1, 1001)) and [s for _, s in sorted(got)] == sorted(s for _, s in got)


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="company_name"):
        imports.required_columns(spark.range(1), "suppression")


def test_matchback_tiers(spark):
    # The seven cases of a warranty sample: a code, two strong ones, a fuzzy one, one too early, two without a lead.
    sales = [("W1", "bayou fulfillment", "77494", None, "2026-11-20", "lift-k7q3mx"), ("W2", "gulf coast sign and lighting", "77506", None, "2027-01-10", None), ("W3", "ship channel logistics", "77571", None, "2027-03-02", None), ("W4", "cypress creek electric", "77433", None, "2026-12-05", None), ("W5", "magnolia distribution", "77301", None, "2026-08-01", None), ("W6", "westpark metal fab", "77099", None, "2027-02-14", None), ("W7", "lakeside marina services", "77565", None, "2026-11-30", None)]
    leads = [("L1", "LIFT-K7Q3MX", "bayou fulfillment", "77494", None), ("L2", "LIFT-A", "gulf coast sign and lighting", "77506", None), ("L3", "LIFT-B", "ship channel logistics", "77571", None), ("L4", "LIFT-C", "cypress creek electrical", "77433", None), ("L5", "LIFT-D", "magnolia distribution", "77301", None), ("L6", "LIFT-E", "westpark metal fab", "77042", None)]
    s = spark.createDataFrame(sales, "sale_id string, name_norm string, zip5 string, address_norm string, sale_date string, promo_code string").withColumn("sale_date", F.to_date("sale_date"))
    got = measure.matchback(s, spark.createDataFrame(leads, "lead_id string, offer_code string, name_norm string, zip5 string, address_norm string"), "2026-10-15", 365)
    assert rows(got, "sale_id", "lead_id", "tier", "needs_review") == [("W1", "L1", "exact", False), ("W2", "L2", "strong", False), ("W3", "L3", "strong", False), ("W4", "L4", "fuzzy", True)]


def test_codes_are_stable_and_unique(spark):
    leads = spark.range(5000).select(F.lit("c").alias("campaign_id"), F.col("id").cast("string").alias("lead_id"))
    none = spark.createDataFrame([], "campaign_id string, lead_id string, code string")
    first = measure.assign_tracking_codes(leads, none, "https://x.example/{code}")
    assert first.select("code").distinct().count() == 5000
    again = measure.assign_tracking_codes(leads, first.select("campaign_id", "lead_id", "code").limit(100), "https://x.example/{code}")
    assert rows(first, "lead_id", "code") == rows(again, "lead_id", "code")
    assert first.where("url = concat('https://x.example/', code)").count() == 5000


def test_list_limits(spark):
    with pytest.raises(ValueError):
        lists.list_leads(spark.range(1), limit=101)


def test_updates_refuse_and_apply(spark):
    leads = spark.createDataFrame([("1", "candidate", 29.7, -95.4, None, None, None), ("2", "suppressed", 29.7, -95.4, None, None, None)], "lead_id string, status string, lat double, lon double, dealer_id string, branch_id string, assignment string")
    updates = spark.createDataFrame([(1, "1", "hold", None), (2, "1", None, "d1"), (3, "2", "approved", None), (4, "9", "hold", None)], "seq int, lead_id string, new_status string, new_dealer string")
    branches = spark.createDataFrame([("b1", "d1", 29.7, -95.4)], "branch_id string, dealer_id string, branch_lat double, branch_lon double")
    out, errors = lists.apply_updates(leads, updates, branches, spark.createDataFrame([("d1", "D")], "dealer_id string, dealer_name string"))
    assert rows(out, "lead_id", "status", "dealer_id", "branch_id", "assignment")[0] == ("1", "candidate", "d1", "b1", "override")
    assert rows(errors, "lead_id", "error") == [("2", "lead is suppressed"), ("9", "unknown lead")]


def test_sites_at_one_point_stay_linear(spark):
    point = F.lit(29.7), F.lit(-95.3)
    base = spark.range(2000).select(F.format_string("s%05d", "id").alias("site_id"), F.when(F.col("id") < 1990, "acme steel").otherwise("acme steels").alias("name_norm"), point[0].alias("lat"), point[1].alias("lon"))
    edges = dedupe.fuzzy_edges(base)
    assert edges.count() <= 1999
    parts = dedupe.connected_components(edges).collect()
    assert len(parts) == 2000 and {r["component"] for r in parts} == {"s00000"}


def test_long_names_and_hosts_do_not_end_the_jvm(spark):
    df = spark.createDataFrame([("acme" + " inc" * 20_000, "a." * 20_000 + "example.com"), ("the " * 20_000 + "co corp", "x.com")], "name string, url string")
    got = df.select(normalize.name_norm(F.col("name")).alias("n"), normalize.domain_key(F.col("url")).alias("d")).collect()
    assert [tuple(r) for r in got] == [("acme", "example.com"), ("", "x.com")]


def test_two_edits_of_one_lead_that_differ(spark):
    leads = spark.createDataFrame([("a", "candidate", "d1", "auto"), ("b", "candidate", None, "gap")], "lead_id string, status string, dealer_id string, assignment string")
    edits = spark.createDataFrame([("a", "yes", ""), ("a", "hold", "d2"), ("b", "no", ""), ("b", "No", None)], "lead_id string, status_text string, dealer_text string")
    dealers = spark.createDataFrame([("d1", "One"), ("d2", "Two")], "dealer_id string, dealer_name string")
    out, log = measure.import_review(leads, edits, dealers)
    assert rows(out, "lead_id", "status", "dealer_id", "assignment") == [("a", "approved", "d2", "override"), ("b", "rejected", None, "gap")]
    assert [tuple(r) for r in log.where("change like 'two%'").collect()] == [("a", "two edits of a status", "approved", "hold")]


def test_research_is_typed(spark):
    ok = {"status": "researched", "summary": "long enough", "rationale": "long enough"}
    signal = {"type": "news", "text": "some news", "url": "http://a.b", "date": "2024-01"}
    quiet = {**ok, "status": "no_signal"}
    web = "https://a.example/" + "x" * 1982
    cases = [
        (ok, []), ({**ok, "signals": [signal, signal]}, []), (quiet, []), ({**quiet, "signals": []}, []), ({**ok, "sources": [web], "cautions": [], "segment": ""}, []),
        *(({**ok, "llmAdjustment": n}, []) for n in (-15, 0, 15, 3.0)), *(({**ok, "llmAdjustment": n}, ["/llmAdjustment"]) for n in (-16, 16, 3.7, "3", None, True, [3], 1e300)),
        *(({k: v for k, v in ok.items() if k != gone}, [f"/{gone}"]) for gone in ok), *(({**ok, k: 5}, [f"/{k}"]) for k in ok),
        *(({**ok, "signals": [signal, {k: v for k, v in signal.items() if k != gone}]}, [f"/signals/1/{gone}"]) for gone in signal),
        *(({**ok, "signals": [{**signal, k: v}]}, [f"/signals/0/{k}"]) for k, v in (("date", "May 2024"), ("url", "ftp://a"), ("url", None), ("type", "rumour"), ("type", 3), ("text", "four"), ("text", "x" * 241), ("mood", 1))),
        ({**quiet, "signals": [signal]}, ["/signals"]), ({**ok, "signals": "none"}, ["/signals"]), ({**ok, "signals": {"0": signal}}, ["/signals"]), ({**ok, "signals": [signal] * 11}, ["/signals"]), ({**ok, "signals": [[signal]]}, ["/signals/0"]),
        ({**ok, "contactRoles": [1, {"a": 2}, "x", "y" * 61]}, ["/contactRoles/0", "/contactRoles/1", "/contactRoles/3"]), ({**ok, "cautions": ["x" * 201] * 6}, ["/cautions", *(f"/cautions/{i}" for i in range(6))]),
        ({**ok, "sources": ["http://a", "a", web + "x"]}, ["/sources/1", "/sources/2"]), ({**ok, "facilityFit": {}}, ["/facilityFit/level"]), ({**ok, "facilityFit": {"level": "high", "mood": 1}}, ["/facilityFit/mood"]),
        ({**ok, "employeeEstimate": {"value": 0, "note": 5}}, ["/employeeEstimate/note", "/employeeEstimate/value"]), ({**ok, "employeeEstimate": {"value": 5_000_000_000}}, []), ({**ok, "a/b~c": 1}, ["/a~1b~0c"]), ("researched", [""]), ([], [""]), (None, [""]),
    ]
    rows_ = [("c", str(i), json.dumps(document)) for i, (document, _) in enumerate(cases)]
    odd = [("c", "twice", '{"status":"researched","summary":"long enough","rationale":"long enough","summary":"once more"}'), ("c", "cut", '{"status":'), ("c", "empty", "")]
    docs = spark.createDataFrame(rows_ + odd, "campaign_id string, lead_id string, document string")
    valid, wrong = research.validate_research(docs)
    found = {}
    for r in wrong.collect():
        found.setdefault(r["lead_id"], set()).add(r["pointer"])
    assert found == {str(i): set(p) for i, (_, p) in enumerate(cases) if p} | {k: {""} for k in ("twice", "cut", "empty")}
    assert {r["lead_id"] for r in valid.collect()} == {str(i) for i, (_, p) in enumerate(cases) if not p}
