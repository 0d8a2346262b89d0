"""Queries of market sizing and geography."""

from __future__ import annotations

from pyspark.sql import functions as F

from leadweave.operators import geography as G
from leadweave.operators import market as M
from leadweave.plans.registry import query
from leadweave.sources.adapter import table

# Requests follow nations: each asks for three codes (one inside another) in the counties of its region.
_REQ = """SELECT concat('q', CAST(n_nationkey AS STRING)) AS request_id, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 20 WHEN 2 THEN 15 ELSE 200 END AS min_employees FROM nation"""
_CODES = """SELECT concat('q', CAST(n_nationkey AS STRING)) AS request_id, code FROM nation, (VALUES ('4931'), ('49311'), ('238210')) v(code) WHERE NOT (n_nationkey % 3 = 0 AND code = '4931')"""
_COUNTIES = """SELECT concat('q', CAST(a.n_nationkey AS STRING)) AS request_id, concat('48', lpad(CAST(2 * b.n_nationkey + 1 AS STRING), 3, '0')) AS county_fips FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey"""


def _spark(spark, d, text):
    return spark.sql(text.replace("FROM nation a JOIN nation b", "FROM {nation} a JOIN {nation} b").replace("FROM nation", "FROM {nation}"), nation=table(spark, d, "nation"))


def _inputs(spark, d):
    return table(spark, d, "cbp"), _spark(spark, d, _REQ), _spark(spark, d, _CODES), _spark(spark, d, _COUNTIES)


_BASE = f"""req AS ({_REQ}), codes AS ({_CODES}), wanted AS ({_COUNTIES}), desc_codes AS (SELECT c.request_id, c.code, (SELECT arg_min(o.code, length(o.code)) FROM codes o WHERE o.request_id = c.request_id AND o.code <> c.code AND starts_with(c.code, o.code)) AS ancestor FROM codes c),
live AS (SELECT request_id, code FROM desc_codes WHERE ancestor IS NULL),
got AS (SELECT l.request_id, l.code, w.county_fips, band, label, estab FROM live l JOIN wanted w USING (request_id) LEFT JOIN cbp ON naics = l.code AND cbp.county_fips = w.county_fips),
ranges AS (SELECT DISTINCT request_id, code, band, CASE band WHEN '212' THEN 0 WHEN '220' THEN 5 WHEN '230' THEN 10 WHEN '241' THEN 20 WHEN '254' THEN 50 WHEN '263' THEN 60 END AS lower,
  CASE band WHEN '212' THEN 4 WHEN '220' THEN 9 WHEN '230' THEN 19 WHEN '241' THEN 49 WHEN '263' THEN 99 END AS upper FROM got WHERE band IS NOT NULL),
whole AS (SELECT * FROM ranges r WHERE lower IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ranges o WHERE o.request_id = r.request_id AND o.code = r.code AND o.lower <= r.lower AND coalesce(o.upper, 1000000) >= coalesce(r.upper, 1000000) AND (o.lower < r.lower OR coalesce(o.upper, 1000000) > coalesce(r.upper, 1000000)))),
chosen AS (SELECT w.*, min_employees, min(lower) OVER (PARTITION BY w.request_id, code) AS effective_min FROM whole w JOIN req USING (request_id) WHERE lower >= min_employees),
est AS (SELECT g.request_id, g.code, sum(estab) FILTER (g.band = '001') AS establishments, sum(estab) FILTER (c.band IS NOT NULL) AS with_min, sum(estab) FILTER (g.band = '001') - coalesce(sum(estab) FILTER (w.band IS NOT NULL), 0) AS gap,
  max(c.effective_min) AS effective_min, any_value(q.min_employees) AS min_employees, count(DISTINCT county_fips) - count(DISTINCT county_fips) FILTER (estab IS NOT NULL) AS absent
  FROM got g LEFT JOIN whole w USING (request_id, code, band) LEFT JOIN chosen c USING (request_id, code, band) JOIN req q USING (request_id) GROUP BY 1, 2)"""


@query(f"+{_BASE} SELECT request_id, code, ancestor FROM desc_codes", ("cbp",))
def m1_drop_descendant_codes(spark, d):
    return M.drop_descendant_codes(_inputs(spark, d)[2])


@query("""SELECT DISTINCT band, CASE band WHEN '212' THEN 0 WHEN '220' THEN 5 WHEN '230' THEN 10 WHEN '241' THEN 20 WHEN '254' THEN 50 WHEN '263' THEN 60 END AS lower,
  CASE band WHEN '212' THEN 4 WHEN '220' THEN 9 WHEN '230' THEN 19 WHEN '241' THEN 49 WHEN '263' THEN 99 END AS upper FROM cbp""", ("cbp",))
def m2_parse_size_bands(spark, d):
    return M.parse_size_bands(table(spark, d, "cbp").select("band", "label").distinct()).select("band", "lower", "upper")


def _whole(spark, d):
    rows, req, codes, counties = _inputs(spark, d)
    live = M.drop_descendant_codes(codes).where("ancestor is null").select("request_id", "code")
    got = live.join(counties, "request_id").join(rows.withColumnRenamed("naics", "code"), ["code", "county_fips"])
    return M.partition_bands(got, ["request_id", "code"])


@query(f"+{_BASE} SELECT request_id, code, band, lower, upper FROM whole", ("cbp",))
def m3_partition_bands(spark, d):
    return _whole(spark, d).select("request_id", "code", "band", "lower", "upper")


@query(f"+{_BASE} SELECT request_id, code, band, effective_min, effective_min > min_employees AS rounded_up FROM chosen", ("cbp",))
def m4_select_bands(spark, d):
    return M.select_bands(_whole(spark, d), _inputs(spark, d)[1], ["request_id", "code"]).select("request_id", "code", "band", "effective_min", "rounded_up")


@query(f"+{_BASE} SELECT request_id, code, CAST(establishments AS BIGINT) AS establishments, CAST(with_min AS BIGINT) AS with_min, CAST(gap AS BIGINT) AS gap, effective_min, absent FROM est", ("cbp",))
def m5_estimate_market(spark, d):
    return M.estimate_market(*_inputs(spark, d)).select("request_id", "code", "establishments", "with_min", "gap", "effective_min", "absent")


@query(f"+{_BASE} SELECT c.request_id, c.code, array_to_string(list_sort(list(w.county_fips)), ',') AS absent FROM codes c JOIN wanted w USING (request_id) WHERE NOT EXISTS (SELECT 1 FROM cbp WHERE naics = c.code AND cbp.county_fips = w.county_fips) GROUP BY 1, 2", ("cbp",))
def m6_absent_counties(spark, d):
    rows, _, codes, counties = _inputs(spark, d)
    return M.absent_counties(rows, codes, counties).withColumn("absent", F.array_join("absent", ","))


@query(f"+{_BASE} SELECT request_id, CAST(sum(establishments) AS BIGINT) AS establishments, CAST(sum(with_min) AS BIGINT) AS with_min FROM est GROUP BY 1", ("cbp",))
def m7_market_totals(spark, d):
    return M.market_totals(M.estimate_market(*_inputs(spark, d)))


@query(f"""+{_BASE} SELECT request_id, code || ': sizes are counted from ' || effective_min || ' employees, not ' || min_employees AS note FROM est WHERE effective_min > min_employees
  UNION ALL SELECT request_id, code || ': no published size band begins at ' || min_employees || ' or more' FROM est WHERE min_employees IS NOT NULL AND effective_min IS NULL
  UNION ALL SELECT request_id, code || ': ' || CAST(gap AS BIGINT) || ' establishments have no published size' FROM est WHERE gap > 0
  UNION ALL SELECT request_id, code || ': ' || absent || ' counties are not published, so unknown' FROM est WHERE absent > 0
  UNION ALL SELECT request_id, code || ' is part of ' || ancestor FROM desc_codes WHERE ancestor IS NOT NULL""", ("cbp",))
def m8_market_notes(spark, d):
    _, _, codes, _ = _inputs(spark, d)
    return M.market_notes(M.estimate_market(*_inputs(spark, d)), M.drop_descendant_codes(codes))


_JSON = """SELECT concat('[["NAME","NAICS2017","NAICS2017_LABEL","ESTAB","EMPSZES","EMPSZES_LABEL","NAICS2017","state","county"],["x","', naics, '","l","', CASE WHEN estab % 7 = 0 THEN 'N' ELSE CAST(estab AS STRING) END, '","', band, '","', label, '","zz","', substr(county_fips, 1, 2), '","', CAST(CAST(substr(county_fips, 3, 3) AS INT) AS STRING), '"]]') AS body FROM """


@query("SELECT naics, county_fips, band, label, estab FROM cbp WHERE estab % 7 <> 0", ("cbp",))
def i7_decode_cbp(spark, d):
    return M.decode_cbp(spark.sql(_JSON + "{cbp}", cbp=table(spark, d, "cbp")))[0]


@query(f"""+{_BASE} SELECT request_id, code, CAST(establishments AS BIGINT) AS establishments, CAST(with_min AS BIGINT) AS with_min FROM est""", ("cbp",))
def p2_estimate_market(spark, d):
    _, req, codes, counties = _inputs(spark, d)
    text = _JSON.replace("CASE WHEN estab % 7 = 0 THEN 'N' ELSE CAST(estab AS STRING) END", "CAST(estab AS STRING)")
    rows = M.decode_cbp(spark.sql(text + "{cbp}", cbp=table(spark, d, "cbp")))[0]
    return M.estimate_market(rows, req, codes, counties).select("request_id", "code", "establishments", "with_min")


# -- geography


def counties(spark, d):
    """Counties with a rectangle ring; each third has its corner cut off, so that boxes aren't enough."""
    c = table(spark, d, "counties")
    point = lambda x, y: F.struct(F.col(x).alias("lon") if isinstance(x, str) else x.alias("lon"), F.col(y).alias("lat") if isinstance(y, str) else y.alias("lat"))
    cut = F.substring("geoid", 3, 3).cast("int") % 3 == 0
    square = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmax", "ymax"), point("xmin", "ymax"), point("xmin", "ymin"))
    tri = F.array(point("xmin", "ymin"), point("xmax", "ymin"), point("xmin", "ymax"), point("xmin", "ymin"))
    return c.select("geoid", "name", "statefp", F.array(F.when(cut, tri).otherwise(square)).alias("rings"))


_IN = "(lon > xmin AND lon < xmax AND lat > ymin AND lat < ymax AND (CAST(substr(geoid, 3, 3) AS INTEGER) % 3 <> 0 OR (lon - xmin) / (xmax - xmin) + (lat - ymin) / (ymax - ymin) < 1))"


@query(f"SELECT site_id, geoid AS county_fips FROM sites JOIN counties ON {_IN}", ("sites", "counties"))
def g9_point_in_county(spark, d):
    return G.point_in_county(table(spark, d, "sites").select("site_id", "lon", "lat"), counties(spark, d)).select("site_id", "county_fips")


# State codes.
STATES = [("48", "TX", "Texas"), ("22", "LA", "Louisiana"), ("40", "OK", "Oklahoma")]


def states(spark):
    return spark.createDataFrame(STATES, "state_fips string, usps string, state_name string")


def cbsa(spark, d):
    n = table(spark, d, "nation")
    title = F.concat(F.col("r_name"), F.lit("-"), F.initcap(F.regexp_replace("r_name", " ", "")), F.lit("ville, TX"))
    return n.join(table(spark, d, "region"), n["n_regionkey"] == F.col("r_regionkey")).select(F.concat(F.lit("1000"), F.col("r_regionkey").cast("string")).alias("cbsa_code"), title.alias("cbsa_title"), F.concat(F.lit("48"), F.lpad((2 * F.col("n_nationkey") + 1).cast("string"), 3, "0")).alias("county_geoid"))


def zcta(spark, d):
    s = table(spark, d, "sites")
    return s.select(F.col("postcode").alias("zcta5"), F.concat(F.lit("48"), F.lpad((2 * (F.col("g") % 25) + 1).cast("string"), 3, "0")).alias("county_geoid")).distinct()


_GEOID = "concat('48', lpad(CAST(2 * n_nationkey + 1 AS STRING), 3, '0'))"
_ALL = "(SELECT array_to_string(list_sort(list(geoid)), ',') FROM counties)"
_ZC = "zc AS (SELECT DISTINCT postcode AS zcta5, concat('48', lpad(CAST(2 * (g % 25) + 1 AS STRING), 3, '0')) AS county_geoid FROM sites)"


def joined(df, *cols):
    return df.withColumns({c: F.array_join(c, ",") for c in cols})


@query(f"SELECT c_custkey AS request_id, {_ALL} AS counties FROM customer WHERE c_custkey % 3 < 2", ("counties",))
def g1_scope_by_state(spark, d):
    k = F.col("c_custkey") % 3
    req = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), F.when(k == 0, " tx").when(k == 1, "TeXas").otherwise("Nowhere").alias("query"))
    return joined(G.scope_by_state(req, states(spark), counties(spark, d)), "counties")


@query(f"""WITH q AS (SELECT c_custkey AS request_id, c_custkey % 25 AS n, c_custkey % 4 AS k FROM customer), c AS (SELECT n_nationkey, {_GEOID} AS geoid, 'county ' || lower(n_name) AS nm FROM nation)
  SELECT request_id, CASE k WHEN 3 THEN (SELECT min(geoid) FROM c WHERE starts_with(nm, 'county nation_' || left(CAST(n AS STRING), 1))) ELSE (SELECT geoid FROM c WHERE n_nationkey = n) END AS geoid,
  CASE k WHEN 3 THEN (SELECT count(*) - 1 FROM c WHERE starts_with(nm, 'county nation_' || left(CAST(n AS STRING), 1))) ELSE 0 END AS others FROM q WHERE NOT (k = 3 AND EXISTS (SELECT 1 FROM c WHERE nm = 'county nation_' || left(CAST(n AS STRING), 1)))
  UNION ALL SELECT request_id, (SELECT geoid FROM c WHERE nm = 'county nation_' || left(CAST(n AS STRING), 1)), 0 FROM q WHERE k = 3 AND EXISTS (SELECT 1 FROM c WHERE nm = 'county nation_' || left(CAST(n AS STRING), 1))""")
def g2_match_counties(spark, d):
    n = (F.col("c_custkey") % 25).cast("string")
    k = F.col("c_custkey") % 4
    fips = F.concat(F.lit("48"), F.lpad((2 * (F.col("c_custkey") % 25) + 1).cast("string"), 3, "0"))
    text = F.when(k == 0, fips).when(k == 1, F.concat(F.lit("nation_"), n, F.lit(" County"))).when(k == 2, F.concat(F.lit("NATION_"), n, F.lit(" county, TX"))).otherwise(F.concat(F.lit("Nation_"), F.substring(n, 1, 1)))
    req = table(spark, d, "customer").select(F.col("c_custkey").alias("request_id"), text.alias("query"))
    return G.match_counties(req, counties(spark, d), states(spark)).select("request_id", "geoid", F.size("alternatives").cast("bigint").alias("others"))


@query(f"""SELECT c_custkey AS request_id, '1000' || r_regionkey AS cbsa_code, (SELECT array_to_string(list_sort(list({_GEOID})), ',') FROM nation WHERE n_regionkey = r_regionkey) AS counties
  FROM customer JOIN region ON r_regionkey = c_custkey % 5 WHERE c_custkey % 3 <> 2""")
def g3_match_cbsas(spark, d):
    k = F.col("c_custkey") % 3
    name = F.regexp_replace("r_name", " ", "")
    req = table(spark, d, "customer").join(table(spark, d, "region"), F.col("r_regionkey") == F.col("c_custkey") % 5).select(
        F.col("c_custkey").alias("request_id"), F.when(k == 0, F.concat(F.lit("Greater "), F.lower(name), F.lit("ville metro area"))).when(k == 1, F.concat(F.lower(name), F.lit("vi"))).otherwise(F.lit("Elsewhere")).alias("query")
    )
    return joined(G.match_cbsas(req, cbsa(spark, d)), "counties")


@query(f"+{_ZC} SELECT k AS request_id, (SELECT array_to_string(list_sort(list(DISTINCT county_geoid)), ',') FROM zc WHERE zcta5 IN (s.postcode, CAST(CAST(s.postcode AS INTEGER) + 1 AS STRING))) AS counties, '99999' AS unknown FROM sites s WHERE (SELECT count(*) FROM zc WHERE zcta5 = CAST(CAST(s.postcode AS INTEGER) + 1 AS STRING)) > 0", ("sites",))
def g4_counties_for_zips(spark, d):
    z = zcta(spark, d)
    next_zip = (F.col("postcode").cast("int") + 1).cast("string")
    req = table(spark, d, "sites").select(F.col("k").alias("request_id"), next_zip.alias("zcta5"), F.array("postcode", next_zip, F.lit("99999")).alias("zips")).join(z.select("zcta5").distinct(), "zcta5", "left_semi")
    return joined(G.counties_for_zips(req.drop("zcta5"), z), "counties", "unknown").drop("found")


@query()
def g5_counties_for_radius(spark, d):
    req = table(spark, d, "sites").select(F.col("site_id").alias("request_id"), "lat", "lon", (F.lit(1.0) + F.col("k") % 20).alias("miles"))
    return joined(G.counties_for_radius(req, counties(spark, d)), "counties")


@query(f"""+{_ZC} SELECT dealer_id AS request_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(code) FILTER (level = 'county'), []), coalesce(list(county_geoid) FILTER (county_geoid IS NOT NULL), [])))), ',') AS counties,
  array_to_string(list_sort(list_distinct(coalesce(list(code) FILTER (level = 'zip'), []))), ',') AS zips, CAST(NULL AS STRING) AS error FROM territories LEFT JOIN zc ON level = 'zip' AND zcta5 = code GROUP BY 1
  UNION ALL SELECT 'd99', '', '', 'unknown dealer'""", ("territories", "sites"))
def g6_scope_by_dealer(spark, d):
    dealers = table(spark, d, "dealers")
    req = dealers.select("dealer_id").unionByName(spark.range(1).select(F.lit("d99").alias("dealer_id"))).withColumn("request_id", F.col("dealer_id"))
    return joined(G.scope_by_dealer(req, dealers, table(spark, d, "territories"), zcta(spark, d)), "counties", "zips")


def _scopes(spark, d):
    """Two named scopes for each request: its own county and those of its region."""
    own = table(spark, d, "leads").select(F.col("lead_id").alias("request_id"), F.array("county_fips").alias("counties"))
    return own.unionByName(own.select("request_id", F.array(F.lit("48001"), F.lit("99003")).alias("counties")))


@query("""SELECT lead_id AS request_id, CASE k % 2 WHEN 1 THEN array_to_string(list_sort(list_distinct([county_fips, '48001', '99003'])), ',') ELSE county_fips END AS counties,
  CASE k % 2 WHEN 1 THEN '' ELSE '48049,48051' END AS alternatives FROM leads""", ("leads",))
def g7_union_scopes(spark, d):
    """Half of the requests name two values, the others one that is ambiguous."""
    own = table(spark, d, "leads").select(F.col("lead_id").alias("request_id"), "k", F.array("county_fips").alias("counties"), F.array(F.lit("48049"), F.lit("48051")).alias("alternatives"))
    two = own.where("k % 2 = 1").withColumn("counties", F.array(F.lit("48001"), F.lit("99003")))
    return joined(G.union_scopes(own.unionByName(two).drop("k")), "counties", "alternatives")


@query("SELECT lead_id AS request_id, round(least(c.xmin, o.xmin), 6) AS xmin, round(least(c.ymin, o.ymin), 6) AS ymin, round(greatest(c.xmax, o.xmax), 6) AS xmax, round(greatest(c.ymax, o.ymax), 6) AS ymax FROM leads JOIN counties c ON c.geoid = county_fips JOIN counties o ON o.geoid = '48001'", ("leads", "counties"))
def g8_bbox_of_counties(spark, d):
    out = G.bbox_of_counties(G.union_scopes(_scopes(spark, d)), counties(spark, d))
    return out.select("request_id", *(F.round(c, 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")))


@query("SELECT lead_id AS request_id, '99,TX' AS states FROM leads", ("leads",))
def g11_states_of_counties(spark, d):
    return joined(G.states_of_counties(_scopes(spark, d), states(spark)), "states")


_DEALT = """dealt AS (SELECT dealer_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(list(code) FILTER (level = 'county'), []), coalesce(list(county_geoid) FILTER (county_geoid IS NOT NULL), [])))), ',') AS dealt
  FROM territories LEFT JOIN zc ON level = 'zip' AND zcta5 = code GROUP BY 1)"""


@query(f"""+{_ZC}, {_DEALT}, zips AS (SELECT postcode, (SELECT array_to_string(list_sort(list(DISTINCT county_geoid)), ',') FROM zc WHERE zcta5 IN (p.postcode, '77001')) AS of_zips FROM (SELECT DISTINCT postcode FROM sites) p)
  SELECT k AS request_id, CASE k % 7 WHEN 0 THEN CASE WHEN dealt IS NOT NULL THEN 'dealer' ELSE 'error' END WHEN 1 THEN 'state' WHEN 2 THEN 'zips' WHEN 3 THEN 'county' WHEN 4 THEN 'metro' WHEN 5 THEN 'county' ELSE CASE WHEN k % 14 = 6 THEN 'county' ELSE 'error' END END AS kind,
  CASE WHEN k % 7 = 0 THEN dealt WHEN k % 7 = 1 THEN {_ALL} WHEN k % 7 = 2 THEN of_zips WHEN k % 7 IN (3, 5) THEN concat('48', lpad(CAST(2 * (k % 25) + 1 AS STRING), 3, '0'))
    WHEN k % 7 = 4 THEN (SELECT array_to_string(list_sort(list({_GEOID})), ',') FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'AFRICA') WHEN k % 14 = 6 THEN (SELECT min(geoid) FROM counties) END AS counties,
  CASE WHEN k % 14 = 6 THEN (SELECT array_to_string(list_slice(list_sort(list(geoid)), 2, 100), ',') FROM counties) ELSE '' END AS alternatives
  FROM sites LEFT JOIN dealt ON dealer_id = 'd' || k % 12 LEFT JOIN zips USING (postcode)""", ("sites", "territories", "counties"))
def g10_resolve_queries(spark, d):
    k = F.col("k") % 7
    n = (F.col("k") % 25).cast("string")
    text = (
        F.when(k == 0, F.concat(F.lit("dealer: d"), (F.col("k") % 12).cast("string"))).when(k == 1, "Texas").when(k == 2, F.concat("postcode", F.lit(", 77001")))
        .when(k == 3, F.concat(F.lit("Nation_"), n, F.lit(" County"))).when(k == 4, "africaville metro").when(k == 5, F.concat(F.lit("nation_"), n))
        .when(F.col("k") % 14 == 6, "Nati").otherwise("Atlantis")
    )
    req = table(spark, d, "sites").select(F.col("k").alias("request_id"), text.alias("query"))
    out = G.resolve_queries(req, states(spark), counties(spark, d), cbsa(spark, d), zcta(spark, d), table(spark, d, "dealers"), table(spark, d, "territories"))
    return joined(out, "counties", "alternatives")


@query(f"""+{_BASE} SELECT 'q99' AS request_id, 'unknown' AS part, NULL AS code, 'Atlantis' AS detail, CAST(NULL AS BIGINT) AS value UNION ALL SELECT request_id, 'county', NULL, county_fips, NULL FROM wanted
  UNION ALL SELECT request_id, 'dropped', code, ancestor, NULL FROM desc_codes WHERE ancestor IS NOT NULL UNION ALL SELECT request_id, 'establishments', code, NULL, CAST(establishments AS BIGINT) FROM est
  UNION ALL SELECT request_id, 'with_min', code, NULL, CAST(with_min AS BIGINT) FROM est UNION ALL SELECT request_id, 'gap', code, NULL, CAST(gap AS BIGINT) FROM est
  UNION ALL SELECT request_id, 'absent', code, county_fips, NULL FROM live JOIN wanted USING (request_id) WHERE NOT EXISTS (SELECT 1 FROM cbp WHERE naics = live.code AND cbp.county_fips = wanted.county_fips)
  UNION ALL SELECT request_id, 'total', NULL, 'establishments', CAST(sum(establishments) AS BIGINT) FROM est GROUP BY 1 UNION ALL SELECT request_id, 'total', NULL, 'with_min', CAST(sum(with_min) AS BIGINT) FROM est GROUP BY 1
  UNION ALL SELECT request_id, 'note', NULL, code || ': sizes are counted from ' || effective_min || ' employees, not ' || min_employees, NULL FROM est WHERE effective_min > min_employees
  UNION ALL SELECT request_id, 'note', NULL, code || ': no published size band begins at ' || min_employees || ' or more', NULL FROM est WHERE min_employees IS NOT NULL AND effective_min IS NULL
  UNION ALL SELECT request_id, 'note', NULL, code || ': ' || CAST(gap AS BIGINT) || ' establishments have no published size', NULL FROM est WHERE gap > 0
  UNION ALL SELECT request_id, 'note', NULL, code || ': ' || absent || ' counties are not published, so unknown', NULL FROM est WHERE absent > 0
  UNION ALL SELECT request_id, 'note', NULL, code || ' is part of ' || ancestor, NULL FROM desc_codes WHERE ancestor IS NOT NULL""", ("cbp",))
def p2_size_market(spark, d):
    """Places in words -> counties; codes -> those that stay; tables -> estimates, what is absent, totals and notes."""
    _, req, codes, _ = _inputs(spark, d)
    n = table(spark, d, "nation")
    words = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey")).select(F.concat(F.lit("q"), F.expr("a.n_nationkey").cast("string")).alias("request_id"), F.concat(F.initcap("b.n_name"), F.lit(" County")).alias("query"))
    asked = words.unionByName(spark.createDataFrame([("q99", "Atlantis")], "request_id string, query string"))
    distinct = asked.select(F.col("query").alias("request_id"), "query").distinct()
    resolved = G.resolve_queries(distinct, states(spark), counties(spark, d), cbsa(spark, d), zcta(spark, d), table(spark, d, "dealers"), table(spark, d, "territories")).select(F.col("request_id").alias("query"), "kind", "counties")
    text = _JSON.replace("CASE WHEN estab % 7 = 0 THEN 'N' ELSE CAST(estab AS STRING) END", "CAST(estab AS STRING)")
    rows = M.decode_cbp(spark.sql(text + "{cbp}", cbp=table(spark, d, "cbp")))[0]
    return M.size_market(asked, resolved, codes, req, rows)
