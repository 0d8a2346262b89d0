"""The search of candidates takes every place that fits, however many a state has."""

import pytest
from pyspark.sql import functions as F

from leadweave.operators import places
from leadweave.plans import catalog

SMALL = "/root/testdata/sf0.001"


def test_a_state_with_more_places_than_the_cap_is_found_whole(spark):
    n = places.PER_STATE + 3
    ring = [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]]
    counties = spark.createDataFrame([("48001", "A", ring)], "geoid string, name string, rings array<array<struct<lon:double,lat:double>>>")
    scopes = spark.createDataFrame([("c1", "48001"), ("c2", "48001")], "campaign_id string, county_fips string")
    targets = spark.createDataFrame([("c1", "category", "works"), ("c2", "keyword", "steel")], "campaign_id string, kind string, value string")
    near = spark.range(n).select(
        F.format_string("p%06d", "id").alias("id"), F.lit("Steel").alias("name"), F.array(F.lit("works")).alias("hierarchy"), F.lit("works").alias("leaf"), F.lit(0.9).alias("confidence"),
        F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat"), F.lit("TX").alias("state"),
    )
    found = places.find_for_campaigns(near, counties, scopes, targets)
    assert {(r["campaign_id"], r["count"]) for r in found.groupBy("campaign_id").count().collect()} == {("c1", n), ("c2", n)}
    first = places.find_for_campaigns(near, counties, scopes, targets, per_state=2)  # the reference's limit, where it is asked for
    assert sorted((r["campaign_id"], r["id"]) for r in first.collect()) == [(c, f"p{i:06d}") for c in ("c1", "c2") for i in (0, 1)]


def test_the_report_counts_places_beyond_the_cap(spark, tmp_path):
    """The last 60 places of a state with more than PER_STATE, and they alone, are of another category and the most confident."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("region", "nation", "supplier"):
        con.execute(f"COPY (FROM '{SMALL}/{t}.parquet') TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    # Keys whose places the search finds, all of one state.
    fits = """k // 3 % 3 = 0 AND k // 24 % 9 <> 6 AND k % 41 <> 0 AND k % 43 <> 0 AND k // 3 * 37 % 1000 BETWEEN 10 AND 580 AND k // 3 * 37 % 200 < 90 AND k // 3 * 61 % 200 BETWEEN 10 AND 90"""
    con.execute(f"CREATE TABLE chosen AS (SELECT k, false AS late FROM range(400000) r(k) WHERE {fits} AND k * 7919 % 600 BETWEEN 210 AND 560 ORDER BY k LIMIT {places.PER_STATE})")
    con.execute(f"INSERT INTO chosen SELECT k, true FROM range(400000, 1000000) r(k) WHERE {fits} AND k * 7919 % 600 > 560 ORDER BY k LIMIT 60")
    con.execute(f"COPY (SELECT k AS c_custkey, CAST(k % 25 AS INTEGER) AS c_nationkey, CASE WHEN late THEN 'MACHINERY' ELSE 'BUILDING' END AS c_mktsegment FROM chosen) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    for t in ("region", "nation", "supplier", "customer"):
        con.execute(f"CREATE VIEW {t} AS FROM '{tmp_path}/{t}.parquet'")
    assert con.execute("SELECT count(*) FROM chosen").fetchone()[0] == places.PER_STATE + 60
    report = catalog.QUERIES["p1_candidate_report"](spark, str(tmp_path))
    got = {(r["part"], r["name"], r["leads"]) for r in report.collect()}
    assert [n for part, name, n in got if (part, name) == ("category", "machinery")]
    assert got == set(con.execute(f"SELECT part, name, leads FROM ({catalog.ORACLE_SQL['p1_candidate_report']})").fetchall())
