"""Reports of routing on few or many rows."""

import random

from pyspark.sql import functions as F

from leadweave.functions.geo import distance_m
from leadweave.operators import routing


def test_gap_report_without_gaps_has_its_total(spark):
    leads = spark.createDataFrame([("candidate", "auto", "48001", "x")], "status string, assignment string, county_fips string, leaf string")
    assert [tuple(r) for r in routing.coverage_gap_report(leads).collect()] == [(None, None, 0, 3)]
    gap = leads.selectExpr("status", "'gap' as assignment", "county_fips", "leaf")
    assert sorted(tuple(r)[2:] for r in routing.coverage_gap_report(gap).collect()) == [(1, 0), (1, 1), (1, 3)]


def test_nearest_branch_equals_all_pairs(spark):
    draw = random.Random(5)
    at = lambda: (round(draw.uniform(29.5, 29.9), 2), round(draw.uniform(-95.8, -95.4), 3))
    leads = [(f"l{i}", f"d{i % 4}" if i % 9 else None, *at()) for i in range(300)] + [("far", "d1", 89.9, 179.9), ("none", "d1", None, -95.0), ("other", "d9", 29.5, -95.5)]
    branches = [(f"b{i}", f"d{i % 3}", *at()) for i in range(400)] + [("nowhere", "d2", None, None), ("b0", "d3", 29.7, -95.6), ("a0", "d3", 29.7, -95.6)]
    ls, bs = spark.createDataFrame(leads, "lead_id string, dealer_id string, lat double, lon double"), spark.createDataFrame(branches, "branch_id string, dealer_id string, branch_lat double, branch_lon double")
    m = distance_m(F.col("lat"), F.col("lon"), F.col("branch_lat"), F.col("branch_lon"))
    want = ls.join(bs, "dealer_id").groupBy("lead_id").agg(F.min(F.struct(m.alias("m"), F.col("branch_id").alias("b"))).alias("x")).select("lead_id", "x.b", "x.m")
    got = routing.nearest_branch(ls, bs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_points_meet_few_branches(spark):
    points = spark.range(2000).selectExpr("'d' as dealer_id", "29.5D + id % 50 / 50 as lat", "-95.8D + floor(id / 50) / 40 as lon")
    places = spark.range(4000).selectExpr("'d' as dealer_id", "concat('b', id) as b", "29.5D + id % 63 / 63 as branch_lat", "-95.8D + floor(id / 63) / 63 as branch_lon")
    assert 2000 <= routing.near_branches(points, places).count() < 2000 * 4000 / 50
