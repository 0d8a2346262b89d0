"""Scopes, places by partitions, and fitted weights on small tables."""

import math

from pyspark.sql import functions as F

from leadweave.operators import geography, measure, places
from leadweave.operators.scoring import FEATURES


def ring(*points):
    return [[(float(x), float(y)) for x, y in (*points, points[0])]]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def test_counties_for_radius(spark):
    """Around (30, -95) ten miles are 0.1448 degrees north and 0.1672 east."""
    dlon = 10 / 69.0547 / math.cos(math.radians(30))
    shapes = {
        "00001": box(-97, 28, -93, 32),  # contains the circle
        "00002": box(-95.05, 30.02, -95.02, 30.05),  # inside the circle, its centre outside
        "00003": box(-94.9, 29.9, -94.0, 30.1),  # crosses it
        "00004": box(-95 + dlon + 0.001, 29.9, -94.0, 30.1),  # begins just beyond it
        "00005": ring((-94.87, 30.14), (-94.5, 30.14), (-94.5, 30.4)),  # its box meets the circle's, the polygons don't
        "00006": box(-100, 20, -99, 21),
        "00007": box(-95 + dlon, 29.9, -94.0, 30.1),  # touches the corner in the east
        "00008": box(-95 + dlon * 0.5, 29.0, -95 + dlon * 0.55, 31.0),  # a strip across, without a corner inside
    }
    counties = spark.createDataFrame(list(shapes.items()), "geoid string, rings array<array<struct<lon:double,lat:double>>>")
    asked = spark.createDataFrame([(1, 30.0, -95.0, 10.0)], "request_id int, lat double, lon double, miles double")
    got = geography.counties_for_radius(asked, counties).collect()
    assert [r["counties"] for r in got] == [["00001", "00002", "00003", "00007", "00008"]]


def test_alternatives_stay_with_one_value(spark):
    one = "request_id int, counties array<string>, alternatives array<string>"
    scopes = spark.createDataFrame([(1, ["b"], ["c", "d"]), (2, ["b"], ["c"]), (2, ["a", "b"], []), (3, None, None)], one)
    got = {r["request_id"]: (r["counties"], r["alternatives"]) for r in geography.union_scopes(scopes).collect()}
    assert got == {1: (["b"], ["c", "d"]), 2: (["a", "b"], []), 3: ([], [])}


def test_two_metros_of_one_beginning(spark):
    counties = spark.createDataFrame([("48001", "Anderson County", "48")], "geoid string, name string, statefp string")
    states = spark.createDataFrame([("48", "TX", "Texas")], "state_fips string, usps string, state_name string")
    cbsa = spark.createDataFrame([("20", "Springfield, MO", "29077"), ("10", "Springdale, AR", "05007"), ("10", "Springdale, AR", "05143")], "cbsa_code string, cbsa_title string, county_geoid string")
    none = spark.createDataFrame([], "dealer_id string, level string, code string, zcta5 string, county_geoid string")
    asked = spark.createDataFrame([(1, "Greater Spring"), (2, "Springfield"), (3, "Nowhere")], "request_id int, query string")
    out = geography.resolve_queries(asked, states, counties, cbsa, none.select("zcta5", "county_geoid"), none.select("dealer_id"), none.select("dealer_id", "level", "code"))
    got = {r["request_id"]: (r["kind"], r["counties"], r["alternatives"]) for r in out.collect()}
    assert got == {1: ("metro", ["05007", "05143"], ["20"]), 2: ("metro", ["29077"], []), 3: ("error", None, [])}


def test_states_are_pruned_by_partition(spark, tmp_path):
    df = spark.range(30).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("S"), (F.col("id") % 3).cast("string")).alias("state"))
    places.write_extract(df, str(tmp_path / "x"), "r1")
    read = places.read_places(spark, str(tmp_path / "x"), ["S0", "S2"])
    assert read.count() == 20 and places.read_places(spark, str(tmp_path / "x")).count() == 30
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [state" in plan and "PushedFilters: []" in plan
    places.write_extract(df.where("state = 'S1'").limit(4), str(tmp_path / "x"), "r1")
    assert places.read_places(spark, str(tmp_path / "x")).count() == 24  # other states stay


def test_weights_follow_what_wins(spark):
    k = F.col("id")
    rows = spark.range(400).select(F.when(k < 300, "A").when(k < 350, "B").otherwise("C").alias("segment"), *(((k * (i + 3)) % 7 / 7.0).alias(f"v_{f}") for i, f in enumerate(FEATURES) if f != "signals"), (k % 2).cast("double").alias("v_signals"), F.when(k >= 350, True).otherwise(k % 2 == 1).alias("won"))
    got = measure.fit_weights(rows).collect()
    assert {r["segment"] for r in got} == {"A"}  # B has too few rows, C only one outcome
    w = {r["feature"]: r["weight"] for r in got}
    assert set(w) == set(FEATURES) and abs(sum(w.values()) - 1) < 1e-9 and min(w.values()) >= 0
    assert w["signals"] > 0.8
