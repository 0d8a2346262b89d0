"""Normalising, distances, similarity: known values of the rules."""

import pytest
from pyspark.sql import functions as F

from leadweave.functions import geo, normalize
from leadweave.functions.similarity import jaro_winkler

NAMES = {
    "The Bayou Fulfillment Co., LLC": "bayou fulfillment", "Gulf Coast Sign & Lighting": "gulf coast sign and lighting", "Ship Channel Logistics, L.L.C.": "ship channel logistics",
    "Houston The Woodlands Glass": "houston the woodlands glass", "CO Industries": "co industries", "Corp Services LLC": "corp services", "Bayou Fulfillment Co Inc LLC": "bayou fulfillment",
    "  Prairie   Warehousing  ": "prairie warehousing", "O'Brien Rigging": "obrien rigging", "Buffalo 3PL Services": "buffalo 3pl services", "LLC": "", "": "", None: "",
}
DOMAINS = {
    "https://www.bayoufulfillment.example": "bayoufulfillment.example", "www.chartersupply.example": "chartersupply.example", "HTTPS://WWW.BayouFulfillment.Example": "bayoufulfillment.example",
    "https://bayoufulfillment.example:8443/x?y=1": "bayoufulfillment.example", "http://a.b.co.uk/": "b.co.uk", "https://www.facebook.com/x": None, "https://sites.google.com/view/x": None, "https://x.business.site": None,
    "mailto:sales@bayoufulfillment.example": None, "not a url at all": None, "ftp://a.example": None, "   ": None, None: None, "localhost": None,
}


def test_names(spark):
    rows = spark.createDataFrame(list(NAMES.items()), "n string, e string").withColumn("got", normalize.name_norm(F.col("n"))).collect()
    assert [(r["n"], r["got"]) for r in rows] == list(NAMES.items())


def test_domains(spark):
    rows = spark.createDataFrame(list(DOMAINS.items()), "n string, e string").withColumn("got", normalize.domain_key(F.col("n"))).collect()
    assert [(r["n"], r["got"]) for r in rows] == list(DOMAINS.items())


def test_zip_address_digest(spark):
    r = spark.createDataFrame([(" 77001-1234 ", "12 Main St.,  #4"), ("  ", None)], "z string, a string")
    r = r.select(normalize.zip5(F.col("z")).alias("z"), normalize.address_norm(F.col("a")).alias("a"), normalize.row_digest("p_", F.col("z"), F.col("a")).alias("d")).collect()
    assert (r[0]["z"], r[0]["a"], r[1]["z"], r[1]["a"]) == ("77001", "12 main st 4", None, None)
    assert len(r[0]["d"]) == 18 and r[0]["d"].startswith("p_")


@pytest.mark.parametrize(("a", "b", "e"), [("martha", "marhta", 0.9611), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133), ("summit signs", "summit sign", 0.9833), ("coastal crane and rigging", "coastal crane rigging", 0.9442), ("", "", 1.0), ("", "x", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, e):
    assert jaro_winkler(a, b) == pytest.approx(e, abs=5e-5)
    assert jaro_winkler(b, a) == pytest.approx(e, abs=5e-5)


def test_geohash_and_edges(spark):
    rows = spark.createDataFrame([(57.64911, 10.40744, "u4pruyd"), (90.0, 180.0, "zzzzzzz"), (-90.0, -180.0, "0000000")], "lat double, lon double, e string").withColumn("g", geo.geohash(F.col("lat"), F.col("lon"))).collect()
    assert all(r["g"] == r["e"] for r in rows)


def test_distance(spark):
    r = spark.range(1).select(geo.distance_m(F.lit(29.0), F.lit(-95.0), F.lit(30.0), F.lit(-95.0)).alias("m")).first()
    assert r["m"] == pytest.approx(111195.08, abs=0.5)
