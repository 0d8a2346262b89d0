"""Requests that are alike are worked out once."""

from pyspark.sql import functions as F

from leadweave.operators import geography, lists


def _watched(monkeypatch, module, name):
    """The rows that the inner step was given, by call."""
    seen, inner = [], getattr(module, name)
    monkeypatch.setattr(module, name, lambda df, *rest: seen.append(df.count()) or inner(df, *rest))
    return seen


def test_circles_of_many_requests(spark, monkeypatch):
    seen = _watched(monkeypatch, geography, "_counties_of_circles")
    ring = lambda x: [[{"lon": a, "lat": b} for a, b in ((x, 29.0), (x + 1, 29.0), (x + 1, 30.0), (x, 30.0), (x, 29.0))]]
    counties = spark.createDataFrame([("48001", ring(-96.0)), ("48003", ring(-95.0))], "geoid string, rings array<array<struct<lon:double,lat:double>>>")
    asked = spark.range(500).select(F.col("id").cast("string").alias("request_id"), F.lit(29.5).alias("lat"), F.when(F.col("id") % 2 == 0, -95.9).otherwise(-95.01).alias("lon"), F.lit(3.0).alias("miles"))
    both = asked.unionByName(spark.createDataFrame([("two", 29.5, -95.9, 1.0), ("two", 29.5, -94.5, 1.0), ("none", None, -95.0, 1.0)], "request_id string, lat double, lon double, miles double"))
    got = {r.request_id: r.counties for r in geography.counties_for_radius(both, counties).collect()}
    assert got == {str(i): ["48001"] if i % 2 == 0 else ["48001", "48003"] for i in range(500)} | {"two": ["48001", "48003"]}
    assert seen == [5]

def test_texts_of_many_queries(spark, monkeypatch):
    seen = _watched(monkeypatch, lists, "_rank_texts")
    naics = spark.createDataFrame([("23816", "Roofing Contractors"), ("4931", "Warehousing and Storage")], "code string, title string")
    asked = spark.range(600).select(F.col("id").alias("query_id"), F.when(F.col("id") % 3 == 0, "roofing").when(F.col("id") % 3 == 1, "storage warehousing").alias("query"))
    got = sorted((r.query_id, r.rank, r.code) for r in lists.rank_naics(asked, naics).collect())
    assert got == sorted((i, 1, ("23816", "4931")[i % 3]) for i in range(600) if i % 3 < 2)
    assert seen == [2]
