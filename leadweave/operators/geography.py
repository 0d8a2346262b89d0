"""Geography: requests in, scopes of counties out; points in counties."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions.geo import DEGREE_MILES, circle, inside_rings
from leadweave.operators.routing import sized

CELL = 0.25
#: Edges of a part of a cell, about, and the most parts that a side of a cell has; degrees within which an edge is kept in both of two parts.
PART_EDGES, MOST_PARTS, SLACK = 8, 32, 1e-9
EDGE = ("x1", "y1", "x2", "y2")
COVER = ["county_fips", "_cx", "_cy", "_k", "_parts", "_xmin", "_xmax", "_ymin", "_ymax"]
COUNTY_WORDS = ("county", "parish", "borough", "census area", "municipality", "city and borough")
FILLER = r"\b(?:metro|metropolitan|micropolitan|area|region|greater|statistical|the)\b"


def with_box(counties: DataFrame) -> DataFrame:
    """counties with the box of their rings."""
    points = F.flatten("rings")
    each = lambda k: F.transform(points, lambda p: p[k])
    return counties.withColumns({"xmin": F.array_min(each("lon")), "xmax": F.array_max(each("lon")), "ymin": F.array_min(each("lat")), "ymax": F.array_max(each("lat"))})


def _edges(rings: list) -> np.ndarray:
    """(x1, y1, x2, y2) of every edge that is not level; a level one crosses no ray."""
    points = [np.array([(p["lon"], p["lat"]) for p in ring], float).reshape(-1, 2) for ring in rings]
    every = np.concatenate([np.zeros((0, 4)), *(np.hstack([r[:-1], r[1:]]) for r in points if len(r) > 1)])
    return every[every[:, 1] != every[:, 3]]


def _met_by_rays(edges: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether an odd number of edges is crossed from each point to the east."""
    x1, y1, x2, y2 = (c[None, :] for c in edges.T)
    x, y = x[:, None], y[:, None]
    return (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)).sum(axis=1) % 2 == 1


def _cover(edges: np.ndarray, xmin: float, xmax: float, ymin: float, ymax: float) -> Iterator[tuple]:
    """(cx, cy, k, parts) of the grid's cells that a polygon meets; k is 0 for one that it fills, and parts are k x k."""
    low, high = edges[:, 1::2].min(axis=1), edges[:, 1::2].max(axis=1)
    west, east = edges[:, ::2].min(axis=1), edges[:, ::2].max(axis=1)
    for cy in range(math.floor(ymin / CELL), math.floor(ymax / CELL) + 1):
        for cx in range(math.floor(xmin / CELL), math.floor(xmax / CELL) + 1):
            near = (high >= cy * CELL - SLACK) & (low <= (cy + 1) * CELL + SLACK) & (east >= cx * CELL - SLACK)
            inner = near & (west <= (cx + 1) * CELL + SLACK)
            if not inner.any():
                if _met_by_rays(edges[near], np.array([(cx + 0.5) * CELL]), np.array([(cy + 0.5) * CELL]))[0]:
                    yield cx, cy, 0, None
                continue
            k = min(MOST_PARTS, 1 << max(0, math.ceil(math.log2(max(1, inner.sum()) / PART_EDGES) / 2)))
            size, parts = CELL / k, []
            for i in range(k * k):
                x0, y0 = cx * CELL + i % k * size, cy * CELL + i // k * size
                own = near & (high >= y0 - SLACK) & (low <= y0 + size + SLACK) & (east >= x0 - SLACK)
                beyond = own & (west > x0 + size + SLACK)
                if not (own & ~beyond).any():  # nothing passes through it, so all of its points are alike
                    parts.append((bool(_met_by_rays(edges[own], np.array([x0 + size / 2]), np.array([y0 + size / 2]))[0]), []))
                    continue
                across = beyond & (low < y0 - SLACK) & (high > y0 + size + SLACK)  # every ray crosses these
                parts.append((bool(across.sum() % 2), edges[own & ~across].tolist()))
            yield cx, cy, k, parts


def county_cover(counties: DataFrame) -> DataFrame:
    """Cells of the grid that each county (geoid, rings) fills or whose part it is, with its box: made once for any number of points.

    A cell that the county fills has _k 0. Another is cut into _k x _k parts, the more edges pass through it
    the more, and each part has only the edges that a ray to the east from one of its points can meet or
    miss; those that every such ray meets are in `odd`. So no ring stands in more than one row, and the
    edges of a part tell exactly what the whole rings would.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = pa.struct([(c, pa.float64()) for c in EDGE])
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.struct([("odd", pa.bool_()), ("edges", pa.list_(edge))])), *[pa.float64()] * 4]
        for batch in batches:
            out = []
            for geoid, rings in zip(batch["geoid"].to_pylist(), batch["rings"].to_pylist(), strict=True):
                points = [p for ring in rings or () for p in ring]
                edges = _edges(rings or [])
                if len(edges):
                    x, y = [p["lon"] for p in points], [p["lat"] for p in points]
                    box = min(x), max(x), min(y), max(y)
                    out += [(geoid, cx, cy, k, parts and [{"odd": odd, "edges": [dict(zip(EDGE, e, strict=True)) for e in some]} for odd, some in parts], *box) for cx, cy, k, parts in _cover(edges, *box)]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=COVER)

    edge = ", ".join(f"{c}: double" for c in EDGE)
    types = ["string", "bigint", "bigint", "int", f"array<struct<odd: boolean, edges: array<struct<{edge}>>>>", *["double"] * 4]
    return counties.select("geoid", "rings").mapInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(COVER, types, strict=True)))


def point_in_county(points: DataFrame, counties: DataFrame, cover: DataFrame | None = None) -> DataFrame:
    """points (id, lon, lat, ...) with county_fips, by the cells of the counties' cover. Points in none drop out.

    A point meets the rows of its cell only: in a filled one it sees no edge, else those of its part.
    """
    lon, lat, k = F.col("lon"), F.col("lat"), F.col("_k")
    at = points.withColumns({"_cx": F.floor(lon / CELL), "_cy": F.floor(lat / CELL)})
    met = at.join(cover if cover is not None else county_cover(counties), ["_cx", "_cy"]).where("lon > _xmin and lon < _xmax and lat > _ymin and lat < _ymax")
    place = lambda v, c: F.least(F.greatest(F.floor(v / CELL * k) - F.col(c) * k, F.lit(0)), k - 1)
    part = F.get("_parts", (place(lat, "_cy") * k + place(lon, "_cx")).cast("int"))
    crossed = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    inside = (k == 0) | ((F.size(F.filter(part["edges"], crossed)) % 2 == 1) != part["odd"])
    return met.where(inside).select(*points.columns, "county_fips")


def scope_by_state(requests: DataFrame, states: DataFrame, counties: DataFrame) -> DataFrame:
    """USPS code or name in any case -> all counties of the state."""
    keys = states.select(F.explode(F.array(F.lower("usps"), F.lower("state_name"))).alias("_k"), "state_fips").distinct()
    met = requests.withColumn("_k", F.lower(F.trim("query"))).join(F.broadcast(keys), "_k")  # some fifty states
    own = counties.select("geoid", F.col("statefp").alias("state_fips"))
    return met.join(own, "state_fips").groupBy("request_id").agg(F.sort_array(F.collect_set("geoid")).alias("counties"))


def strip_county(name: Column) -> Column:
    plain = F.trim(F.lower(name))
    return F.trim(F.regexp_replace(F.regexp_replace(plain, rf"\s+(?:{'|'.join(COUNTY_WORDS)})$", ""), r"^county (?:of )?", ""))


def match_counties(requests: DataFrame, counties: DataFrame, states: DataFrame) -> DataFrame:
    """(request_id, geoid, alternatives): FIPS, else exact name, else a beginning of 4 letters or more; the first by FIPS is chosen."""
    parts = F.split(F.col("query"), ",")
    asked = requests.select("request_id", F.trim("query").alias("q"), strip_county(F.get(parts, F.lit(0))).alias("name"), F.lower(F.trim(F.get(parts, F.lit(1)))).alias("state"))
    own = counties.join(F.broadcast(states.select(F.col("state_fips").alias("statefp"), F.lower("usps").alias("usps"))), "statefp", "left").select("geoid", strip_county(F.col("name")).alias("county"), "usps")
    fits = F.col("state").isNull() | (F.col("state") == F.col("usps"))
    own = sized(own)
    by_code = asked.join(own, F.col("q") == F.col("geoid")).select("request_id", "geoid", F.lit(0).alias("rank"))
    exact = asked.join(own, F.col("name") == F.col("county")).where(fits).select("request_id", "geoid", F.lit(1).alias("rank"))
    begins = asked.where(F.length("name") >= 4).withColumn("_p", F.substring("name", 1, 4)).join(own.withColumn("_p", F.substring("county", 1, 4)), "_p").where(F.col("county").startswith(F.col("name")) & fits).select("request_id", "geoid", F.lit(2).alias("rank"))
    every = by_code.unionByName(exact).unionByName(begins)
    best = Window.partitionBy("request_id")
    kept = every.withColumn("_r", F.min("rank").over(best)).where("rank = _r").select("request_id", "geoid").distinct()
    all_of = kept.groupBy("request_id").agg(F.sort_array(F.collect_set("geoid")).alias("all"))
    return all_of.select("request_id", F.get("all", F.lit(0)).alias("geoid"), F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))).alias("alternatives"))


def match_cbsas(requests: DataFrame, cbsa: DataFrame) -> DataFrame:
    """(request_id, cbsa_code, counties): title, a hyphen part of it, or a part with the state; only if none, a beginning of 4 letters or more."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), FILLER, " "), r"\s+", " "))
    titles = cbsa.select("cbsa_code", F.lower("cbsa_title").alias("title")).distinct()
    head, state = F.trim(F.substring_index("title", ",", 1)), F.trim(F.substring_index("title", ",", -1))
    names = titles.withColumn("_part", F.explode(F.split(head, "-"))).select("cbsa_code", F.explode(F.array_distinct(F.array(F.col("title"), head, F.trim("_part"), F.concat(F.trim("_part"), F.lit(", "), state)))).alias("key")).distinct()
    asked = requests.select("request_id", clean(F.col("query")).alias("q"))
    names = sized(names)
    exact = asked.join(names, F.col("q") == F.col("key")).select("request_id", "cbsa_code", F.lit(0).alias("rank"))
    begins = asked.where(F.length("q") >= 4).withColumn("_p", F.substring("q", 1, 4)).join(names.withColumn("_p", F.substring("key", 1, 4)), "_p").where(F.col("key").startswith(F.col("q"))).select("request_id", "cbsa_code", F.lit(1).alias("rank"))
    best = exact.unionByName(begins).withColumn("_r", F.min("rank").over(Window.partitionBy("request_id"))).where("rank = _r").select("request_id", "cbsa_code").distinct()
    return best.join(cbsa.select("cbsa_code", "county_geoid"), "cbsa_code").groupBy("request_id", "cbsa_code").agg(F.sort_array(F.collect_set("county_geoid")).alias("counties"))


def counties_for_zips(requests: DataFrame, zcta: DataFrame) -> DataFrame:
    """(request_id, counties, unknown, found) of requests (request_id, zips: array)."""
    asked = requests.select("request_id", F.explode(F.array_distinct("zips")).alias("zcta5"))
    met = asked.join(zcta, "zcta5", "left")
    return met.groupBy("request_id").agg(
        F.sort_array(F.collect_set("county_geoid")).alias("counties"), F.sort_array(F.collect_set(F.when(F.col("county_geoid").isNull(), F.col("zcta5")))).alias("unknown"), (F.count("county_geoid") > 0).alias("found")
    )


def _crosses(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Segments ab and cd cross or touch."""
    turn = lambda p, q, r: (q["lon"] - p["lon"]) * (r["lat"] - p["lat"]) - (q["lat"] - p["lat"]) * (r["lon"] - p["lon"])
    return (F.signum(turn(a, b, c)) * F.signum(turn(a, b, d)) <= 0) & (F.signum(turn(c, d, a)) * F.signum(turn(c, d, b)) <= 0)


def counties_for_radius(requests: DataFrame, counties: DataFrame) -> DataFrame:
    """(request_id, counties) that a 72-sided polygon around (lat, lon) of `miles` meets; requests of one circle are worked out once."""
    same = ["lat", "lon", "miles"]
    each = _counties_of_circles(requests.select(F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.col("miles").alias("_miles")).distinct(), counties)
    met = requests.select("request_id", *same).join(each, F.expr("lat = _lat and lon = _lon and miles = _miles"))
    return met.groupBy("request_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("counties")))).alias("counties"))


def _counties_of_circles(circles: DataFrame, counties: DataFrame) -> DataFrame:
    """circles (_lat, _lon, _miles), each once, with their counties."""
    requests = circles.select(F.struct("_lat", "_lon", "_miles").alias("request_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), F.col("_miles").alias("miles"))
    dlat = F.col("miles") / DEGREE_MILES
    dlon = F.col("miles") / (DEGREE_MILES * F.cos(F.radians("lat")))
    asked = requests.select("request_id", "lat", "lon", circle(F.col("lat"), F.col("lon"), F.col("miles")).alias("ring"), (F.col("lon") - dlon).alias("x0"), (F.col("lon") + dlon).alias("x1"), (F.col("lat") - dlat).alias("y0"), (F.col("lat") + dlat).alias("y1"))
    boxed = counties if "xmin" in counties.columns else with_box(counties)
    steps = lambda a, b: F.sequence(F.floor(F.col(a) / CELL), F.floor(F.col(b) / CELL))
    boxes = boxed.withColumn("_cx", F.explode(steps("xmin", "xmax"))).withColumn("_cy", F.explode(steps("ymin", "ymax"))).select("_cx", "_cy", "geoid", "xmin", "xmax", "ymin", "ymax")
    spread = asked.select("request_id", "x0", "x1", "y0", "y1").withColumn("_cx", F.explode(steps("x0", "x1"))).withColumn("_cy", F.explode(steps("y0", "y1")))
    near = spread.join(boxes, ["_cx", "_cy"]).where("x0 <= xmax and x1 >= xmin and y0 <= ymax and y1 >= ymin").select("request_id", "geoid").distinct()
    # Boxes choose the pairs; only then each pair gets its rings and its circle, once.
    met = near.join(counties.select("geoid", "rings"), "geoid").join(asked.select("request_id", "lat", "lon", "ring"), "request_id")
    edges = lambda ring: F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    touched = F.exists("rings", lambda ring: F.exists(edges(ring), lambda e: F.exists(edges(F.col("ring")), lambda c: _crosses(e["a"], e["b"], c["a"], c["b"]))))
    corner = F.get(F.get("rings", F.lit(0)), F.lit(0))
    whole = inside_rings(corner["lon"], corner["lat"], F.array("ring"))
    centre = inside_rings(F.col("lon"), F.col("lat"), F.col("rings"))
    return met.where(centre | whole | touched).groupBy("request_id").agg(F.sort_array(F.collect_set("geoid")).alias("counties")).select("request_id.*", "counties")


def scope_by_dealer(requests: DataFrame, dealers: DataFrame, territories: DataFrame, zcta: DataFrame) -> DataFrame:
    """(request_id, counties, zips, error) of requests (request_id, dealer_id)."""
    rules = territories.groupBy("dealer_id").agg(F.collect_set(F.when(F.col("level") == "county", F.col("code"))).alias("own"), F.sort_array(F.collect_set(F.when(F.col("level") == "zip", F.col("code")))).alias("zips"))
    of_zips = territories.where("level = 'zip'").join(zcta, F.col("code") == F.col("zcta5")).groupBy("dealer_id").agg(F.collect_set("county_geoid").alias("of_zips"))
    none = F.expr("cast(array() as array<string>)")
    met = requests.join(dealers.select("dealer_id", F.lit(True).alias("known")), "dealer_id", "left").join(rules, "dealer_id", "left").join(of_zips, "dealer_id", "left")
    return met.select(
        "request_id", F.sort_array(F.array_union(F.coalesce("own", none), F.coalesce("of_zips", none))).alias("counties"), F.coalesce("zips", none).alias("zips"),
        F.when(F.col("known").isNull(), "unknown dealer").when(F.col("own").isNull(), "dealer has no territory").alias("error"),
    )


def union_scopes(scopes: DataFrame) -> DataFrame:
    """One scope per request of several named values: their union, nothing dropped.

    If scopes have alternatives (array), a request of one value keeps its own; one of several has none.
    """
    if "alternatives" in scopes.columns:
        none = F.expr("cast(array() as array<string>)")
        every = F.array_distinct(F.flatten(F.collect_list(F.coalesce("counties", none))))
        return scopes.groupBy("request_id").agg(F.sort_array(every).alias("counties"), F.when(F.count("*") == 1, F.coalesce(F.first("alternatives"), none)).otherwise(none).alias("alternatives"))
    return scopes.select("request_id", F.explode_outer("counties").alias("c")).groupBy("request_id").agg(F.sort_array(F.collect_set("c")).alias("counties"))


def bbox_of_counties(scopes: DataFrame, counties: DataFrame) -> DataFrame:
    boxed = counties if "xmin" in counties.columns else with_box(counties)
    met = scopes.select("request_id", F.explode("counties").alias("geoid")).join(sized(boxed.select("geoid", "xmin", "xmax", "ymin", "ymax")), "geoid")
    return met.groupBy("request_id").agg(F.min("xmin").alias("xmin"), F.min("ymin").alias("ymin"), F.max("xmax").alias("xmax"), F.max("ymax").alias("ymax"))


def states_of_counties(scopes: DataFrame, states: DataFrame) -> DataFrame:
    """(request_id, states): USPS codes of the counties' FIPS beginnings; an unknown beginning stays as it is."""
    begin = scopes.select("request_id", F.explode("counties").alias("c")).select("request_id", F.substring("c", 1, 2).alias("state_fips")).distinct()
    met = begin.join(F.broadcast(states.select("state_fips", "usps")), "state_fips", "left")  # some fifty states
    return met.groupBy("request_id").agg(F.sort_array(F.collect_set(F.coalesce("usps", "state_fips"))).alias("states"))


def resolve_queries(requests: DataFrame, states: DataFrame, counties: DataFrame, cbsa: DataFrame, zcta: DataFrame, dealers: DataFrame, territories: DataFrame) -> DataFrame:
    """(request_id, kind, counties, alternatives) of free text: `dealer:` prefix, state, ZIP list, county word, metro, county; else kind `error`.

    alternatives are the other counties, or metros, that fit a county or metro as well.
    """
    q = F.trim("query")
    is_dealer, is_zips, says_county = q.rlike(r"(?i)^dealer:"), q.rlike(r"^\d{5}(\s*,\s*\d{5})*$"), F.lower(q).rlike(rf"\b(?:{'|'.join(COUNTY_WORDS)})\b")
    open_text = requests.where(~is_dealer & ~is_zips)
    by_dealer = scope_by_dealer(requests.where(is_dealer).select("request_id", F.trim(F.substring_index("query", ":", -1)).alias("dealer_id")), dealers, territories, zcta).where("error is null").select("request_id", F.lit(0).alias("rank"), "counties")
    by_state = scope_by_state(open_text, states, counties).select("request_id", F.lit(1).alias("rank"), "counties")
    by_zip = counties_for_zips(requests.where(is_zips).select("request_id", F.split("query", r"\s*,\s*").alias("zips")), zcta).where("found").select("request_id", F.lit(2).alias("rank"), "counties")
    one = match_counties(open_text, counties, states).select("request_id", F.array("geoid").alias("counties"), "alternatives")
    worded = one.join(open_text.where(says_county).select("request_id"), "request_id", "left_semi").select("request_id", F.lit(3).alias("rank"), "counties", "alternatives")
    metros = match_cbsas(open_text, cbsa).groupBy("request_id").agg(F.min_by("counties", "cbsa_code").alias("counties"), F.sort_array(F.collect_set("cbsa_code")).alias("_all"))
    metro = metros.select("request_id", F.lit(4).alias("rank"), "counties", F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))).alias("alternatives"))
    county = one.select("request_id", F.lit(5).alias("rank"), "counties", "alternatives")
    none = F.expr("cast(array() as array<string>)")
    every = by_dealer.unionByName(by_state).unionByName(by_zip).withColumn("alternatives", none).unionByName(worded).unionByName(metro).unionByName(county)
    best = every.groupBy("request_id").agg(F.min_by(F.struct("rank", "counties", "alternatives"), "rank").alias("b"))
    kinds = F.array(*map(F.lit, ("dealer", "state", "zips", "county", "metro", "county")))
    return requests.select("request_id").join(best, "request_id", "left").select("request_id", F.coalesce(F.get(kinds, F.col("b.rank")), F.lit("error")).alias("kind"), F.col("b.counties").alias("counties"), F.coalesce(F.col("b.alternatives"), none).alias("alternatives"))
