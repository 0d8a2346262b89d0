"""Cells, distances and polygon tests as native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.functions.binding import let

# Geohash letters, Earth radius in metres, metres in a mile, miles in a degree.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
EARTH_M = 6_371_008.8
MILE_M = 1609.344
DEGREE_MILES = 69.0547


def geohash(lat: Column, lon: Column, precision: int = 7) -> Column:
    """Longitude bit first, upper half on equality; the poles and the antimeridian lie in the top cells."""
    bits = 5 * precision
    lon_bits, lat_bits = (bits + 1) // 2, bits // 2
    x = F.least(F.floor((lon + 180.0) / 360.0 * float(2**lon_bits)), F.lit(2**lon_bits - 1))
    y = F.least(F.floor((lat + 90.0) / 180.0 * float(2**lat_bits)), F.lit(2**lat_bits - 1))

    def letters(at: Column) -> Column:
        out = []
        for i in range(precision):
            index = F.lit(0)
            for j in range(5):
                bit = 5 * i + j
                source, size = (at["x"], lon_bits) if bit % 2 == 0 else (at["y"], lat_bits)
                index = index + F.shiftright(source, size - 1 - bit // 2).bitwiseAND(F.lit(1)) * (1 << (4 - j))
            out.append(F.substring(F.lit(ALPHABET), (index + 1).cast("int"), F.lit(1)))
        return F.concat(*out)

    return let(F.struct(x.cast("bigint").alias("x"), y.cast("bigint").alias("y")), letters)


def with_geohash(df: DataFrame, lat: str, lon: str, precision: int = 7, out: str = "geohash") -> DataFrame:
    return df.withColumn(out, geohash(F.col(lat), F.col(lon), precision))


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2.0), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2.0), 2.0)
    return F.lit(2.0 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def with_distance_m(df: DataFrame, p: tuple[str, str], q: tuple[str, str], out: str = "distance_m") -> DataFrame:
    return df.withColumn(out, distance_m(F.col(p[0]), F.col(p[1]), F.col(q[0]), F.col(q[1])))


def inside_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Even-odd rule over all rings (array of arrays of (lon, lat)), so holes and several polygons need no care."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        crossed = F.filter(
            edges,
            lambda e: ((e["a"]["lat"] > lat) != (e["b"]["lat"] > lat))
            & (lon < (e["b"]["lon"] - e["a"]["lon"]) * (lat - e["a"]["lat"]) / (e["b"]["lat"] - e["a"]["lat"]) + e["a"]["lon"]),
        )
        return F.size(crossed)

    return F.aggregate(F.transform(rings, crossings), F.lit(0), lambda a, x: a + x) % 2 == 1


def circle(lat: Column, lon: Column, miles: Column, sides: int = 72) -> Column:
    """Corners of the polygon that stands for a circle: degrees by miles per degree, longitude by the cosine."""
    dlat = miles / DEGREE_MILES
    dlon = miles / (DEGREE_MILES * F.cos(F.radians(lat)))
    return F.array(*(F.struct((lon + dlon * math.cos(2 * math.pi * i / sides)).alias("lon"), (lat + dlat * math.sin(2 * math.pi * i / sides)).alias("lat")) for i in range(sides + 1)))
