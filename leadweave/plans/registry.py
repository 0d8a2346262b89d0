"""Registration of queries with the SQL that checks them, and SQL snippets of the normalising rules."""

from __future__ import annotations

from collections.abc import Callable

from leadweave.functions.normalize import GENERIC_HOSTS, LEGAL_SUFFIXES, SECOND_LEVEL
from leadweave.sources.adapter import with_tables

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, tables: tuple[str, ...] = ()) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL over the named domain tables."""

    def register(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_tables(sql, *tables) if tables else sql
        return f

    return register


def _quoted(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


def name_norm(c: str) -> str:
    plain = rf"trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '&', ' and '), '[^\p{{L}}\p{{Nd}}\s]', '', 'g'), '\s+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({plain}, '^(?:the(?: |$))+', ''), '(?:(?:^| )(?:{'|'.join(LEGAL_SUFFIXES)}))+$', ''))"


def domain_key(c: str) -> str:
    """Of websites with or without http(s), with a host of two labels or more, as the domain tables have them."""
    host = rf"regexp_replace(lower(regexp_extract(regexp_replace({c}, '^https?://', ''), '^([^/?#]*)', 1)), '^www\.', '')"
    last = f"array_to_string(list_slice(string_split({host}, '.'), -2, -1), '.')"
    three = f"array_to_string(list_slice(string_split({host}, '.'), -3, -1), '.')"
    return f"CASE WHEN {c} IS NULL OR {last} IN ({_quoted(GENERIC_HOSTS)}) OR {host} IN ({_quoted(GENERIC_HOSTS)}) THEN NULL WHEN {last} IN ({_quoted(SECOND_LEVEL)}) THEN {three} ELSE {last} END"


def geohash7(lat: str, lon: str) -> str:
    x = f"least(CAST(floor(({lon} + 180.0::DOUBLE) / 360.0::DOUBLE * 262144) AS BIGINT), 262143)"
    y = f"least(CAST(floor(({lat} + 90.0::DOUBLE) / 180.0::DOUBLE * 131072) AS BIGINT), 131071)"
    out = []
    for i in range(7):
        bits = []
        for j in range(5):
            at = 5 * i + j
            bits.append(f"((({x} >> {17 - at // 2}) & 1) << {4 - j})" if at % 2 == 0 else f"((({y} >> {16 - at // 2}) & 1) << {4 - j})")
        out.append(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({' + '.join(bits)} AS BIGINT) + 1, 1)")
    return " || ".join(out)


def distance_m(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"pow(sin(radians({lat2} - {lat1}) / 2.0::DOUBLE), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2.0::DOUBLE), 2)"
    return f"(2.0::DOUBLE * 6371008.8::DOUBLE * asin(least(1.0::DOUBLE, sqrt({h}))))"


#: SQL table function body: `nsites` with the normalised columns.
NSITES = f"nsites AS (SELECT *, {name_norm('name')} AS name_norm, {domain_key('website')} AS domain_key, {geohash7('lat', 'lon')} AS gh7 FROM sites)"
