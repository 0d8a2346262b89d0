"""Market sizing from county business tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.sources.shared import written

TOTAL_BAND = "001"
MAX_INT = 2_147_483_647


def decode_cbp(df: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of array-of-arrays JSON whose first row names the columns.

    Of a repeated name the first column counts; the NAICS column is found by its prefix; a county code
    is state and county; a row whose establishments aren't a whole number is a reject.
    """
    read = df.withColumn("_t", F.from_json(column, "array<array<string>>")).withColumn("_h", F.get("_t", F.lit(0)))
    cell = lambda name: F.get("_r", (F.array_position("_h", name) - 1).cast("int"))
    naics_at = F.array_position(F.transform("_h", lambda h: h.startswith("NAICS") & ~h.contains("LABEL")), True) - 1
    rows = read.select("_h", naics_at.cast("int").alias("_n"), F.posexplode(F.slice("_t", 2, F.greatest(F.size("_t") - 1, F.lit(0)))).alias("row", "_r"))
    out = rows.select(
        "row", F.get("_r", F.col("_n")).alias("naics"), F.concat(F.lpad(cell("state"), 2, "0"), F.lpad(cell("county"), 3, "0")).alias("county_fips"),
        cell("EMPSZES").alias("band"), cell("EMPSZES_LABEL").alias("label"), cell("ESTAB").alias("raw"), cell("ESTAB").try_cast("bigint").alias("estab"),
    )
    return out.where("estab is not null").select("naics", "county_fips", "band", "label", "estab"), out.where("estab is null").select("row", "raw")


def drop_descendant_codes(codes: DataFrame) -> DataFrame:
    """(request_id, code, ancestor): the shortest other code of the request that it extends; null if it stays.

    A code of at most six digits has at most five shorter beginnings, so it meets them by equality.
    """
    own = codes.select("request_id", "code").distinct()
    begins = own.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.length("code") - 1, F.lit(1))))).where(F.col("n") < F.length("code"))
    shorter = begins.withColumn("ancestor", F.col("code").substr(F.lit(1), F.col("n")))
    met = shorter.join(own.select("request_id", F.col("code").alias("ancestor")), ["request_id", "ancestor"])
    first = met.groupBy("request_id", "code").agg(F.min_by("ancestor", F.length("ancestor")).alias("ancestor"))
    return own.join(first, ["request_id", "code"], "left")


def band_range(label: Column, band: Column) -> tuple[Column, Column]:
    """(lower, upper) of a size label: below n is 0 to n - 1, n or more is open (upper null), the total has none."""
    numbers = F.transform(F.regexp_extract_all(F.regexp_replace(label, ",", ""), F.lit(r"(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    first, second = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    below, open_top = F.lower(label).contains("less than"), F.lower(label).contains("or more")
    none = (band == TOTAL_BAND) | F.coalesce(F.size(numbers) == 0, F.lit(True))
    lower = F.when(none, F.lit(None)).when(below, F.lit(0)).otherwise(first)
    upper = F.when(none | open_top, F.lit(None)).when(below, first - 1).otherwise(F.coalesce(second, first))
    return lower.cast("int"), upper.cast("int")


def parse_size_bands(df: DataFrame) -> DataFrame:
    lower, upper = band_range(F.col("label"), F.col("band"))
    return df.withColumns({"lower": lower, "upper": upper})


def partition_bands(bands: DataFrame, keys: list[str]) -> DataFrame:
    """Bands that lie in no other band of their group: with distinct ranges, none that a lower or equal start reaches over.

    Ordered by (lower, upper descending), a band lies inside an earlier one iff the furthest end so far reaches its own.
    """
    top = F.coalesce("upper", F.lit(MAX_INT))
    ranges = parse_size_bands(bands.select(*keys, "band", "label").distinct()).where("lower is not null").withColumn("_top", top)
    before = Window.partitionBy(*keys).orderBy("lower", F.desc("_top"), "band").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(F.struct("_top", (-F.col("lower")).alias("start"))).over(before)
    # The same range twice is not strictly inside.
    same = (reach["_top"] == F.col("_top")) & (-reach["start"] == F.col("lower"))
    return ranges.withColumn("_inside", F.coalesce((reach["_top"] >= F.col("_top")) & ~same, F.lit(False))).where("not _inside").drop("_inside", "_top")


def select_bands(bands: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """Bands that start at a request's threshold or above, with the threshold that this really is."""
    met = bands.join(requests.select("request_id", "min_employees"), "request_id")
    return met.where("lower >= min_employees").withColumn("effective_min", F.min("lower").over(Window.partitionBy(*keys))).withColumn("rounded_up", F.col("effective_min") > F.col("min_employees"))


def estimate_market(rows: DataFrame, requests: DataFrame, codes: DataFrame, counties: DataFrame) -> DataFrame:
    """A row per request and code that stays: establishments, with_min, gap, absent counties.

    requests: request_id, min_employees (null for none). codes, counties: request_id with code, county_fips.
    A sum is null where nothing is published; establishments with no published band are the gap.
    """
    live = drop_descendant_codes(codes).where("ancestor is null").select("request_id", "code")
    wanted = live.join(counties, "request_id")
    got = wanted.join(rows, (F.col("code") == F.col("naics")) & (counties["county_fips"] == rows["county_fips"]), "left").select(
        "request_id", "code", counties["county_fips"].alias("county_fips"), "band", "label", "estab"
    )
    keys = ["request_id", "code"]
    whole = partition_bands(got.where("band is not null"), keys)
    chosen = select_bands(whole, requests, keys).select(*keys, "band", "effective_min", "rounded_up")
    flagged = (
        got.join(whole.select(*keys, "band", F.lit(True).alias("whole")), [*keys, "band"], "left")
        .join(chosen, [*keys, "band"], "left").join(requests, "request_id")
    )
    absent = flagged.groupBy(*keys, "county_fips").agg(F.count("estab").alias("n")).groupBy(*keys).agg(F.count_if(F.col("n") == 0).alias("absent"), F.count_if(F.col("n") > 0).alias("present"))
    sums = flagged.groupBy(*keys).agg(
        F.sum(F.when(F.col("band") == TOTAL_BAND, F.col("estab"))).alias("establishments"),
        F.sum(F.when(F.col("effective_min").isNotNull(), F.col("estab"))).alias("with_min"),
        F.sum(F.when(F.col("whole"), F.col("estab"))).alias("banded"), F.max("effective_min").alias("effective_min"), F.max("rounded_up").alias("rounded_up"), F.first("min_employees").alias("min_employees"),
    )
    out = sums.join(absent, keys).withColumn("gap", F.col("establishments") - F.coalesce("banded", F.lit(0)))
    return out.withColumn("error", F.when(F.col("gap") < 0, "bands sum to more than the total")).drop("banded")


def absent_counties(rows: DataFrame, codes: DataFrame, counties: DataFrame) -> DataFrame:
    """Requested counties without a row of the code: unknown, never zero."""
    have = rows.select(F.col("naics").alias("code"), "county_fips").distinct()
    return codes.join(counties, "request_id").join(have, ["code", "county_fips"], "left_anti").groupBy("request_id", "code").agg(F.sort_array(F.collect_set("county_fips")).alias("absent"))


def market_totals(estimates: DataFrame) -> DataFrame:
    return estimates.groupBy("request_id").agg(F.sum("establishments").alias("establishments"), F.sum("with_min").alias("with_min"))


def market_notes(estimates: DataFrame, dropped: DataFrame, county_only: DataFrame | None = None) -> DataFrame:
    """(request_id, note): dropped codes, rounded thresholds, thresholds no band reaches, gaps, absent counties."""
    notes = F.array_compact(F.array(
        F.when(F.col("rounded_up"), F.concat(F.col("code"), F.lit(": sizes are counted from "), F.col("effective_min").cast("string"), F.lit(" employees, not "), F.col("min_employees").cast("string"))),
        F.when(F.col("min_employees").isNotNull() & F.col("effective_min").isNull(), F.concat(F.col("code"), F.lit(": no published size band begins at "), F.col("min_employees").cast("string"), F.lit(" or more"))),
        F.when(F.col("gap") > 0, F.concat(F.col("code"), F.lit(": "), F.col("gap").cast("string"), F.lit(" establishments have no published size"))),
        F.when(F.col("absent") > 0, F.concat(F.col("code"), F.lit(": "), F.col("absent").cast("string"), F.lit(" counties are not published, so unknown"))),
    ))
    own = estimates.select("request_id", F.explode(notes).alias("note"))
    gone = dropped.where("ancestor is not null").select("request_id", F.concat("code", F.lit(" is part of "), "ancestor").alias("note"))
    out = own.unionByName(gone)
    if county_only is not None:
        out = out.unionByName(county_only.select("request_id", F.lit("whole counties are counted, though the area is smaller").alias("note")))
    return out


def size_market(asked: DataFrame, resolved: DataFrame, codes: DataFrame, requests: DataFrame, rows: DataFrame) -> DataFrame:
    """(request_id, part, code, detail, value): the whole answer to requests in words, a row per fact.

    asked: (request_id, query), one or more places in words per request. resolved: (query, kind, counties) of
    every distinct query. codes: (request_id, code). requests: (request_id, min_employees). rows: decoded business tables.
    Parts are `unknown` (a query that names no area), `county`, `dropped` (a code and, as detail, the one it is part of), `establishments`,
    `with_min` and `gap` (per code; null where nothing is published), `absent` (a code and a county), `total` (detail says of what)
    and `note`. A request none of whose queries names an area has no counties and so only its unknown queries and dropped codes.
    """
    # Each of these feeds several parts.
    met = written(asked.join(resolved, "query"), "asked")
    rows = written(rows, "rows")
    known = met.where("kind <> 'error'")
    counties = written(known.select("request_id", F.explode("counties").alias("county_fips")).distinct(), "counties")
    smaller = known.where("kind = 'zips'").select("request_id").distinct()
    dropped = written(drop_descendant_codes(codes), "codes")
    live = dropped.where("ancestor is null").select("request_id", "code")
    estimates = written(estimate_market(rows, requests, codes, counties), "estimates")
    none = F.lit(None)
    fact = lambda df, part, code=none, detail=none, value=none: df.select("request_id", F.lit(part).alias("part"), code.cast("string").alias("code"), detail.cast("string").alias("detail"), value.cast("bigint").alias("value"))
    code, totals = F.col("code"), market_totals(estimates)
    parts = [
        fact(met.where("kind = 'error'"), "unknown", detail=F.col("query")), fact(counties, "county", detail=F.col("county_fips")), fact(dropped.where("ancestor is not null"), "dropped", code, F.col("ancestor")),
        *(fact(estimates, c, code, value=F.col(c)) for c in ("establishments", "with_min", "gap")), fact(absent_counties(rows, live, counties).withColumn("county", F.explode("absent")), "absent", code, F.col("county")),
        *(fact(totals, "total", detail=F.lit(c), value=F.col(c)) for c in ("establishments", "with_min")), fact(market_notes(estimates, dropped, smaller), "note", detail=F.col("note")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
