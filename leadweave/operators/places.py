"""Places: extraction, profile matching, flattening to sites."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leadweave.functions.normalize import domain_key, name_norm, zip5
from leadweave.operators.geography import point_in_county
from leadweave.operators.routing import sized
from leadweave.sources.shared import written

COLUMNS = ("id", "name", "basic_category", "taxonomy", "confidence", "websites", "phones", "addresses", "lon", "lat")
CONFIDENCE_FLOOR, PER_STATE = 0.6, 5000


def read_places(spark: SparkSession, path: str, states: list[str] | None = None) -> DataFrame:
    """The extract, pruned to whole states by its partitions."""
    df = spark.read.parquet(path)
    return df.where(F.col("state").isin(*states)) if states else df


def extract_state(raw: DataFrame, bounds: tuple[float, float, float, float], state: str) -> DataFrame:
    """Places whose box begins inside the state's box and whose first address is in the state: a pushed-down filter on struct fields."""
    west, south, east, north = bounds
    inside = F.col("bbox.xmin").between(west, east) & F.col("bbox.ymin").between(south, north)
    return raw.where(inside & (F.size("addresses") > 0) & (F.get("addresses", F.lit(0))["region"] == state)).select(*COLUMNS).withColumn("state", F.lit(state))


def write_extract(df: DataFrame, path: str, release: str) -> None:
    """One partition per release and state; only the states in df are replaced."""
    df.withColumn("release", F.lit(release)).write.partitionBy("release", "state").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def incremental_extract(wanted: DataFrame, existing: DataFrame, force: bool = False) -> DataFrame:
    """(state, step, rows): a state whose extract has rows is skipped, unless forced; others are to be built."""
    have = existing.groupBy("state").agg(F.count("*").alias("rows")).where("rows > 0")
    met = wanted.join(have, "state", "left")
    build = F.lit(force) | F.col("rows").isNull()
    return met.select("state", F.when(build, "build").otherwise("skip").alias("step"), F.coalesce("rows", F.lit(0)).alias("rows"))


def extract_manifest(spark: SparkSession, path: str, release: str) -> DataFrame:
    """(state, rows) of the states that the release's extract has; Parquet counts the rows in its footers."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "state string, rows bigint")
    return found.where(F.col("release") == release).groupBy(F.col("state").cast("string").alias("state")).agg(F.count("*").alias("rows"))


def _drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def extract_states(raw: DataFrame, bounds: DataFrame) -> DataFrame:
    """extract_state for a table of states (state, west, south, east, north), in one pass over raw."""
    first = F.get("addresses", F.lit(0))["region"]
    inside = F.col("bbox.xmin").between(F.col("west"), F.col("east")) & F.col("bbox.ymin").between(F.col("south"), F.col("north"))
    return raw.join(sized(bounds), first == F.col("state")).where(inside).select(*COLUMNS, "state")


def rebuild_extract(raw: DataFrame, bounds: DataFrame, path: str, release: str, force: bool = False) -> DataFrame:
    """(state, step, rows): builds the wanted states that the extract lacks, all if forced, and says what it has now.

    A state with rows is skipped, and if none is left raw isn't read. Those that are built are written beside the others
    and take their partitions' places; a forced state without rows any more loses its partition.
    """
    spark = raw.sparkSession
    wanted = bounds.select("state").distinct()
    have = written(extract_manifest(spark, path, release).where("rows > 0"), "manifest")
    steps = written(wanted.join(have, "state", "left").select("state", F.when(F.lit(force) | F.col("rows").isNull(), "build").otherwise("skip").alias("step")), "steps")
    todo = bounds.join(steps.where("step = 'build'"), "state", "left_semi")
    if todo.limit(1).count():
        built = written(extract_states(raw, todo), "extract") if force else extract_states(raw, todo)
        write_extract(built.hint("rebalance", "state"), path, release)
        if force:
            # Partitions that were forced and have no rows any more, some of fifty states.
            gone = todo.select("state").distinct().join(have.select("state"), "state", "left_semi").join(built.select("state").distinct(), "state", "left_anti")
            for r in gone.collect():
                _drop_folder(spark, f"{path}/release={release}/state={r['state']}")
    now = extract_manifest(spark, path, release)
    return steps.join(now, "state", "left").select("state", "step", F.coalesce("rows", F.lit(0)).alias("rows"))


def category_match(hierarchy: Column, leaf: Column, categories: list[str]) -> Column:
    """Case-sensitive; null where the taxonomy is, so that a negated match drops the row too."""
    return F.arrays_overlap(F.filter(hierarchy, lambda h: h.isNotNull()), F.array(*map(F.lit, categories)).cast("array<string>")) | leaf.isin(*categories)


def keyword_match(name: Column, words: list[str]) -> Column:
    """The lower-cased name contains a word; null for a null name."""
    found = F.lit(False)
    for w in words:
        found = found | F.lower(name).contains(w.strip().lower())
    return F.when(name.isNull(), F.lit(None)).otherwise(found)


def find_places(places: DataFrame, counties: DataFrame, county_fips: list[str], categories: list[str], keywords: list[str], not_categories: list[str] = (), not_keywords: list[str] = (), floor: float = CONFIDENCE_FLOOR, per_state: int = PER_STATE) -> DataFrame:
    """Places of the counties that match a profile, at most `per_state` of a state in the order of their ids."""
    near = counties.where(F.col("geoid").isin(*county_fips))
    kept = places.where(F.col("confidence") >= floor)
    match = F.lit(False)
    if categories:
        match = match | category_match(F.col("hierarchy"), F.col("leaf"), list(categories))
    if keywords:
        match = match | keyword_match(F.col("name"), list(keywords))
    kept = kept.where(match)
    if not_categories:
        kept = kept.where(~category_match(F.col("hierarchy"), F.col("leaf"), list(not_categories)))
    if not_keywords:
        kept = kept.where(~keyword_match(F.col("name"), list(not_keywords)))
    met = point_in_county(kept, near)
    order = Window.partitionBy("state").orderBy("id")
    return met.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_state).drop("_rn")


GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All substrings of this length, each once."""
    n = F.length(text) - size + 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array())


def _containing(names: DataFrame, words: DataFrame) -> DataFrame:
    """(id, word) of every name (id, n) that contains a word, by an inverted index of the words.

    A word of GRAM letters or more stands in the index under that one of its grams that the fewest names
    have, a shorter one under itself. Names meet the index by their grams, so a name sees the few words
    that it may contain, however many there are. Names and their grams are shuffled, never broadcast: the size of
    a table of names says little of that of its grams.
    """
    names = names.hint("merge")
    long, short = words.where(F.length("word") >= GRAM), words.where(F.length("word") < GRAM)
    of_words = long.select("word", F.explode(_grams(F.col("word"), GRAM)).alias("gram"))
    of_names = names.select("id", "n", F.explode(_grams(F.col("n"), GRAM)).alias("gram"))
    often = of_names.join(of_words.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("names"))
    index = of_words.join(often.hint("merge"), "gram").groupBy("word").agg(F.min_by("gram", F.struct("names", "gram")).alias("gram"), F.count("*").alias("met"))
    # A word some gram of which no name has is in no name.
    index = index.where(F.col("met") == F.size(_grams(F.col("word"), GRAM))).drop("met")
    few = names.select("id", "n", F.explode(F.concat(_grams(F.col("n"), 1), _grams(F.col("n"), 2))).alias("word")).join(short, "word").select("id", "word")
    return of_names.join(index, "gram").where(F.col("n").contains(F.col("word"))).select("id", "word").unionByName(few)


def match_targets(places: DataFrame, targets: DataFrame) -> DataFrame:
    """(campaign_id, id) of places (id, name, hierarchy, leaf, confidence) that fit a campaign's targets (campaign_id, kind, value).

    As find_places does for one profile: a place has one of the categories in its taxonomy or one of the
    keywords in its name, none of the excluded ones, and the confidence; where a campaign excludes categories
    (keywords), a place without a taxonomy (name) doesn't fit. Targets stay a table: taxonomies meet them by
    node, names by an inverted index, so one pass over the places serves all campaigns. Places are shuffled,
    since the packed size of their table can pass for a small one.
    """
    places = places.hint("merge")
    nodes = places.select("id", F.explode(F.array_distinct(F.concat(F.coalesce("hierarchy", F.array().cast("array<string>")), F.array("leaf")))).alias("value")).where("value is not null")
    by_node = nodes.join(targets.where("kind in ('category', 'not_category')"), "value").select("campaign_id", "id", "kind")
    words = targets.where("kind in ('keyword', 'not_keyword')").select("campaign_id", "kind", F.lower(F.trim("value")).alias("word"))
    names = places.where("name is not null").select("id", F.lower("name").alias("n"))
    by_word = _containing(names, words.select("word").distinct()).join(words, "word").select("campaign_id", "id", "kind")
    said = by_node.unionByName(by_word).groupBy("campaign_id", "id").agg(F.max(F.col("kind").startswith("not_")).alias("excluded")).where("not excluded").drop("excluded")
    has = lambda k: F.coalesce(F.max(F.col("kind") == k), F.lit(False)).alias(k)
    asks = targets.groupBy("campaign_id").agg(has("not_category"), has("not_keyword"), F.coalesce(F.max(F.when(F.col("kind") == "min_confidence", F.col("value").try_cast("double"))), F.lit(CONFIDENCE_FLOOR)).alias("floor"))
    known = places.select("id", "confidence", (F.col("hierarchy").isNotNull() & F.col("leaf").isNotNull()).alias("has_taxonomy"), F.col("name").isNotNull().alias("has_name"))
    met = said.join(asks, "campaign_id").join(known, "id")
    return met.where("confidence >= floor and (has_taxonomy or not not_category) and (has_name or not not_keyword)").select("campaign_id", "id")


def find_for_campaigns(places: DataFrame, counties: DataFrame, scopes: DataFrame, targets: DataFrame, per_state: int | None = None) -> DataFrame:
    """(campaign_id, id, county_fips, state): find_places for every campaign of the tables scopes (campaign_id, county_fips) and targets.

    Places are located once, in the counties that any campaign asks for. Ids of places are distinct.
    All that fit are found; with `per_state` the first of a campaign and state by id, at most so many.
    """
    asked = counties.join(scopes.select(F.col("county_fips").alias("geoid")).distinct(), "geoid", "left_semi")
    # The only pass over all places: what is in some campaign's counties is written, and matched from there.
    near = written(point_in_county(places.select("id", "name", "hierarchy", "leaf", "confidence", "lon", "lat", "state"), asked), "near")
    met = match_targets(near, targets).join(near.hint("merge").select("id", "county_fips", "state"), "id").join(scopes.select("campaign_id", "county_fips").distinct(), ["campaign_id", "county_fips"])
    if per_state is None:
        return met.select("campaign_id", "id", "county_fips", "state")
    order = Window.partitionBy("campaign_id", "state").orderBy("id")
    return met.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= per_state).select("campaign_id", "id", "county_fips", "state")


def scope_filter(sites: DataFrame, zips: list[str] | None = None, centre: tuple[float, float] | None = None, miles: float | None = None) -> DataFrame:
    """The exact scope inside its counties: ZIP codes, or a distance."""
    from leadweave.functions.geo import MILE_M, distance_m

    if zips is not None:
        sites = sites.where(F.col("zip5").isin(*zips))
    if centre is not None:
        sites = sites.where(distance_m(F.col("lat"), F.col("lon"), F.lit(centre[0]), F.lit(centre[1])) <= miles * MILE_M)
    return sites


def places_to_sites(places: DataFrame, release: str) -> DataFrame:
    """A flat row per place: first website, phone and address (a blank first is null), normalised keys, the raw row as JSON."""
    first = lambda c: F.nullif(F.trim(F.get(c, F.lit(0))), F.lit(""))
    address = F.get("addresses", F.lit(0))
    part = lambda c: F.nullif(F.trim(address[c]), F.lit(""))
    return places.select(
        F.col("id").alias("site_id"), F.trim("name").alias("name"), first("websites").alias("website"), first("phones").alias("phone"),
        part("freeform").alias("address"), part("locality").alias("city"), part("region").alias("state"), zip5(address["postcode"]).alias("zip5"),
        "lat", "lon", "confidence", F.col("taxonomy.primary").alias("leaf"), F.nullif(F.array_join("taxonomy.hierarchy", "|"), F.lit("")).alias("taxonomy_path"),
        name_norm(F.col("name")).alias("name_norm"), domain_key(first("websites")).alias("domain_key"), F.lit(release).alias("release"), F.to_json(F.struct(*places.columns)).alias("payload_json"),
    )


def _distinct(values: Column) -> Column:
    """Trimmed, blanks dropped, the first of those equal but for case."""
    clean = F.filter(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), lambda v: F.trim(v)), lambda v: F.length(v) > 0)
    lowered = F.transform(clean, F.lower)
    return F.filter(clean, lambda v, i: F.array_position(lowered, F.lower(v)) == i + 1)


PROFILE = "segments array<struct<name:string,categories:array<string>,keywords:array<string>,minEmployees:int>>, excludeCategories array<string>, excludeKeywords array<string>, minConfidence double, minEmployees int, geography string"


def profile_targets(profiles: DataFrame) -> DataFrame:
    """(campaign_id, kind, value): categories and keywords of all segments, exclusions, confidence floor, geography."""
    p = F.from_json("profile_json", PROFILE)
    of = lambda k: _distinct(F.flatten(F.transform(p["segments"], lambda s: F.coalesce(s[k], F.expr("cast(array() as array<string>)")))))
    one = lambda kind, values: F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    every = F.concat(
        one("category", of("categories")), one("keyword", of("keywords")), one("not_category", _distinct(p["excludeCategories"])), one("not_keyword", _distinct(p["excludeKeywords"])),
        one("min_confidence", F.array(F.coalesce(p["minConfidence"], F.lit(CONFIDENCE_FLOOR)).cast("string"))), one("geography", _distinct(F.array(p["geography"]))),
    )
    return profiles.select("campaign_id", F.inline(every))


def profile_segments(profiles: DataFrame) -> DataFrame:
    """(campaign_id, pos, segment, categories, keywords, min_employees, profile_min) in profile order."""
    p = F.from_json("profile_json", PROFILE)
    return profiles.select("campaign_id", p["minEmployees"].alias("profile_min"), F.posexplode(p["segments"]).alias("pos", "s")).select(
        "campaign_id", "pos", F.col("s.name").alias("segment"), _distinct(F.col("s.categories")).alias("categories"), _distinct(F.col("s.keywords")).alias("keywords"), F.col("s.minEmployees").alias("min_employees"), "profile_min"
    )
