"""Entity resolution: edges between sites of one company, components, primaries and duplicates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.functions.geo import EARTH_M
from leadweave.operators.blocks import PART_ROWS, split_blocks
from leadweave.operators.components import connected_components
from leadweave.operators.nearest import GROUP_ROWS, RIGHT_ROWS, similar_in
from leadweave.sources.shared import written

GRID, SPAN_CAP = 0.005, 64
#: Metres of a degree of latitude, a bit less than they are so that a span loses no site, and the least cosine for one of longitude.
DEGREE_M, LEAST_COS = 111_000.0, 1e-6
#: Between a campaign and an id in the keys of one table for all campaigns; ids and names don't have it.
SEPARATOR = "\x1f"
EDGE = ("a", "b", "rule")


def _star(sites: DataFrame, keys: list[str], rule: int) -> DataFrame:
    """Every site of a group with the group's smallest id: linear however large the group."""
    low = sites.groupBy(*keys).agg(F.min("site_id").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return sites.join(low, keys).where("site_id <> b").select(F.col("site_id").alias("a"), "b", F.lit(rule).alias("rule"))


def domain_edges(sites: DataFrame) -> DataFrame:
    return _star(sites.where("domain_key is not null").select("site_id", "domain_key"), ["domain_key"], 0)


def name_place_edges(sites: DataFrame) -> DataFrame:
    return _star(sites.where("name_norm <> ''").select("site_id", "name_norm", "gh7"), ["name_norm", "gh7"], 1)


class _Names:
    """Sites of blocks by name: the names of each block in its order, and the range of sites, boxes and ids that each has."""

    def __init__(self, sites: pa.Table, block: np.ndarray, name: np.ndarray, site: np.ndarray):
        self.order = np.lexsort((name, block))
        self.lat, self.lon = (sites[c].to_numpy()[self.order] for c in ("lat", "lon"))
        self.cos = np.cos(np.radians(self.lat))
        self.site, block, name = site[self.order], block[self.order], name[self.order]
        new = np.ones(len(site), bool)
        new[1:] = (block[1:] != block[:-1]) | (name[1:] != name[:-1])
        self.start = np.flatnonzero(new)
        self.n = np.diff(self.start, append=len(site))
        self.block, self.name = block[new], name[new]
        ends = lambda v: (np.minimum.reduceat(v, self.start), np.maximum.reduceat(v, self.start)) if len(v) else (v, v)
        self.south, self.north = ends(self.lat)
        self.west, self.east = ends(self.lon)
        self.first, self.last = ends(self.site)


def _codes(left: pa.ChunkedArray, right: pa.ChunkedArray, ordered: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Numbers of equal values of both sides, in the order of the values if `ordered`, and the values by number."""
    both = pa.chunked_array([*left.chunks, *right.chunks], left.type).combine_chunks().dictionary_encode()
    code, values = both.indices.to_numpy(), both.dictionary
    if ordered:
        order = pc.sort_indices(values).to_numpy()
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        code, values = place[code], values.take(pa.array(order))
    return code[: len(left)], code[len(left) :], values


def _near_sites(left: pa.Table, right: pa.Table, threshold: float, within_m: float, whole: bool) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """(site of left, smaller site of right, ids by number) of the near pairs of a block, in batches; each two names of a block are compared once."""
    (block_a, block_b, _), (name_a, name_b, names), (site_a, site_b, ids) = (_codes(left[c], right[c], c == "site_id") for c in ("block", "name_norm", "site_id"))
    p, q = _Names(left, block_a, name_a, site_a), _Names(right, block_b, name_b, site_b)
    names = names.to_numpy(zero_copy_only=False)
    lat_span = within_m / DEGREE_M
    lon_span = within_m / (DEGREE_M * np.maximum(np.cos(np.radians(np.minimum(np.maximum(abs(p.south), abs(p.north)) + lat_span, 90.0))), LEAST_COS))

    def counts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = (p.last[i] > q.first[j]) & (p.south[i] - q.north[j] <= lat_span) & (q.south[j] - p.north[i] <= lat_span)
        return near & (p.west[i] - q.east[j] <= lon_span[i]) & (q.west[j] - p.east[i] <= lon_span[i])

    for i, j in similar_in(pd.Series(names[p.name]), pd.Series(names[q.name]), p.block, q.block, threshold, whole, counts):
        pairs = p.n[i] * q.n[j]
        of = np.repeat(np.arange(len(i)), pairs)
        k = np.arange(len(of)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        row, col = np.divmod(k, q.n[j][of])
        a, b = p.start[i][of] + row, q.start[j][of] + col
        smaller = p.site[a] > q.site[b]
        a, b = a[smaller], b[smaller]
        h = np.sin(np.radians(q.lat[b] - p.lat[a]) / 2) ** 2 + p.cos[a] * q.cos[b] * np.sin(np.radians(q.lon[b] - p.lon[a]) / 2) ** 2
        near = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))) <= within_m
        yield p.site[a[near]], q.site[b[near]], ids


def _lowest(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest site that each site is linked with, where pairs (a, b) join what `label` links already."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, low, high = a[apart], b[apart], np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def fuzzy_edges(sites: DataFrame, threshold: float = 0.92, within_m: float = 200.0, within: tuple[str, ...] = (), whole: bool = False, linked: bool = False) -> DataFrame:
    """Pairs of similar names near each other, blocked on a degree grid: a cell meets the sites within reach of it.

    Sites of one name at one point form a star to their smallest id, which alone meets the others, so
    that however many stand at one point of a geocoder stay linear. Names of a cell meet once, wherever its sites
    have them, in parts of either side that bound what a task holds; names whose letters don't allow the similarity aren't compared. Sites without a
    point have no edge. Only sites with equal columns `within` meet. `whole` is the form of the similarity.
    With `linked` the edges have the same components, but are stars of each task's linked sites: no more than its sites, however many pairs are near.
    """
    cell = lambda c: F.floor(c / GRID)
    # Written before the filter, which would have the names worked out twice.
    named = written(sites.select(*within, "site_id", "name_norm", "lat", "lon"), "named").where("name_norm <> '' and lat is not null and lon is not null and site_id is not null")
    star = _star(named, [*within, "name_norm", "lat", "lon"], 2)
    plain = named.groupBy(*within, "name_norm", "lat", "lon").agg(F.min("site_id").alias("site_id"))
    plain = written(plain.withColumns({"row": cell(F.col("lat")), "col": cell(F.col("lon"))}), "names")
    # A name with more points in a cell than a part has rows is cut by its sites, all others stay whole.
    own = [*within, "row", "col", "name_norm"]
    many = plain.groupBy(*own).agg(F.ceil(F.count("*") / PART_ROWS).alias("_cuts")).where("_cuts > 1")
    cut = plain.join(many, own, "left").withColumn("_cut", F.pmod(F.xxhash64("site_id"), F.coalesce("_cuts", F.lit(1)))).drop("_cuts")
    lat_span = within_m / DEGREE_M
    cos = F.greatest(F.cos(F.radians(F.least(F.abs("lat") + lat_span, F.lit(90.0)))), F.lit(LEAST_COS))
    lon_span = F.least(within_m / (DEGREE_M * cos), F.lit(SPAN_CAP * GRID))
    around = cut.withColumn("row", F.explode(F.sequence(cell(F.col("lat") - lat_span), cell(F.col("lat") + lat_span)))).withColumn("col", F.explode(F.sequence(cell(F.col("lon") - lon_span), cell(F.col("lon") + lon_span))))
    block = F.concat(*(x for c in (*within, "row", "col") for x in (F.col(c).cast("string"), F.lit(SEPARATOR)))).alias("block")
    left, right = (df.select(block, "site_id", "name_norm", "lat", "lon", "_cut").where("block is not null") for df in (cut, around))
    left, right, _ = split_blocks(left, right, ["block"], PART_ROWS, by=["name_norm", "_cut"])
    left, right = (df.withColumnRenamed("_part", "_left") for df in (left, right))
    right, left, keys = split_blocks(right, left, ["block", "_left"], RIGHT_ROWS, by=["name_norm", "_cut"])
    right = right.select(*(F.col(c).alias(c) for c in right.columns))  # else its columns are the left side's to a cogroup
    group = [F.pmod(F.xxhash64("block"), F.lit(1 + plain.count() // GROUP_ROWS)).alias("_group"), *keys[1:]]

    def compare(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        kind = pa.schema([("a", l.schema.field("site_id").type), ("b", l.schema.field("site_id").type)])
        if linked:
            label = None
            for a, b, ids in _near_sites(l, r, threshold, within_m, whole):
                label = _lowest(np.arange(len(ids)) if label is None else label, a, b)
            a = np.flatnonzero(label != np.arange(len(label))) if label is not None else np.zeros(0, int)
            return pa.table([ids.take(pa.array(a)), ids.take(pa.array(label[a]))], schema=kind) if len(a) else kind.empty_table()
        found = [pa.record_batch([ids.take(pa.array(a)), ids.take(pa.array(b))], kind) for a, b, ids in _near_sites(l, r, threshold, within_m, whole)]
        return pa.Table.from_batches(found, kind)

    kind = sites.schema["site_id"].dataType.simpleString()
    near = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(compare, f"a {kind}, b {kind}")
    return star.unionByName(near.select("a", "b", F.lit(2).alias("rule")))


RULES = ("domain", "name-place", "fuzzy")


def all_edges(sites: DataFrame, within: str | None = None, whole: bool = False) -> DataFrame:
    """Edges with the components of all rules; the keys that they need are worked out once and written."""
    own = [within] if within else []
    scoped = lambda c: F.concat_ws(SEPARATOR, within, c).alias(c) if within else F.col(c)
    there = lambda c: F.when(F.col(c).isNotNull(), scoped(c)).alias(c) if within else F.col(c)
    keys = written(sites.select(*own, scoped("site_id"), "name_norm", there("domain_key"), there("gh7"), "lat", "lon"), "keys")
    return domain_edges(keys).unionByName(name_place_edges(keys)).unionByName(fuzzy_edges(keys, within=tuple(own), whole=whole, linked=True))


def dedupe(sites: DataFrame, within: str | None = None, whole: bool = False) -> DataFrame:
    """sites with component, rule and is_primary: most confident, then smallest id; rule of the earliest edge, `none` alone.

    With a column `within`, such as the campaign, only sites of one value are compared, and a site may be in several.
    """
    if within:
        out = _grouped(sites.withColumn("_uid", F.concat_ws(SEPARATOR, within, "site_id")), "_uid", all_edges(sites, within, whole))
        return out.drop("_uid").withColumn("component", F.substring_index("component", SEPARATOR, -1))
    return _grouped(sites, "site_id", all_edges(sites, whole=whole))


def _grouped(sites: DataFrame, uid: str, edges: DataFrame) -> DataFrame:
    edges = written(edges, "edges")
    parts = connected_components(edges)
    met = sites.join(parts.withColumnRenamed("id", uid), uid, "left").withColumn("component", F.coalesce("component", uid))
    rules = edges.join(parts, edges["a"] == parts["id"]).groupBy("component").agg(F.min("rule").alias("r"))
    c = F.col("confidence")
    # A minimum has partial results in every task, so a component of any size needs no sort.
    first = met.groupBy("component").agg(F.min(F.struct(c.isNull(), ~F.isnan(c), -c, F.col(uid).alias("primary"))).alias("f")).select("component", "f.primary")
    name = F.coalesce(F.get(F.array(*map(F.lit, RULES)), F.col("r")), F.lit("none"))
    known = first.join(rules, "component", "left")
    return met.join(known, "component").withColumns({"rule": name, "is_primary": F.col(uid) == F.col("primary")}).drop("r", "primary")


def distinct_by_id(places: DataFrame, id_col: str, order: list[Column]) -> DataFrame:
    """One row per id, the first in the order given."""
    first = Window.partitionBy(id_col).orderBy(*order)
    return places.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def primary_of_duplicates(leads: DataFrame, company: DataFrame) -> DataFrame:
    """(duplicate lead, first lead of the same company in the campaign that isn't a duplicate)."""
    with_company = leads.join(company, "site_id").select("campaign_id", "lead_id", "status", "company_id")
    first = with_company.where("status <> 'duplicate'").groupBy("campaign_id", "company_id").agg(F.min("lead_id").alias("primary_lead"))
    return with_company.where("status = 'duplicate'").join(first, ["campaign_id", "company_id"], "left").select("campaign_id", "lead_id", "primary_lead")
