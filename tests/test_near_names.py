"""Both forms of the similarity of names, and what links by them."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from leadweave.functions.similarity import jaro_winkler, jaro_winklers
from leadweave.operators import dedupe, measure, nearest, places, routing

# 0.9190 with half transpositions and 0.9253 with whole ones.
NEAR = ("frontier marine 2933", "frontier farms 933")


def _names(n):
    draw = random.Random(3)
    some = lambda letters: "".join(draw.choice(letters) for _ in range(draw.randint(1, 30)))
    return pd.Series([some("ab 12") for _ in range(n)] + [NEAR[0]]), pd.Series([some("ab 12") for _ in range(n)] + [NEAR[1]])


def test_batches_equal_single_pairs():
    a, b = _names(3000)
    assert list(jaro_winklers(a, b)) == [jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]
    odd = pd.Series(["", "", "é中a", "x"]), pd.Series(["", "a", "中éa", "x"])
    assert list(jaro_winklers(*odd)) == [jaro_winkler(x, y) for x, y in zip(*odd, strict=True)]


def test_whole_form_equals_duckdb():
    duckdb = pytest.importorskip("duckdb")
    a, b = _names(3000)
    pairs = pd.DataFrame({"i": range(len(a)), "a": a, "b": b})  # noqa: F841
    want = duckdb.connect().execute("SELECT jaro_winkler_similarity(a, b) AS s FROM pairs ORDER BY i").df()["s"]
    assert list(jaro_winklers(a, b, True)) == pytest.approx(list(want), abs=1e-15)  # its boost may round the last bit otherwise
    assert jaro_winkler(*NEAR) < 0.92 <= want.iloc[-1]


def test_whole_form_rounds_as_duckdb(spark):
    """Thirteen of fifteen letters and the first of them: 0.92 if the boost is rounded once, else a bit below."""
    duckdb = pytest.importorskip("duckdb")
    a, b = _names(3000)
    a, b = pd.concat([a, pd.Series(["abcdefghijklmno"])], ignore_index=True), pd.concat([b, pd.Series(["axcdefghijklmny"])], ignore_index=True)
    pairs = pd.DataFrame({"i": range(len(a)), "a": a, "b": b})  # noqa: F841
    want = duckdb.connect().execute("SELECT jaro_winkler_similarity(a, b) AS s FROM pairs ORDER BY i").df()["s"]
    assert list(jaro_winklers(a, b, True)) == list(want) and want.iloc[-1] == 0.92
    sites = spark.createDataFrame([("a", a.iloc[-1], 29.5, -95.8), ("b", b.iloc[-1], 29.5, -95.8)], "site_id string, name_norm string, lat double, lon double")
    got = {r.site_id: (r.component, r.rule, r.is_primary) for r in dedupe.dedupe(sites.selectExpr("*", "null as domain_key", "site_id as gh7", "0.5D as confidence"), whole=True).collect()}
    assert got == {"a": ("a", "fuzzy", True), "b": ("a", "fuzzy", False)}


def test_links_by_either_form(spark):
    sites = spark.createDataFrame([("a", NEAR[0], 29.5, -95.8), ("b", NEAR[1], 29.5, -95.8)], "site_id string, name_norm string, lat double, lon double")
    edges = lambda whole: [tuple(r) for r in dedupe.fuzzy_edges(sites, whole=whole).select("a", "b").collect()]
    assert edges(True) == [("b", "a")] and edges(False) == []


def test_suppression_by_either_form(spark):
    subjects = spark.createDataFrame([("l1", NEAR[0], None, "77001")], "lead_id string, name_norm string, domain_key string, zip5 string")
    rules = spark.createDataFrame([("r1", NEAR[1], None, "77001", "dnc")], "rule_id string, name_norm string, domain_key string, zip5 string, reason string")
    hits = lambda whole: [(r.rule_id, r.kind) for r in routing.match_suppression(subjects, rules, whole=whole).collect()]
    assert hits(True) == [("r1", "fuzzy")] and hits(False) == []


def test_places_of_a_search_are_not_broadcast(spark, tmp_path, capsys):
    """A table of names that packs well passes for a small one; its grams are many times as many rows."""
    spark.range(3000).selectExpr("concat('p', id) as id", "concat('Steel works ', id) as name", "array('services') as hierarchy", "'steel' as leaf", "0.9D as confidence").write.parquet(f"{tmp_path}/p")
    places_ = spark.read.parquet(f"{tmp_path}/p")
    # Of these the plan knows no size, so what it would broadcast are places.
    targets = spark.createDataFrame([("c", "keyword", "works"), ("c", "not_keyword", "17")], "campaign_id string, kind string, value string")
    out = places.match_targets(places_, targets)
    out.explain("formatted")
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" not in plan
    assert out.count() == sum("17" not in f"steel works {i}" for i in range(3000))


def test_matched_sales_meet_no_similar_names(spark, monkeypatch):
    seen, inner = [], measure.split_blocks
    monkeypatch.setattr(measure, "split_blocks", lambda left, *rest: seen.append(sorted(r.name_norm for r in left.collect())) or inner(left, *rest))
    leads = spark.createDataFrame([("l1", "c-1", "acme glass", "77001", "1 main"), ("l2", "c-2", "delta farms", "77001", None)], "lead_id string, offer_code string, name_norm string, zip5 string, address_norm string")
    rows = [(1, "acme glass", "77001", None, None), (2, "acme glas", "77001", None, "C-2"), (3, "acme glasss", "77001", None, None), (4, "other", "77009", "1 main", None), (5, "", "77001", None, None)]
    sales = spark.createDataFrame(rows, "sale_id long, name_norm string, zip5 string, address_norm string, promo_code string").withColumn("sale_date", F.lit("1996-02-01").cast("date"))
    got = sorted(tuple(r) for r in measure.matchback(sales, leads, "1996-01-01", 365).collect())
    assert got == [(1, "l1", "strong", False), (2, "l2", "exact", False), (3, "l1", "fuzzy", True), (4, "l1", "strong", False)]
    assert seen == [["acme glasss"]]


@pytest.mark.parametrize("whole", [True, False])
def test_best_names_of_blocks_equal_brute_force(whole, monkeypatch):
    a, b = (v[:150].sort_values(ignore_index=True) for v in _names(3000))
    b = pd.concat([b, a[:9], pd.Series(["é中 aab", "a" * 40])], ignore_index=True)  # equal names don't count
    block_a, block_b = np.arange(len(a)) // 40, np.arange(len(b)) // 60 + 1
    monkeypatch.setattr(nearest, "BOUNDED", 500)
    monkeypatch.setattr(nearest, "DEEP", 2)
    want = set()
    for i, name in enumerate(a):
        js = [j for j in range(len(b)) if block_b[j] == block_a[i] and b[j] != name]
        jw = jaro_winklers(pd.Series([name] * len(js)), pd.Series([b[j] for j in js]), whole) if js else np.zeros(0)
        want |= {(i, j, s) for j, s in zip(js, jw, strict=True) if s == jw.max() and s >= 0.75}
    assert len(want) > 20 and set(zip(*nearest.best_in(a, b, block_a, block_b, 0.75, whole), strict=True)) == want


def test_names_of_a_zip_are_not_all_compared(spark, monkeypatch):
    """600 sales by 600 leads of one ZIP, all of them near: a few comparisons each, also when the ZIP is cut."""
    word = ("steel", "glass", "farms")
    b = pd.Series([f"acme {word[i % 3]} {600 * i + 7}" for i in range(600)])
    a = b + " llcs"
    seen = []
    monkeypatch.setattr(nearest, "jaro_winklers", lambda x, y, w=False: seen.append(len(x)) or jaro_winklers(x, y, w))
    i, j, _ = nearest.best_in(a, b, np.zeros(600, int), np.zeros(600, int), 0.9, True)
    assert list(i) == list(j) and len(i) == 600 and sum(seen) < 20 * 600
    monkeypatch.undo()
    monkeypatch.setattr(nearest, "RIGHT_ROWS", 100)
    left = spark.createDataFrame([(x, "77001", 0) for x in a], "name_norm string, zip5 string, _part int")
    right = spark.createDataFrame([(x, f"l{k:03}", "77001", 0) for k, x in enumerate(b)], "ln string, lead_id string, zip5 string, _part int")
    got = {r.name_norm: r.lead_id for r in nearest.nearest_names(left, right, ["zip5", "_part"], 0.9, True).collect()}
    assert got == {x: f"l{k:03}" for k, x in enumerate(a)}


def test_names_are_worked_out_once_for_fuzzy_edges(spark):
    seen = spark.sparkContext.accumulator(0)

    def norm(name):
        seen.add(1)
        return name.lower()

    sites = spark.range(60).selectExpr("format_string('s%02d', id) as site_id", "concat('Acme Steel ', id) as name", "29.5D as lat", "-95.8D as lon").withColumn("name_norm", F.udf(norm)("name"))
    assert dedupe.fuzzy_edges(sites).count() > 60
    assert seen.value == 60


def test_two_names_of_a_cell_are_compared_once(monkeypatch):
    """Forty names at nine points each, all near: no pair of names twice, though 81 pairs of sites have it."""
    rows = [(f"s{i:02}{k}", f"acme steel {i * 7}", 29.5 + k % 3 * 1e-4, -95.8 + k // 3 * 1e-4) for i in range(40) for k in range(9)]
    sites = pa.table(dict(zip(("site_id", "name_norm", "lat", "lon"), zip(*rows), strict=True)) | {"block": ["c"] * len(rows)})
    compared, inner = [], nearest.winklers
    monkeypatch.setattr(nearest, "winklers", lambda x, *rest: compared.append(x.shape[1]) or inner(x, *rest))
    got = [(ids[i].as_py(), ids[j].as_py()) for a, b, ids in dedupe._near_sites(sites, sites, 0.92, 200.0, True) for i, j in zip(a, b, strict=True)]
    names = pd.DataFrame(rows)[1].unique()
    similar = {(x, y) for x in names for y in names if jaro_winklers(pd.Series([x]), pd.Series([y]), True)[0] >= 0.92}
    assert len(got) == len(set(got)) and set(got) == {(p[0], q[0]) for p in rows for q in rows if p[0] > q[0] and (p[1], q[1]) in similar}
    assert sum(compared) <= 40 * 41 / 2


@pytest.mark.parametrize("whole", [True, False])
def test_fuzzy_edges_of_cut_cells_equal_brute_force(spark, monkeypatch, whole):
    """Cells cut on either side, a name that alone is more than a part, sites across borders of cells and none without a point."""
    draw = random.Random(5)
    a, b = _names(30)
    names = sorted({*a, *b} - {"", *(x for x in a if not x.strip())})
    rows = [(f"s{k:03}", draw.choice(names[:12] if k % 2 else names), 29.4985 + draw.randrange(30) * 1e-4, -95.8015 + draw.randrange(30) * 1e-4) for k in range(350)]
    rows += [(f"t{k:03}", "acme", 29.5 + k * 1e-5, -95.8) for k in range(40)] + [("u1", "acme", None, -95.8), ("u2", "acme", float("nan"), -95.8), ("u3", "", 29.5, -95.8)]
    monkeypatch.setattr(dedupe, "PART_ROWS", 25)
    monkeypatch.setattr(dedupe, "RIGHT_ROWS", 40)
    monkeypatch.setattr(dedupe, "GROUP_ROWS", 60)
    sites = spark.createDataFrame(rows, "site_id string, name_norm string, lat double, lon double")
    got = [(r.a, r.b) for r in dedupe.fuzzy_edges(sites, 0.85, whole=whole).collect()]
    first, want = {}, set()
    for r in sorted(r for r in rows if r[1] and r[2] is not None and r[2] == r[2]):
        if r[1:] in first:
            want.add((r[0], first[r[1:]]))
        else:
            first[r[1:]] = r[0]
    kept = [(i, *key) for key, i in first.items()]
    pairs = pd.DataFrame([(p, q) for p in kept for q in kept if p[0] > q[0]], columns=["p", "q"])
    p, q = (pd.DataFrame(list(pairs[c]), columns=["id", "name", "lat", "lon"]) for c in "pq")
    h = np.sin(np.radians(q.lat - p.lat) / 2) ** 2 + np.cos(np.radians(p.lat)) * np.cos(np.radians(q.lat)) * np.sin(np.radians(q.lon - p.lon) / 2) ** 2
    near = (2 * 6_371_008.8 * np.arcsin(np.sqrt(h)) <= 200) & (jaro_winklers(p.name, q.name, whole) >= 0.85)
    want |= set(zip(p.id[near], q.id[near], strict=True))
    assert len(want) > 500 and len(got) == len(set(got)) and set(got) == want


def test_all_edges_of_many_near_names_are_linear(spark):
    """200 names at one point, each near all others of its kind: one edge a site, with the components of all pairs."""
    rows = [(f"s{k:03}", f"{('acme steel', 'bayou farms')[k % 2]} {k * 7 if k % 10 else 'x' * k}", 29.5, -95.8) for k in range(200)]
    sites = spark.createDataFrame(rows, "site_id string, name_norm string, lat double, lon double").selectExpr("*", "null as domain_key", "site_id as gh7")
    pairs = dedupe.fuzzy_edges(sites).cache()
    edges = dedupe.all_edges(sites)
    parts = lambda e: sorted(tuple(r) for r in dedupe.connected_components(e).select("id", "component").collect())
    assert parts(edges) == parts(pairs) and edges.count() < 200 < 5000 < pairs.count()
    assert {r.rule for r in edges.select("rule").distinct().collect()} == {2}


def test_lowest_follows_chains():
    label = dedupe._lowest(np.arange(9), np.array([8, 7, 6, 3]), np.array([7, 6, 5, 2]))
    assert list(dedupe._lowest(label, np.array([8]), np.array([3]))) == [0, 1, 2, 2, 4, 2, 2, 2, 2]
