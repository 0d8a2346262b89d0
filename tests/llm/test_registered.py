"""The registered queries of the operators on the smallest tables: SQL, libraries, brute force, held-out rows."""

import collections
import math
import os
import re
import zlib

import numpy as np
import pytest

from test_text_operators import brute_components, brute_site_lines

from leadweave.llm import pii, queries, toxicity

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(DIR), reason="no tables here")
TABLES = "documents pages embeddings labels".split()


@pytest.fixture(scope="module")
def duck():
    con = pytest.importorskip("duckdb").connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def documents(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()}


def plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, DIR)
    want = duck.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in got.collect()) == sorted(tuple(map(plain, r)) for r in want.fetchall())


@pytest.mark.parametrize("name", ["op1_secret_scan", "op3_tokeniser_fertility"])
def test_a_row_per_document(spark, documents, name):
    got = queries.QUERIES[name](spark, DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(documents)


def test_codec_equals_the_library(spark, documents):
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    got = {r["doc_id"]: r["n_tokens"] for r in queries.op7_piece_codec(spark, DIR).collect()}
    assert got == {i: len(sp.encode(r["text"] or "", add_eos=True)) for i, r in documents.items()}


def test_packing_equals_the_library(spark, documents):
    encoder = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    got = collections.defaultdict(list)
    for r in queries.op8_best_fit_packing(spark, DIR).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
    for i, r in documents.items():
        ids = encoder.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        assert sum(n for _, n, _ in got[i]) == len(ids)
        assert all(crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()) for at, n, crc in got[i])


def aligned(text, new):
    """(entity, surrogate) of a text, where all between entities is as it was."""
    regex = pytest.importorskip("regex")
    found = [m.group() for m in regex.finditer(pii.ENTITY.replace("\\p{Is", "\\p{"), text)]
    gaps = regex.split(pii.ENTITY.replace("\\p{Is", "\\p{"), text)
    m = re.fullmatch("(.*?)".join(map(re.escape, gaps)), new, re.S)
    assert m, (text[:200], new[:200])
    return list(zip(found, m.groups(), strict=True))


def test_surrogates_by_brute_force(spark, documents):
    r = np.random.default_rng(8)
    first, last = [a + b for a in ("Jo", "Pe", "Ma") for b in ("ran", "lo", "mir")], [a + b for a in ("Sm", "Kl", "Br") for b in ("ith", "ein", "own")]
    kinds = [
        lambda: f"{r.choice(first)}.{r.choice(last)}@{r.choice(['x', 'y.z'])}.example.com", lambda: ".".join(map(str, r.integers(1, 255, 4))), lambda: f"+{r.integers(1, 99)} ({r.integers(100, 999)}) 555-{r.integers(1000, 9999)}",
        lambda: " ".join(str(r.integers(1000, 9999)) for _ in range(4)), lambda: f"{r.choice(['Mr.', 'Mrs.', 'Dr.'])} {r.choice(first)} {r.choice(last)}", lambda: f"{r.choice(['Mr.', 'Frau'])} {r.choice(last)}",
    ]
    rows = [(i, "; ".join(f"so {kinds[k]()} said" for k in r.integers(0, len(kinds), 12))) for i in range(120)]
    made = pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), "k").collect()
    mine = queries.op2_pii_surrogates(spark, DIR).collect()
    assert len(mine) == len(documents)
    for table, source in ((made, dict(rows)), (mine, {i: d["text"] for i, d in documents.items()})):
        people, others = {}, {}
        for row in table:
            pairs = aligned(source[row["doc_id"]] or "", row["text"] or "")
            assert row["n_entities"] == len(pairs)
            for old, new in pairs:
                title = re.match(pii.TITLE, old)
                if title:
                    assert new.startswith(title[0])
                    people.setdefault(old[title.end() :].lower(), set()).add(new[title.end() :].lower())
                else:
                    assert "@" in old or re.sub(r"\d", "", old) == re.sub(r"\d", "", new)
                    others.setdefault(old.lower(), set()).add(new)
        # The same entity always has the same surrogate, and no two have one; no surrogate is an entity.
        assert all(len(v) == 1 for v in others.values()) and len(set.union(set(), *others.values())) == len(others)
        assert not set.union(set(), *others.values()) & set(others)
        whole = {k: v for k, v in people.items() if " " in k}
        assert len({x.split()[-1] for v in people.values() for x in v}) == len({k.split()[-1] for k in people})
        # A first name may have one surrogate for each gender that honorifics give it.
        assert all(len(v) <= 3 for v in whole.values()) and sum(map(len, whole.values())) == len(set.union(set(), *whole.values()))


def auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    for s in np.unique(score):
        rank[score == s] = rank[score == s].mean()
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


def test_quality_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.op4_quality(spark, folder).collect() if r["held_out"] and labels.get(r["doc_id"]) is not None]
    score, label = np.array([r["score"] for r in got]), np.array([labels[r["doc_id"]] for r in got])
    assert len(got) > 20 and auc(score, label) > 0.9
    assert np.mean(np.array([r["predicted"] for r in got]) == label) > 0.85


def test_severity_on_rows_held_out(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.train(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0"))
    known = {r["doc_id"]: r["toxic"] for r in labels.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    got = [r for r in toxicity.grade(docs, model).collect() if r["doc_id"] in known]
    toxic = np.array([known[r["doc_id"]] for r in got])
    expected = np.array([r["expected_severity"] for r in got])
    assert ((expected >= 0) & (expected <= toxicity.GRADES)).all() and auc(expected, toxic) > 0.95
    rejected = np.array([r["rejected"] for r in got])
    assert rejected[toxic == 1].mean() > 0.85 and rejected[toxic == 0].mean() < 0.02
    # Grades follow the expected severity, and more markers never make a text milder.
    order = np.argsort(expected, kind="stable")
    assert (np.diff(np.array([r["severity"] for r in got])[order]) >= -1).all()
    worst = max(got, key=lambda r: r["expected_severity"])["doc_id"]
    text = docs.where(f"doc_id = {worst}").first()["text"]
    more = spark.createDataFrame([(1, "plain words of no harm at all"), (2, text), (3, text + " " + text)], "doc_id bigint, text string")
    e = {r["doc_id"]: r["expected_severity"] for r in toxicity.grade(more, model).collect()}
    assert e[1] < e[2] <= e[3] + 1e-9


def test_run_equals_its_stages_by_brute_force(spark, documents):
    import corpus_pipeline

    encoder = pytest.importorskip("tokenizers").Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{DIR}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.grade(docs, model).collect() if r["rejected"]}
    left = [r for i, r in sorted(documents.items()) if i not in rejected]
    texts = brute_site_lines([(r["source"], r["text"]) for r in left], 0.2)
    rows = [(r["doc_id"], t) for r, (t, _) in zip(left, texts, strict=True)]
    component = brute_components(rows)
    rows = [(i, t) for i, t in rows if component[i][1] == i]
    new = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id bigint, text string"), queries.surrogate_key(spark)).collect()}
    got = collections.defaultdict(list)
    bins = collections.Counter()
    for r in corpus_pipeline.run(spark, DIR).collect():
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]] += r["length"]
    assert set(got) == {i for i, _ in rows} and max(bins.values()) <= 1024
    for i, pieces in got.items():
        ids = encoder.encode(new[i] or "", add_special_tokens=False).ids + [2]
        assert sum(n for _, n, _ in pieces) == len(ids)
        assert all(crc == zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()) for at, n, crc in pieces)
    assert len(bins) <= math.ceil(sum(bins.values()) / 1024) + 2


def test_near_duplicate_stage_on_repeated_rows_and_missing_ids(spark):
    import corpus_pipeline

    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, 1), (5, a, 1), (3, a, 1), (None, a, 1), (None, b, 2), (None, b, 2), (7, c, 3), (7, c, 3), (8, "", 0), (9, None, 0), (None, None, 0), (None, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _own int")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, DIR).collect()), key=str)
    assert got == sorted([(3, a), (None, b), (7, c), (8, ""), (9, None), (None, None), (None, "")], key=str)
