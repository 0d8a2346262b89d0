"""Vector codes, substring dedup and the filter audit against brute force, on odd rows and tables."""

import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from leadweave.llm import filteraudit, substrings, vectorcodes

WORD = re.compile("[^\x20\x09-\x0d]+")
SPACES = [" ", "  ", "\n", "\t", " \x0b\r"]


# Vector codes


def brute_codes(rows, parts, entries, rounds, scale):
    """{id: (code, error)} and the codebooks, by comparing every part with every entry."""
    ints = [(i, [math.floor(scale * x) for x in v]) for i, v in rows]
    width = len(ints[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(ints)[:entries]
    books = [[cut(v, p) for _, v in first] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v, p: min(range(len(books[p])), key=lambda e: (far(cut(v, p), books[p][e]), e))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in ints:
            for p in range(parts):
                of[p, nearest(v, p)].append(cut(v, p))
        for (p, e), mine in of.items():
            books[p] = [[sum(c) // len(mine) for c in zip(*mine, strict=True)] if k == e else b for k, b in enumerate(books[p])]
    codes = {i: ("".join(f"{nearest(v, p):02x}" for p in range(parts)), sum(far(cut(v, p), books[p][nearest(v, p)]) for p in range(parts))) for i, v in ints}
    return codes, [b for p in books for b in p]


@pytest.mark.parametrize("spread", ["even", "ties", "large"])
def test_codes_equal_brute_force(spark, spread):
    r = np.random.default_rng(5)
    draw = {"even": lambda: r.normal(0, 0.3, 8), "ties": lambda: r.integers(-2, 3, 8) / 256 + 1 / 1024, "large": lambda: r.normal(0, 0.3, 8) * 10.0 ** r.integers(0, 12)}[spread]
    rows = [(int(i), [float(x) for x in draw()], int(i) % 3 or None) for i in r.permutation(90)]
    got = {x["vec_id"]: x for x in vectorcodes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int"), 4, 16, 2).collect()}
    codes, books = brute_codes([(i, v) for i, v, _ in rows], 4, 16, 2, 256)
    fits = {i: (c, e if e < 1 << 63 else None) for i, (c, e) in codes.items()}
    assert {i: (x["code"], x["error"]) for i, x in got.items()} == fits
    assert {x["codebooks_sha256"] for x in got.values()} == {hashlib.sha256(",".join(str(c) for b in books for c in b).encode()).hexdigest()}
    if spread != "large":
        total = collections.Counter()
        for i, _, label in rows:
            total[label] += fits[i][1]
        assert all(got[i]["label_error"] == total[label] for i, _, label in rows)


def test_codes_of_odd_rows(spark):
    bad = [(1, None), (2, []), (3, [1.0, None]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1.0, 2.0, 3.0])]
    good = [(10, [0.0, 0.0]), (10, [0.5, 0.5]), (None, [1.0, 1.0]), (11, [1.0, 1.0]), (11, [1.0, 1.0])]
    schema = "vec_id bigint, embedding array<float>, label string, code int, same int, id int"
    df = spark.createDataFrame([(i, v, None, 0, 0, 0) for i, v in bad + good], schema)
    got = vectorcodes.compress(df, parts=4, entries=3).collect()  # two components for four parts: the rest is zeros
    assert sorted((x["vec_id"] or 0, x["error"], x["label_error"]) for x in got) == [(0, 0, 0), (10, 0, 0), (10, 0, 0), (11, 0, 0), (11, 0, 0)]
    none = vectorcodes.compress(df.where("vec_id < 7"), label_col=None)
    assert none.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
    assert vectorcodes.compress(df.where("vec_id < 6")).count() == 0 and vectorcodes.compress(df.limit(0)).count() == 0


def test_equal_average_search_stops_and_is_exact():
    r = np.random.default_rng(2)
    entries = r.integers(-50, 50, (64, 4))
    entries[7] = entries[3]
    points = np.concatenate([r.integers(-60, 60, (500, 4)), entries])
    d = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    who, best = vectorcodes.equal_average(points, entries)
    assert (who == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()


# Substring dedup


def brute_left(texts, width):
    """(words, removed, words that stay) of every text."""
    split = [WORD.findall(t or "") for t in texts]
    seen = collections.Counter(tuple(w[i : i + width]) for w in split for i in range(len(w) - width + 1))
    out = []
    for w in split:
        gone = {j for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def shared_texts(seed, width, docs):
    """Texts of own words with passages about as long as a window, copies with changes, and loops."""
    r = np.random.default_rng(seed)
    own = itertools.count()
    passages = [[f"p{k}w{i}" for i in range(n)] for k, n in enumerate([width - 1, width, width + 1, 2 * width, 3 * width + 5, 6 * width])]
    texts = []
    for _ in range(docs):
        words = []
        for _ in range(r.integers(0, 6)):
            kind = r.integers(0, 6)
            if kind == 0:
                words += [f"u{next(own)}" for _ in range(r.integers(0, 3 * width))]
            elif kind == 1:
                words += passages[r.integers(len(passages))]
            elif kind == 2:
                p = passages[r.integers(len(passages))]
                a, b = sorted(r.integers(0, len(p) + 1, 2))
                words += p[a:b]
            elif kind == 3:
                words += ["x", "y"][: r.integers(1, 3)] * int(r.integers(0, 2 * width))
            elif texts:
                words += WORD.findall(texts[r.integers(len(texts))])[: 20 * width]
                if words and kind == 5:
                    words[r.integers(len(words))] = f"u{next(own)}"
        texts.append("".join(w + SPACES[r.integers(len(SPACES))] for w in words))
    return texts


@pytest.mark.parametrize(("width", "seed"), [(35, 1), (35, 2), (8, 3), (5, 4), (2, 5)])
def test_substrings_equal_brute_force(spark, width, seed):
    texts = shared_texts(seed, width, 60)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substrings.drop_repeated(df, width).collect()}
    assert got == dict(enumerate(brute_left(texts, width)))


def test_substrings_of_odd_rows(spark):
    a = " ".join(f"a{i}" for i in range(40))
    rows = [(1, a), (1, a), (2, None), (2, ""), (None, a + " tail"), (3, " \n\t"), (None, " ".join(["w"] * 50_000)), (4, a.upper()), (5, "é " * 34), (6, "first"), (6, "second")]
    df = spark.createDataFrame([(i, t, 7, "x", "y") for i, t in rows], "doc_id bigint, text string, own int, masks string, twin string")
    made = substrings.drop_repeated(df)
    assert made.columns == [*df.columns, "n_words", "n_removed", "kept"]
    got = sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"], r["kept"]) for r in made.collect()), key=str)
    assert got == sorted([(i, t, *left) for (i, t), left in zip(rows, brute_left([t for _, t in rows], 35), strict=True)], key=str)
    assert substrings.drop_repeated(df.limit(0)).count() == 0


def test_substrings_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_ROWS", 0)
    texts = shared_texts(9, 6, 40)
    got = {r["doc_id"]: r["kept"] for r in substrings.drop_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), 6).collect()}
    assert got == {i: left for i, (_, _, left) in enumerate(brute_left(texts, 6))}


def test_factors_do_not_depend_on_how_many_rows_are_held(spark, monkeypatch):
    monkeypatch.setattr(substrings, "ROWS", 3)
    texts = shared_texts(11, 35, 40)
    got = {r["doc_id"]: r["kept"] for r in substrings.drop_repeated(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == {i: left for i, (_, _, left) in enumerate(brute_left(texts, 35))}


# Filter audit


def brute_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    cases = []
    for i, t, part in rows:
        t = t or ""
        w = WORD.findall(t)
        f = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        cases.append((part or "", {k for k, v in f.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for step, mine in enumerate(order):
            for part in {c[0] for c in cases}:
                here, before = [c for c in cases if c[0] == part], set(order[:step])
                gone = [c for c in here if mine in c[1] and not c[1] & before]
                shapley[part, mine] += len(gone)
                out[part, "".join(order), step + 1] = [
                    sum(not c[1] & (before | {mine}) for c in here), len(gone), sum(mine in c[1] and bool(c[1] & before) for c in here), sum(c[1] == {mine} for c in here), sum(c[2] for c in gone), sum(c[3] for c in gone)
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


AUDIT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_audit_equals_brute_force(spark):
    r = np.random.default_rng(4)
    pool = ["one", "Two", "THREE", "é", "日本", "$5", "a|b", "x"]
    texts = [" ".join(r.choice(pool[: r.integers(1, 9)], r.integers(0, 90))) for _ in range(60)] + [" ".join(f"w{i}" for i in range(n)) for n in (49, 50, 51, 4000)] + ["", " \n", "A" * 5 + "b" * 95, "A" * 6 + "b" * 95]
    rows = [(int(i), str(t), f"s{i % 3}") for i, t in enumerate(r.choice(texts, 150))] + [(3, "again", "s0"), (3, "again", "s0"), (None, "again", "s1"), (900, None, None), (901, "", None), (None, None, "s1")]
    labels = [(i, int(i) % 2 if i % 5 else None, int(i) % 7 == 0 or None) for i in range(0, 150, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    labels = [(i, q, None if t is None else int(t)) for i, q, t in labels]
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], "doc_id bigint, text string, source string, failed int, part int")
    got = filteraudit.audit(docs, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert got.columns == ["part", "filter_order", "step", *AUDIT]
    assert {(x["part"], x["filter_order"], x["step"]): tuple(x[c] for c in AUDIT) for x in got.collect()} == brute_audit(rows, labels)
    assert filteraudit.audit(docs.limit(0), spark.createDataFrame([], "doc_id bigint, quality int, toxic int")).count() == 0


@pytest.mark.parametrize("bits", [64, 6])
def test_shards_count_words_even_if_codes_are_shared(spark, bits):
    texts = [" ".join(f"w{i * k % 97}" for i in range(k)) for k in range(0, 120, 7)] + [None, ""]
    rows = list(enumerate(texts))
    found = filteraudit.term_shards(spark.createDataFrame(rows, "doc_id bigint, text string"), bits=bits).collect()
    got, columns = {}, collections.defaultdict(set)
    for s in found:
        for i, doc in enumerate(s["ids"]):
            a, b = s["indptr"][i], s["indptr"][i + 1]
            got[doc] = sorted(s["counts"][a:b])
            columns[doc] = dict(zip(s["codes"][a:b], s["counts"][a:b], strict=True))
    assert got == {i: sorted(collections.Counter((t or "").split()).values()) for i, t in rows}
    # A word has one column in all shards, and no other word has it.
    total = collections.Counter()
    for entries in columns.values():
        total.update(entries)
    assert sorted(total.values()) == sorted(collections.Counter(w for t in texts for w in (t or "").split()).values())


def test_shares_of_a_case_add_up():
    table = filteraudit.effects()
    assert len(table) == 120 * 5 * 32
    removed = collections.Counter()
    for case, order, step, _, removes, _, _, share in table:
        removed[case, order[step - 1]] += removes
        assert share == 0 or case >> "ABCDE".index(order[step - 1]) & 1
    assert all(removed[case, order[step - 1]] == share for case, order, step, *_, share in table)


def test_dictionary_sees_every_word_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "HELD", 10)
    df = spark.createDataFrame([(" ".join(f"w{i}" for i in range(j, j + 30)),) for j in range(0, 300, 20)], "text string")
    assert filteraudit.shared_codes(df) == frozenset()
    words = {f"w{i}" for i in range(310)}
    assert len(words) == filteraudit._dictionary(df.select(F.col("text")), 64).count()
