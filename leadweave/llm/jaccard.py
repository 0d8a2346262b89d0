"""Similarity join on word shingles by Jaccard, size-aware: small sets by subsets, large by inverted lists.

Documents with equal sets are one class. Two sets of at least 80 % Jaccard share so much that the first
elements of both, in any one order of all elements, have elements in common; the rarer come first, so
that elements of passages that many documents share come last. A small set puts out every pair (subset
of size two) of its first elements, and two small sets meet where a pair is equal, which few do by
chance. A large set, and one so small that a single element can be enough, puts out its first elements one by one, and meets what else is in their inverted
lists. The boundary is the size at which both would cost the same; sets just below it are in the lists
too, for partners above it.

Sets are told by a signature, so all equal documents are one node from the start. A key carries its
place in the order of its set: two sets whose first common element is at places i and j have no more
than min(n - i, m - j) elements in common, so most pairs that share only late elements never meet. Then
counts of elements by hash range (about a byte for three elements) give another upper bound; only pairs
that pass it need the sets themselves.

A list isn't expanded into pairs. First each member is compared with the centre of its lists, and what
links is one component. While the members outside the largest component of their lists would meet more
partners than the lists have rows, they are compared with that component's centres. Then they meet all
of other components in their lists. So no link between different components is lost, and a group of n near
copies costs about n comparisons.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.flat import _ODD, mix, shingle_sets, slices
from leadweave.llm.tables import written
from leadweave.operators.components import connected_components

#: Counters of shingles by hash, whatever the input; tasks get a byte of each. Counted in chunks.
CELLS, CHUNK = 1 << 22, 1 << 16
#: Ids up to which the documents to compare are found by a broadcast.
BROADCAST_ROWS = 2_000_000
#: No further round of centres is made for so many pairs a row of the lists, or when so small a share of the last one's pairs linked.
PAIRS_A_ROW, LEAST_LINKED = 2, 0.1
#: Times as many pairs, at most, as the bound of those that are counted.
COUNTED = 50


def least_overlap(n: int, percent: int) -> int:
    """Elements that a set of n has in common with any partner, at least."""
    return -(-percent * n // 100)


def _signature(items: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(items.sum().view(np.int64)), int(mix(items * _ODD[60]).sum().view(np.int64))


def sketch(items: np.ndarray) -> bytes:
    """Elements in each of 2^k equal ranges of hashes, two to four a range on average; 255 stands for any more."""
    bits = max(3, len(items).bit_length() - 2)
    return np.minimum(np.bincount((items >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes, n: int, m: int) -> int:
    """No fewer elements than sets of n and m with these sketches can have in common."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if (x == 255).any() or (y == 255).any():
        return min(n, m)
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(size, -1).sum(axis=1), y.reshape(size, -1).sum(axis=1)).sum())


def _cell(items: np.ndarray) -> np.ndarray:
    return (items >> np.uint64(20)) & np.uint64(CELLS - 1)


def _survey(df: DataFrame, width: int) -> DataFrame:
    """A row per document: doc, n, one, two (its set's 128 bits), sketch; and per task its counts of shingles by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int32)
        names = ["doc", "n", "one", "two", "sketch", "part", "chunk", "counts"]
        seen: set = set()
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                n, one, two, sketches, fresh = [], [], [], [], []
                for items in shingle_sets(texts, width):
                    a, b = _signature(items)
                    n.append(len(items))
                    one.append(a)
                    two.append(b)
                    sketches.append(sketch(items))
                    if len(items) and (a, b) not in seen:
                        if len(seen) < 1_000_000:
                            seen.add((a, b))
                        fresh.append(items)
                if fresh:
                    cell, times = np.unique(_cell(np.concatenate(fresh)), return_counts=True)
                    counts[cell] += times.astype(np.int32)
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, one, two)), pa.array(sketches, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())],
                    names=names,
                )
        part = TaskContext.get().partitionId()
        parts = [zlib.compress(c.tobytes(), 1) for c in counts.reshape(-1, CHUNK)]
        k = len(parts)
        yield pa.RecordBatch.from_arrays(
            [*(pa.nulls(k, pa.int64()) for _ in range(4)), pa.nulls(k, pa.binary()), pa.array([part] * k, pa.int32()), pa.array(range(k), pa.int32()), pa.array(parts, pa.binary())], names=names
        )

    return df.mapInArrow(run, "doc bigint, n bigint, one bigint, two bigint, sketch binary, part int, chunk int, counts binary")


def _added(group: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(CHUNK, np.int64)
    for blob in group["counts"]:
        total += np.frombuffer(zlib.decompress(blob), np.int32)
    total = np.minimum(total, np.iinfo(np.int32).max).astype(np.int32)
    return pd.DataFrame({"part": [0], "chunk": group["chunk"].iloc[:1].to_numpy(), "counts": [zlib.compress(total.tobytes(), 1)]})


def levels(counts: np.ndarray) -> tuple[np.ndarray, float]:
    """(level of each cell, mean length of a list of level 0).

    A cell is the sum of many rare shingles; what it holds beyond their mean and four deviations is a
    frequent one, of the level of its binary logarithm. What the cells of level 0 vary beyond chance
    tells how often a shingle there repeats.
    """
    mean = float(np.median(counts))
    level = np.zeros(len(counts), np.uint8)
    often = np.flatnonzero(counts > mean + 4 * np.sqrt(mean) + 8)
    level[often] = 1 + np.floor(np.log2(np.maximum(counts[often] - mean, 1)))
    light = counts[level == 0]
    length = 1.0 if not light.any() else max(1.0, float(light.var(dtype=float) / light.mean(dtype=float)))
    return level, length


def _node(sign: tuple[int, int], clash: frozenset[int]) -> int:
    """What a set is called: the first 64 bits of its signature, the others if another set has the same first ones."""
    return sign[sign[0] in clash]


def _keys(df: DataFrame, width: int, percent: int, boundary: int, cells: np.ndarray, clash: frozenset[int]) -> DataFrame:
    """(key, node, n, pos) of every set: subsets of two if n <= boundary, else first elements one by one, as do sets that can link by one.

    n - pos elements of the set, at most, are in common with a partner whose first common key this is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                keys, nodes, sizes, places = [], [], [], []
                for items in shingle_sets(texts, width):
                    n = len(items)
                    alone = percent * max(n, 2) <= 100  # one element in common can be enough
                    if (n < 2 and not alone) or not n or (sign := _signature(items)) in seen:
                        continue  # above 50 % one shingle has no partner but its equals; of equal sets one of a task stands for all
                    if len(seen) < 1_000_000:
                        seen.add(sign)
                    ordered = items[np.lexsort((items, cells[_cell(items)]))]
                    p = n - least_overlap(n, percent)
                    mine, at = [], []
                    if n <= boundary:
                        q = ordered[: p + 2]
                        i, j = np.triu_indices(len(q), 1)
                        mine.append(mix(q[i] * _ODD[61] + mix(q[j] * _ODD[62])))
                        at.append(j - 1)
                    if alone or 100 * n > percent * boundary:
                        mine.append(ordered[: p + 1])
                        at.append(np.arange(len(mine[-1])))
                    keys += mine
                    places += at
                    k = sum(map(len, mine))
                    nodes.append(np.full(k, _node(sign, clash), np.int64))
                    sizes.append(np.full(k, n, np.int32))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(x)) for x in (nodes, sizes)), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "node", "n", "pos"]
                    )

    return df.select("text").mapInArrow(run, "key bigint, node bigint, n int, pos int")


def _sets(df: DataFrame, width: int, clash: frozenset[int]) -> DataFrame:
    """(node, items) of every row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, texts in slices(batch.column(0)):
                found = shingle_sets(texts, width)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                values = pa.array(np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([_node(_signature(x), clash) for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["node", "items"])

    return df.select("text").mapInArrow(run, "node bigint, items array<bigint>")


def _may_link(pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of those with sizes n, m and sketches s, t that can have enough in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("s", "t", "n", "m")]
            keep = [100 * (k := most_common(s, t, n, m)) >= percent * (n + m - k) for s, t, n, m in zip(*columns, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.mapInArrow(run, "a bigint, b bigint")


def choose_boundary(sizes: list[tuple[int, int]], list_length: float, percent: int) -> int:
    """The size up to which subsets of two cost no more than inverted lists of this mean length.

    sizes: (size, sets). A subset costs one row. A first element costs a row and the comparison with
    half its list. Costs are added up over all sets, and the size with the smallest sum is taken.
    """
    best, at, cost = None, 1, 0.0
    for n, k in sorted(sizes):
        p = n - least_overlap(n, percent)
        cost += k * ((p + 2) * (p + 1) / 2 - (p + 1) * (1 + list_length / 2))
        if best is None or cost <= best:
            best, at = cost, n
        if cost > 0 and n > 1000:
            break
    return at


def shingle_components(df: DataFrame, width: int = 5, percent: int = 80, boundary: int | None = None, rounds: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row of df, ids being long; percent is from 1 to 100.

    Two documents link if 100 * intersection >= percent * union of their sets of word shingles (A-Z
    lowered; fewer words than `width` are one shingle). component_id is the smallest id reachable. A
    text that is null, empty or without words has n_shingles 0 and links with nothing; a null id links
    with nothing and has a null component_id. Repeated rows come back each, with equal results; rows
    of one id but different texts count as one document that has the links of all. Texts have no
    greatest length, other columns are ignored, whatever their names, and an empty table gives no rows.
    No pair is left out for the size of a list or a group; `rounds` bounds only how often members are
    compared with centres before the rest meets.
    """
    if not 1 <= percent <= 100:
        raise ValueError("percent has to be from 1 to 100")
    source = df.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    survey = written(_survey(source, width), "survey")
    sets = survey.where("chunk is null").select("doc", "n", "one", "two", "sketch")
    signs = sets.where("n > 0").groupBy("one").agg(F.min("two").alias("low"), F.max("two").alias("high")).where("low <> high")
    clash = frozenset(r["one"] for r in signs.select("one").collect())  # of k sets, k^2 / 2^65 are expected: 3 of 10^10
    sets = sets.select("doc", "n", F.when(F.col("one").isin(*clash), F.col("two")).otherwise(F.col("one")).alias("node"), "sketch")
    live = sets.where("n > 0 and doc is not null")
    classes = written(live.groupBy("node", "n").agg(F.min("doc").alias("rep"), F.first("sketch").alias("sketch")), "classes")
    # Rows of one id are one document.
    edges = live.groupBy("doc").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    edges = live.select("doc", "node").join(edges.select("doc", "a"), "doc").where("node <> a").select("a", F.col("node").alias("b"))

    # Added up in two steps, so that no group holds the counts of all tasks; CELLS numbers reach the driver.
    tasks = survey.where("chunk is not null").select("part", "chunk", "counts").withColumn("share", F.pmod("part", F.lit(256)))
    some = tasks.groupBy("chunk", "share").applyInPandas(_added, "part int, chunk int, counts binary")
    total = some.groupBy("chunk").applyInPandas(_added, "part int, chunk int, counts binary").toPandas().sort_values("chunk")
    counts = np.concatenate([np.frombuffer(zlib.decompress(c), np.int32) for c in total["counts"]] or [np.zeros(CELLS, np.int32)])
    cells, length = levels(counts)
    if boundary is None:
        sizes = [(r["n"], r["count"]) for r in classes.where("n <= 200").groupBy("n").count().collect()]  # a subset never pays beyond
        boundary = choose_boundary(sizes, length, percent)

    by_key = Window.partitionBy("key")
    met = (
        _keys(source.where("doc is not null"), width, percent, boundary, cells, clash)
        .withColumns({"low": F.min("node").over(by_key), "high": F.max("node").over(by_key)}).where("low <> high").dropDuplicates(["key", "node"])
    )
    # Sets of n and m that have n - i and m - j elements from their first common key on can link only if
    # (100 + percent) * least(n - i, m - j) >= percent * (n + m), that is if each one's `far` is no less than the other's `near`.
    near, far = percent * F.col("n"), 100 * F.col("n") - (100 + percent) * F.col("pos")
    # A row stays if others of its list are near enough and reach far enough; in a list of two that is the test of the pair.
    by_near, by_far = (Window.partitionBy("key").orderBy(x).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing) for x in ("near", F.desc("far")))
    other = lambda x, w, at: F.when(F.col(at) == 1, F.nth_value(x, 2).over(w)).otherwise(F.first(x).over(w))
    placed = met.withColumns({"near": near, "far": far}).withColumns({"nth": F.row_number().over(Window.partitionBy("key").orderBy("near")), "mth": F.row_number().over(Window.partitionBy("key").orderBy(F.desc("far")))})
    met = placed.withColumns({"nearest": other("near", by_near, "nth"), "farthest": other("far", by_far, "mth")}).where("nearest <= far and farthest >= near")
    # An original is in nearly all lists that its prefix opens; a copy with changes has shingles of its own.
    known = F.count("*").over(Window.partitionBy("node")) / F.col("n")
    lists = written(met.select("key", "node", "near", "far", known.alias("known")), "lists")
    may = (F.col("near") <= F.col("f")) & (F.col("e") <= F.col("far"))

    def linked(pairs: DataFrame, name: str) -> tuple[DataFrame, float]:
        """The pairs (a, b) that link, and their share."""
        pairs = written(pairs, name)
        nodes = written(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct(), name)
        few = nodes.count() <= BROADCAST_ROWS
        one = classes.join(F.broadcast(nodes) if few else nodes, "node", "left_semi").select("node", "n", "sketch")
        likely = written(_may_link(pairs.join(one.toDF("a", "n", "s"), "a").join(one.toDF("b", "m", "t"), "b"), percent), name)
        nodes = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        reps = written(classes.join(nodes, "node", "left_semi").select(F.col("rep").alias("doc")).distinct(), name)
        if reps.count() <= BROADCAST_ROWS:
            reps = F.broadcast(reps)
        items = written(_sets(source.join(reps, "doc", "left_semi"), width, clash), name).dropDuplicates(["node"])
        both = F.size(F.array_intersect("x", "y"))
        links = written(likely.join(items.toDF("a", "x"), "a").join(items.toDF("b", "y"), "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), name)
        return links, links.count() / max(1, likely.count())

    def towards(rows: DataFrame) -> DataFrame:
        """Each node of rows with the most frequent `other` that its lists give."""
        met = rows.where((F.col("node") != F.col("other")) & may).groupBy("node", "other").agg(F.count("*").alias("k"))
        best = met.groupBy("node").agg(F.max_by("other", F.struct("k", "other")).alias("other"))
        return best.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")).distinct()

    centre = F.max_by(F.struct(F.col("node").alias("other"), F.col("near").alias("e"), F.col("far").alias("f")), F.struct("known", "node")).alias("centre")
    found, share = linked(towards(lists.join(lists.groupBy("key").agg(centre), "key").select("node", "near", "far", "centre.*")), "near")
    members = connected_components(edges.unionByName(found))
    for step in range(rounds + 1):
        now = members.select(F.col("id").alias("node"), F.col("component").alias("c"))
        apart = lists = written(
            lists.select("key", "node", "near", "far", "known").join(now, "node", "left").withColumn("c", F.coalesce("c", "node"))
            .withColumns({"lc": F.min("c").over(by_key), "hc": F.max("c").over(by_key)}).where("lc <> hc").select("key", "node", "near", "far", "known", "c"), "apart"
        )
        parts = apart.groupBy("key", "c").agg(F.count("*").alias("k"), centre)
        main = parts.groupBy("key").agg(F.sum("k").alias("all"), F.max_by(F.struct("c", "k", "centre"), F.struct("k", "c")).alias("m")).select("key", "all", F.col("m.c").alias("main"), F.col("m.k").alias("k"), "m.centre.*")
        main = written(main, "main")
        todo, rows = main.agg(F.sum(F.expr("(all - k) * all")), F.sum("all")).first()
        minor = apart.join(main, "key").where("c <> main")
        # Members outside the largest component of a list against all of other components.
        outside = minor.select("key", F.col("node").alias("b"), F.col("near").alias("e"), F.col("far").alias("f"), F.col("c").alias("d"))
        across = apart.withColumnRenamed("node", "a").join(outside, "key").where((F.col("c") != F.col("d")) & may).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        most = PAIRS_A_ROW * (rows or 0)
        last = step == rounds or share < LEAST_LINKED or (todo or 0) <= most
        # Written and counted only where the bound of their number isn't out of proportion.
        if last or todo <= COUNTED * most:
            across = written(across, "across")
            if last or across.count() <= most:
                break
        found, share = linked(towards(minor.select("node", "near", "far", "other", "e", "f")), "near")
        members = connected_components(members.toDF("a", "b").unionByName(found))
    members = connected_components(members.toDF("a", "b").unionByName(linked(across, "across")[0]))
    # The smallest id of each class is known; that of a component is the smallest of its classes.
    of = classes.select("node", "rep").join(members.select(F.col("id").alias("node"), F.col("component").alias("c")), "node", "left").withColumn("c", F.coalesce("c", "node"))
    of = written(of, "classes")
    least = of.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = of.join(least, "c").select("node", "component_id")
    out = sets.withColumn("node", F.when(F.col("n") > 0, F.col("node"))).join(named, "node", "left")
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component_id", "doc")).alias("component_id"))
