"""Vector code compression: product codes whose nearest entries are found by equal-average search.

Vectors become integers and are cut into equal parts, each with a codebook of its own. By the inequality
of Cauchy and Schwarz, the squared difference of two component sums is at most the dimension times the
squared distance. So the entries of a codebook are sorted by their component sums, and a part's search
starts at its own sum and goes outward; it ends when the squared gap, over the dimension, strictly
exceeds the best distance. Nothing nearer is left out then, and no entry as near of a lower index.

Training is by rounds over all vectors: each task adds up its parts by (part, entry), Spark adds up the
tasks, and only the codebooks (parts x entries x components of numbers) reach the driver and go to the
tasks. All arithmetic is on integers, so any order of rows gives the same codes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave.llm.tables import fresh, written

#: Rows of the table of label totals up to which it is broadcast (below 50 bytes each).
BROADCAST_ROWS = 200_000
#: Greatest size of an integer component; sums of so many rows fit decimal(38,0) up to 10^9 of them.
LARGEST = 10**28
_LONG = 1 << 63


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x): 64-bit where all squares and their sums fit in that, else Python's integers, no greater than LARGEST."""
    with np.errstate(over="ignore"):
        v = np.floor(vectors.astype(np.float64) * scale)
    if np.abs(v).max(initial=0) < (1 << 30) / max(1, vectors.shape[1]):
        return v.astype(np.int64)
    out = [max(-LARGEST, min(LARGEST, int(x))) if abs(x) < np.inf else (LARGEST if x > 0 else -LARGEST) for x in v.ravel().tolist()]
    return np.array(out, object).reshape(v.shape)


def equal_average(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry of each point, squared distance); ties go to the lower index."""
    width, count = entries.shape[1], len(entries)
    exact = points.dtype == object or entries.dtype == object
    if exact:
        points, entries = points.astype(object), entries.astype(object)
    far = 10**200 if exact else 1 << 62
    totals = entries.sum(axis=1)
    order = np.argsort(totals, kind="stable")
    totals, entries = totals[order], entries[order]
    mine = points.sum(axis=1)
    right = np.searchsorted(totals, mine)
    left = right - 1
    best, who = np.full(len(points), far // width, points.dtype), np.full(len(points), count)
    live = np.arange(len(points))
    while len(live):
        lo, hi = left[live], right[live]
        below = np.where(lo >= 0, mine[live] - totals[np.maximum(lo, 0)], far)
        above = np.where(hi < count, totals[np.minimum(hi, count - 1)] - mine[live], far)
        gap = np.minimum(below, above)
        inside = (gap < far).astype(bool)
        gap[~inside] = 0
        inside &= (gap * gap <= width * best[live]).astype(bool)
        live, at = live[inside], np.where(below <= above, lo, hi)[inside]
        down = (below <= above)[inside].astype(bool)
        left[live[down]] -= 1
        right[live[~down]] += 1
        d = points[live] - entries[at]
        d, index = (d * d).sum(axis=1), order[at]
        nearer = ((d < best[live]) | ((d == best[live]) & (index < who[live]))).astype(bool)
        best[live[nearer]], who[live[nearer]] = d[nearer], index[nearer]
    return who, best


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of each part, squared distance of each part) of integer vectors, rows x parts."""
    cut = parted(vectors, *books.shape[::2])
    found = [equal_average(cut[:, p], books[p]) for p in range(len(books))]
    return np.stack([x[0] for x in found], axis=1), np.stack([x[1] for x in found], axis=1)


def parted(vectors: np.ndarray, parts: int, width: int) -> np.ndarray:
    """Rows x parts x width; components that are missing at the end of the last parts are zeros."""
    out = np.zeros((len(vectors), parts * width), vectors.dtype)
    out[:, : vectors.shape[1]] = vectors
    return out.reshape(len(vectors), parts, width)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components, by part, entry and place."""
    return hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()


def usable(df: DataFrame, vector_col: str) -> Column:
    """Of a row: its vector has components and all are there and finite."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _sums(vectors: DataFrame, books: np.ndarray, length: int, scale: float) -> DataFrame:
    """(part, entry, n, s0, s1, ...) of all parts that are nearest to the entry, added up over the tasks."""
    parts, count, width = books.shape
    names = [f"s{j}" for j in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros((parts, count), np.int64), np.zeros((parts, count, width), object)
        for batch in batches:
            v = integers(_matrix(batch.column(0), length), scale)
            codes, cut = assign(v, books)[0], parted(v, parts, width)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=count)
                some = np.zeros((count, width), v.dtype)
                np.add.at(some, codes[:, p], cut[:, p])
                total[p] += some
        p, e = np.nonzero(n)
        sums = [pa.array([Decimal(int(x)) for x in total[p, e, j]], pa.decimal128(38, 0)) for j in range(width)]
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), *sums], names=["part", "entry", "n", *names])

    added = vectors.select("v").mapInArrow(run, "part int, entry int, n bigint, " + ", ".join(f"{s} decimal(38,0)" for s in names))
    return added.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(s).alias(s) for s in names))


def train(df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[np.ndarray, int] | None:
    """(codebooks: parts x entries x components, length of the vectors); None where no vector is usable.

    A codebook starts as that part of the `entries` rows with the smallest ids, ascending (rows of one id
    by their vectors; null ids last), of all if there are fewer. Each round assigns every part and
    replaces an entry by the floor of its parts' mean; an entry that no part is nearest to stays. The
    length is the one that most usable vectors have, the greater of two as frequent.
    """
    v = F.col(f"`{vector_col}`").cast("array<double>").alias("v")
    vectors = df.where(usable(df, vector_col)).select(F.col(f"`{id_col}`").alias("id"), v)
    size = vectors.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if size is None:
        return None
    length, vectors = size["n"], vectors.where(F.size("v") == size["n"])
    first = vectors.orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()  # `entries` rows
    width = -(-length // parts)
    books = parted(integers(np.array([r["v"] for r in first]), scale), parts, width).transpose(1, 0, 2)
    for _ in range(rounds):
        new = [[tuple(map(int, e)) for e in p] for p in books]
        for r in _sums(vectors, books, length, scale).collect():  # parts x entries rows
            new[r["part"]][r["entry"]] = tuple(int(r[f"s{j}"]) // r["n"] for j in range(width))
        most = max(abs(x) for p in new for e in p for x in e)
        books = np.array(new, np.int64 if most < (1 << 30) / length else object).reshape(parts, -1, width)
    return books, length


def compress(
    df: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label",
) -> DataFrame:
    """(id, label, code, error, label_error, codebooks_sha256): the product code of every usable vector.

    code holds the index of each part's entry in hexadecimal, two digits each (more where `entries` is
    over 256); error is the sum of squared distances of the vector's integers to its entries; label_error
    adds it up over equal labels, nulls together (without label_col, over all); both are null beyond a long. Vectors that are null, empty, or hold a null or non-finite component, and vectors of another length
    than most, are left out; zero vectors are not. A length that `parts` doesn't divide is filled up with
    zeros. Components are taken as no greater than LARGEST. Repeated rows come back each; of equal
    distances the lower index counts; an empty table gives no rows; other columns are ignored, whatever
    their names. df is read once a round and once for the codes, its vector column only.
    """
    spark = df.sparkSession
    kind = df.schema[label_col].dataType.simpleString() if label_col else "int"
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `label` {kind}, code string, error bigint"
    model = train(df, parts, entries, rounds, scale, id_col, vector_col)
    if model is None:
        return spark.createDataFrame([], f"{schema}, label_error bigint, codebooks_sha256 string")
    books, length = model
    digits = max(2, len(f"{books.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, distance = assign(integers(_matrix(batch.column(2), length), scale), books)
            error = [int(x) for x in distance.sum(axis=1)]
            text = ["".join(f"{c:0{digits}x}" for c in row) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array([x if x < _LONG else None for x in error], pa.int64())], names=[id_col, "label", "code", "error"])

    v = F.col(f"`{vector_col}`").cast("array<double>")
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    kept = df.where(usable(df, vector_col) & (F.size(v) == length)).select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), v.alias("v"))
    coded = written(kept.mapInArrow(run, schema), "codes")
    same = fresh(coded, "same")
    totals = written(coded.groupBy(F.col("label").alias(same)).agg(F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")).try_cast("bigint")).alias("label_error")), "labels")
    few = F.broadcast(totals) if totals.count() <= BROADCAST_ROWS else totals
    out = coded.join(few, F.col("label").eqNullSafe(F.col(same))).drop(same)
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))
