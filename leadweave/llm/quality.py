"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

A token is a run of letters, digits and bytes above 127, or a run of other visible characters. Each
token bucket and each shape (how it is capitalised, digits, other) has a fixed sparse random index
vector. The vector of a token bucket is the sum of the index vectors of its neighbours, two on either
side, over all documents. A document is the mean and the deviation of its tokens' unit vectors, with
the length of the mean (repetition makes it long) and the logarithm of the number of tokens. The
network has one hidden layer; a temperature, fitted on rows that it didn't learn from, calibrates it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.flat import SPACE, Texts, _hash, slices

BUCKETS, DIM, SHAPES = 1 << 12, 32, 8
_CLASS = np.full(256, 2, np.uint8)
_CLASS[SPACE] = 0
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _CLASS[128:256] = 1


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Fixed sparse random vectors (four of DIM entries are +1 or -1) of buckets and of shapes."""
    random = np.random.default_rng(seed)

    def some(n: int) -> np.ndarray:
        out = np.zeros((n, DIM), np.float32)
        for row in out:
            row[random.choice(DIM, 4, replace=False)] = random.choice([-1, 1], 4)
        return out

    return some(BUCKETS), some(SHAPES)


_INDEX, _SHAPE = index_vectors()


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, shape) of every token, in order."""
    data = texts.data
    kind = _CLASS[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[texts.offsets] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = (kind[1:] != kind[:-1]) | cut[1:-1]
    edge = np.flatnonzero(change)
    start, end = edge[:-1], edge[1:]
    visible = kind[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[visible], end[visible]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3
    size = end - start
    bound = np.stack([start, end], axis=1).ravel()
    total = lambda flag: np.diff(np.append(0, np.cumsum(flag))[bound].reshape(-1, 2), axis=1)[:, 0]
    upper, digit = total((data >= 65) & (data <= 90)), total((data >= 48) & (data <= 57))
    other = kind[start] == 2
    shape = np.select([other & (size > 1), other, digit > 0, (upper > 1) & (2 * upper > size), upper == 1], [5, 4, 3, 2, 1], 0)
    row = np.searchsorted(texts.offsets, start, "right") - 1
    return row, (_hash(data, start, end) >> np.uint64(52)).astype(np.int64), shape


def _index(bucket: np.ndarray, shape: np.ndarray) -> np.ndarray:
    return _INDEX[bucket] + 2 * _SHAPE[shape]


def word_vectors(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """BUCKETS x DIM: sums of neighbours' index vectors over all rows, as unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIM))
        for batch in batches:
            for _, _, texts in slices(batch.column(0), 1 << 20):
                row, bucket, shape = tokens(texts)
                if not len(row):
                    continue
                vector = _index(bucket, shape)
                context = np.zeros_like(vector)
                for step in (1, 2):
                    if len(row) > step:
                        same = (row[step:] == row[:-step])[:, None]
                        context[step:] += vector[:-step] * same
                        context[:-step] += vector[step:] * same
                order = np.argsort(bucket, kind="stable")
                at = np.flatnonzero(np.concatenate(([True], np.diff(bucket[order]) > 0)))
                sums[bucket[order][at]] += np.add.reduceat(context[order], at, axis=0)
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used), *(pa.array(sums[used, i]) for i in range(DIM))], names=["bucket", *(f"v{i}" for i in range(DIM))])

    each = df.select(text_col).mapInArrow(run, "bucket bigint, " + ", ".join(f"v{i} double" for i in range(DIM)))
    found = each.groupBy("bucket").agg(*(F.sum(f"v{i}").alias(f"v{i}") for i in range(DIM))).toPandas().sort_values("bucket")  # <= BUCKETS rows
    out = np.zeros((BUCKETS, DIM))
    out[found["bucket"].to_numpy(np.int64)] = found[[f"v{i}" for i in range(DIM)]].to_numpy()
    # Sums are whole numbers, so that their order doesn't matter.
    return (out / np.maximum(1e-9, np.linalg.norm(out, axis=1, keepdims=True))).astype(np.float32)


def pooled(texts: Texts, vectors: np.ndarray) -> np.ndarray:
    """A row of 2 * DIM + 2 numbers per text; zeros for one without tokens."""
    out = np.zeros((len(texts), 2 * DIM + 2))
    row, bucket, shape = tokens(texts)
    if not len(row):
        return out
    vector = (vectors[bucket] + 0.25 * _index(bucket, shape)).astype(np.float64)
    at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
    n = np.diff(np.append(at, len(row)))[:, None]
    mean = np.add.reduceat(vector, at, axis=0) / n
    square = np.add.reduceat(vector**2, at, axis=0) / n
    has = row[at]
    out[has, :DIM] = mean
    out[has, DIM : 2 * DIM] = np.sqrt(np.maximum(0, square - mean**2))
    out[has, -2] = np.linalg.norm(mean, axis=1)
    out[has, -1] = np.log1p(n[:, 0])
    return out


@dataclass
class QualityModel:
    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(z @ self.hidden + self.hidden_bias) @ self.out + self.out_bias

    def scores(self, texts: Texts) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(pooled(texts, self.vectors)) / self.temperature, -40, 40)))


def fit(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, hidden: int = 32, rounds: int = 900, seed: int = 5) -> QualityModel:
    """Network from 4/5 of the rows, temperature from the others."""
    random = np.random.default_rng(seed)
    centre, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if len(x) else (np.zeros(2 * DIM + 2), np.ones(2 * DIM + 2))
    model = QualityModel(vectors, centre, scale, random.normal(0, 0.2, (2 * DIM + 2, hidden)), np.zeros(hidden), random.normal(0, 0.2, hidden), 0.0, 1.0)
    if not len(x) or y.min() == y.max():
        model.out, model.out_bias = np.zeros(hidden), 4.0 if not len(x) or y.max() == 1 else -4.0
        return model
    rest = random.permutation(len(x)) % 5 == 0
    z, t = np.clip((x[~rest] - centre) / scale, -8, 8), y[~rest].astype(float)
    parts = [model.hidden, model.hidden_bias, model.out, np.array([0.0])]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for i in range(1, rounds + 1):
        pick = random.integers(0, len(z), min(len(z), 512))
        zz, tt = z[pick], t[pick]
        h = np.tanh(zz @ parts[0] + parts[1])
        g = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3][0], -40, 40))) - tt) / len(pick)
        gh = np.outer(g, parts[2]) * (1 - h * h)
        grads = [zz.T @ gh + 1e-4 * parts[0], gh.sum(axis=0), h.T @ g + 1e-4 * parts[2], np.array([g.sum()])]
        for p, d, m, v in zip(parts, grads, first, second, strict=True):
            m += 0.1 * (d - m)
            v += 0.001 * (d * d - v)
            p -= 0.01 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    model.out_bias = float(parts[3][0])
    logit, t = model.logits(x[rest]), y[rest].astype(float)
    tries = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / k) - t * logit / k) for k in tries]
    model.temperature = float(tries[int(np.argmin(loss))]) if len(t) else 1.0
    return model


def train(df: DataFrame, labels: DataFrame, sample_rows: int = 12_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Word vectors from all of df; the network from at most `sample_rows` labelled rows that aren't held out, least hash first."""
    vectors = word_vectors(df, text_col)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").where(~F.expr("crc32(cast(id as string)) % 5 = 0")).dropDuplicates(["id"])
    some = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # sample_rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text"), 1 << 20):
                x = [r.tobytes() for r in pooled(texts, vectors)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo).cast(pa.int64()), batch.column("y").slice(lo, hi - lo).cast(pa.int32()), pa.array(x, pa.binary())], names=["id", "y", "x"]
                )

    rows = chosen.mapInArrow(run, "id bigint, y int, x binary").toPandas().sort_values("id", kind="stable")
    x = np.array([np.frombuffer(b) for b in rows["x"]]).reshape(-1, 2 * DIM + 2)
    return fit(vectors, x, rows["y"].to_numpy())


def score(df: DataFrame, model: QualityModel, at: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row of df; only the text is an input of the score.

    A null or empty text is scored as one without tokens; repeated rows come back each; a null id is
    held out; a text has no limit; an empty table gives no rows; other columns are ignored, whatever their
    names. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1), 1 << 20):
                p = model.scores(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(p), pa.array((p >= at).astype(np.int32))], names=[id_col, "held_out", "score", "predicted"]
                )

    source = df.select(id_col, text_col, F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(True)).alias("held_out"))
    return source.mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, held_out boolean, score double, predicted int")
