"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features of a text are hashed words (runs of letters, digits and bytes above 127, A-Z lowered), each
with 1 + log(occurrences). The model has one weight per feature, shared by all thresholds, and ordered
thresholds: P(grade >= k) = sigmoid(w x - t_k). Labels only say toxic or not, so training grades are
made from them: 0 for clean, and for toxic texts 1 to 3 by thirds of the amount of toxic markers,
which are features far commoner in toxic texts of the sample. The expected severity is the sum of
P(grade >= k).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.flat import LOWER, Texts, _hash, slices

BUCKETS = 1 << 20
GRADES = 3
_LETTER = np.zeros(256, bool)
_LETTER[48:58] = _LETTER[97:123] = _LETTER[128:] = True


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence, rows in order."""
    data = LOWER[texts.data]
    inside = _LETTER[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[texts.offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    stops[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return np.searchsorted(texts.offsets, start, "right") - 1, (_hash(data, start, end) >> np.uint64(44)).astype(np.int32)


@dataclass
class OrdinalModel:
    """Weights of the buckets that have one, and ordered thresholds."""

    place: np.ndarray  # of a bucket among the weights, -1 without
    weights: np.ndarray
    thresholds: np.ndarray

    def margins(self, texts: Texts) -> np.ndarray:
        row, bucket = features(texts)
        at = self.place[bucket]
        has = at >= 0
        pair, times = np.unique(row[has].astype(np.int64) * len(self.weights) + at[has], return_counts=True)
        value = (1 + np.log(times)) * self.weights[pair % len(self.weights)]
        return np.bincount(pair // len(self.weights), value, len(texts))

    def at_least(self, margins: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ...: a column each."""
        return 1 / (1 + np.exp(-np.clip(margins[:, None] - self.thresholds[None, :], -60, 60)))


def pairs(document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a document, ascending, and how often each occurs."""
    bucket, times = np.unique(document, return_counts=True)
    return bucket.astype(np.int32), times.astype(np.int32)


def _documents_with(docs: list[tuple[np.ndarray, np.ndarray]], step: int = 500) -> np.ndarray:
    """Of each bucket; a few documents at a time."""
    out = np.zeros(BUCKETS, np.int32)
    for at in range(0, len(docs), step):
        found, n = np.unique(np.concatenate([b for b, _ in docs[at : at + step]]), return_counts=True)
        out[found] += n.astype(np.int32)
    return out


def fit(docs: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, max_features: int = 4096, rounds: int = 400, decay: float = 2e-4) -> OrdinalModel:
    """From each document's buckets and times, and its label.

    Only the features that are chosen are ever held for all documents at a time.
    """
    place = np.full(BUCKETS, -1, np.int32)
    if not len(docs) or toxic.all() or not toxic.any():
        return OrdinalModel(place, np.zeros(1), np.full(GRADES, 60.0))  # nothing to tell apart: all clean
    in_toxic, in_clean = (_documents_with([d for d, y in zip(docs, toxic, strict=True) if y == which]) for which in (True, False))
    nt, nc = toxic.sum(), (~toxic).sum()
    often = np.flatnonzero(in_toxic + in_clean >= 3)
    in_toxic, in_clean = in_toxic[often], in_clean[often]
    a, b = (in_toxic + 0.5) / (nt + 1), (in_clean + 0.5) / (nc + 1)
    odds = np.log(a / (1 - a)) - np.log(b / (1 - b))
    spread = np.sqrt(1 / (in_toxic + 0.5) + 1 / (in_clean + 0.5))
    # What both classes say about as often would only fit noise.
    strength = np.where(np.abs(odds) >= 2.5, np.abs(odds) / spread, 0)
    best = np.argsort(-strength, kind="stable")[:max_features]
    best = best[strength[best] >= 3.2]
    odds, best = odds[best], often[best]
    place[best] = np.arange(len(best))
    kept = [(place[b][has], 1 + np.log(t[has])) for b, t in docs for has in [place[b] >= 0]]
    row, col, value = np.repeat(np.arange(len(docs)), [len(c) for c, _ in kept]), np.concatenate([c for c, _ in kept]), np.concatenate([v for _, v in kept])
    marked = np.bincount(row, np.append(odds > 3, False)[col] * value, len(docs))
    cuts = np.quantile(marked[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + np.searchsorted(cuts, marked, "left"), 0)

    n, size = len(docs), max(1, len(best))
    above = (grade[:, None] >= np.arange(1, GRADES + 1)).astype(float)
    weight = np.where(toxic, n / (2 * nt), n / (2 * nc))[:, None] / (n * GRADES)
    # Starting from the log-odds, so that a rare but sure word counts.
    w, t = (0.5 * odds if len(best) else np.zeros(1)), np.array([1.0, 2.0, 3.0])
    steps = [np.zeros(size), np.zeros(size), np.zeros(GRADES), np.zeros(GRADES)]
    for i in range(1, rounds + 1):  # Adam on the sum over thresholds of the logistic loss
        margin = np.bincount(row, value * w[col], n)
        p = 1 / (1 + np.exp(-np.clip(margin[:, None] - t, -60, 60)))
        g = (p - above) * weight
        gw, gt = np.bincount(col, value * g.sum(axis=1)[row], size) + decay / 10 * w, -g.sum(axis=0)
        for x, dx, m, v in ((w, gw, steps[0], steps[1]), (t, gt, steps[2], steps[3])):
            m += 0.1 * (dx - m)
            v += 0.001 * (dx * dx - v)
            x -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
        t = np.maximum.accumulate(t)  # thresholds stay in order
    return OrdinalModel(place, w, t)


def train(df: DataFrame, labels: DataFrame, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> OrdinalModel:
    """Fit on at most `sample_rows` labelled toxic and three times as many clean documents, those with the least hash of their id.

    Of an id with more labels one counts; null ids and labels take no part; without labels of both
    kinds, or with empty tables, the model calls every text clean.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).where("id is not null and y in (0, 1)").dropDuplicates(["id"])
    some = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(sample_rows if y else 3 * sample_rows)
        some = part if some is None else some.unionByName(part)
    chosen = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")  # 4 * sample_rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column("text")):
                row, bucket = features(texts)
                parts = [pairs(p) for p in np.split(bucket, np.searchsorted(row, np.arange(1, hi - lo)))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo).cast(pa.int64()), batch.column("y").slice(lo, hi - lo).cast(pa.int32()), pa.array([b.tobytes() for b, _ in parts], pa.binary()), pa.array([zlib.compress(t.tobytes(), 1) for _, t in parts], pa.binary())],
                    names=["id", "y", "buckets", "times"],
                )

    rows = chosen.mapInArrow(run, "id bigint, y int, buckets binary, times binary").toArrow().sort_by("id")
    found = [(np.frombuffer(b.as_py(), np.int32), np.frombuffer(zlib.decompress(t.as_py()), np.int32)) for b, t in zip(rows["buckets"], rows["times"], strict=True)]
    return fit(found, np.asarray(rows["y"]).astype(bool))


def grade(df: DataFrame, model: OrdinalModel, reject_at: float = 0.4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, expected_severity, severity, rejected) of every row of df.

    expected_severity is from 0 to 3; severity the grade whose P(grade >= k) is at least 1/2 last;
    rejected if P(grade >= 1) >= reject_at. A null or empty text has no feature, so is graded by the
    thresholds alone, as clean; a text has no limit; repeated rows come back each with the same grade; an
    empty table gives no rows; other columns are ignored, whatever their names. One pass, no shuffle; the
    model is a fixed number of weights.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                p = model.at_least(model.margins(texts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(p.sum(axis=1)), pa.array((p >= 0.5).sum(axis=1).astype(np.int32)), pa.array(p[:, 0] >= reject_at)],
                    names=[id_col, "expected_severity", "severity", "rejected"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, expected_severity double, severity int, rejected boolean")


def drop_toxic(df: DataFrame, model: OrdinalModel, reject_at: float = 0.4, text_col: str = "text") -> DataFrame:
    """df without the rows whose text is rejected; same columns. The text is read once, in its row."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(model.at_least(model.margins(texts))[:, 0] < reject_at))

    return df.mapInArrow(run, df.schema)
