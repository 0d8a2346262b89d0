"""Similar names within blocks, by products of letter counts: all pairs that can matter are compared, the others are ruled out in bulk."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.functions.similarity import LETTERS, PADS, jaro_winklers, letters_of, narrow, winklers
from leadweave.operators.blocks import split_blocks
from leadweave.sources.shared import written

#: Names of the right side that a part of a block has, about; pairs bounded at once; pairs compared at once.
RIGHT_ROWS, BOUNDED, COMPARED = 4000, 1 << 22, 1 << 16
#: Names of small blocks that a task takes together, about.
GROUP_ROWS = 4000
#: Of a letter as many are counted one by one; single precision is off by less than SLACK.
DEEP, SLACK = 8, 1e-4


class _Side:
    """Names of a block: lengths, first four letters, and their counts with a column for the first, second, ... of each letter."""

    def __init__(self, names: pd.Series, pad: int = PADS[0]):
        self.names = names.to_numpy(object)
        at, self.n = letters_of(names, pad)
        self.at = at
        self.start = np.full((4, len(names)), pad, np.uint32)
        self.start[: min(4, len(at))] = at[:4]
        kinds = len(LETTERS) + 1
        kind = np.full(128, kinds - 1)
        kind[[ord(c) for c in LETTERS]] = np.arange(kinds - 1)
        here = at != pad
        rows = np.broadcast_to(np.arange(len(names)), at.shape)[here]
        code = np.minimum(at[here], 127)
        counts = np.bincount(rows * kinds + kind[code], minlength=len(names) * kinds).reshape(len(names), kinds)
        self.columns = (counts[:, :, None] > np.arange(DEEP)).reshape(len(names), -1)
        self.beyond = np.maximum(counts - DEEP, 0).sum(axis=1)


def _shares(a: _Side, b: _Side, block_a: np.ndarray, block_b: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, c / |a| + c / |b|) for rows of a by those of b in the same block, where c is no less than the letters in common.

    Rows of either side are in the order of their blocks.
    """
    used = a.columns.any(axis=0) & b.columns.any(axis=0)
    x, y = a.columns[:, used].astype(np.float32), b.columns[:, used].astype(np.float32)
    left = np.hstack([x / a.n[:, None].astype(np.float32), x])
    right = np.hstack([y, y / b.n[:, None].astype(np.float32)])
    for block in np.intersect1d(block_a, block_b):
        (low, end), (first, last) = (np.searchsorted(z, [block, block + 1]) for z in (block_a, block_b))
        step = max(1, BOUNDED // (last - first))
        for at in range(low, end, step):
            to = min(end, at + step)
            s = left[at:to] @ right[first:last].T
            more = a.beyond[at:to].astype(np.float32)
            if more.any():  # as many as a has beyond, whatever b has
                s += more[:, None] * (1 / a.n[at:to, None] + 1 / b.n[None, first:last]).astype(np.float32)
            yield at, first, s


def _needed(least: np.ndarray, prefix: np.ndarray | int) -> np.ndarray:
    """What the shares have to be for a similarity of `least` with so many first letters equal."""
    return 3 * (1 - (1 - least) / (1 - 0.1 * prefix)) - 1 - SLACK


def best_in(a: pd.Series, b: pd.Series, block_a: np.ndarray, block_b: np.ndarray, threshold: float, whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, similarity) of the names of b in the block most similar to each of a, equal names apart, all that tie.

    Rows are in the order of their blocks. The name with the most letters in common is compared first; then only
    names whose letters allow as much. Blocks are bounded one by one and compared together.
    """
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
    if not len(a) or not len(b):
        return out[0]
    p, q = _Side(a), _Side(b)
    compare = lambda i, j: jaro_winklers(pd.Series(p.names[i]), pd.Series(q.names[j]), whole)

    def settle(bounds: list[tuple[int, int, np.ndarray]]) -> None:
        rows = np.concatenate([np.arange(at, at + len(s)) for at, _, s in bounds])
        seed = np.concatenate([first + s.argmax(axis=1) for _, first, s in bounds])
        found = compare(rows, seed)
        least = np.zeros(len(a))
        least[rows] = np.where((p.names[rows] == q.names[seed]) | (found < threshold), threshold, found)
        pairs = []
        for at, first, s in bounds:
            i, j = np.nonzero(s >= _needed(least[at : at + len(s)], 4)[:, None].astype(np.float32))
            pairs.append((at + i, first + j, s[i, j]))
        i, j, share = (np.concatenate(x) for x in zip(*pairs, strict=True))
        prefix = np.logical_and.accumulate(p.start[:, i] == q.start[:, j], axis=0).sum(axis=0)
        kept = share >= _needed(least[i], prefix)
        i, j = i[kept], j[kept]
        for k in range(0, len(i), COMPARED):
            u, v = i[k : k + COMPARED], j[k : k + COMPARED]
            jw = compare(u, v)
            good = (jw >= least[u]) & (p.names[u] != q.names[v])
            out.append((u[good], v[good], jw[good]))

    waiting, size = [], 0
    for bound in _shares(p, q, block_a, block_b):
        waiting.append(bound)
        size += bound[2].size
        if size >= BOUNDED:
            settle(waiting)
            waiting, size = [], 0
    if waiting:
        settle(waiting)
    i, j, jw = (np.concatenate(x) for x in zip(*out, strict=True))
    top = np.zeros(len(a))
    np.maximum.at(top, i, jw)
    first = jw == top[i]
    return i[first], j[first], jw[first]


def similar_in(a: pd.Series, b: pd.Series, block_a: np.ndarray, block_b: np.ndarray, threshold: float, whole: bool, counts: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) of all pairs in a block with this similarity, equal names as well, at most COMPARED pairs at a time.

    Rows are in the order of their blocks. Only pairs whose letters allow the similarity, and for which `counts` is true, are compared.
    """
    if not len(a) or not len(b):
        return
    p, q = _Side(a), _Side(b, PADS[1])
    x, y = narrow(p.at, q.at)

    def compare(waiting: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        i, j = (np.concatenate(v) for v in zip(*waiting, strict=True))
        for k in range(0, len(i), COMPARED):
            u, v = i[k : k + COMPARED], j[k : k + COMPARED]
            near = winklers(x[:, u], p.n[u], y[:, v], q.n[v], whole) >= threshold
            yield u[near], v[near]

    waiting, size = [], 0
    for at, first, s in _shares(p, q, block_a, block_b):
        i, j = np.nonzero(s >= np.float32(_needed(threshold, 4)))
        share, i, j = s[i, j], i + at, j + first
        kept = counts(i, j)
        i, j, share = i[kept], j[kept], share[kept]
        kept = share >= _needed(threshold, np.logical_and.accumulate(p.start[:, i] == q.start[:, j], axis=0).sum(axis=0))
        waiting.append((i[kept], j[kept]))
        size += len(waiting[-1][0])
        if size >= COMPARED or len(waiting) >= COMPARED:
            yield from compare(waiting)
            waiting, size = [], 0
    if size:
        yield from compare(waiting)


def nearest_names(left: DataFrame, right: DataFrame, keys: list[str], threshold: float, whole: bool) -> DataFrame:
    """(name_norm, zip5, lead_id): for each name of left the most similar other name `ln` of right in its ZIP code, of ties the smallest lead.

    left (name_norm, keys) and right (ln, lead_id, keys) are what split_blocks gives for zip5; the right side is
    cut as well, so a task holds a part of a ZIP code's names on either side and its memory is bounded. Small ZIP
    codes go to a task together, as many as make GROUP_ROWS names.
    """
    left = written(left.select("name_norm", *keys).withColumnRenamed("_part", "_left"), "names")
    right = written(right.select("ln", "lead_id", *keys).withColumnRenamed("_part", "_left"), "names")
    b, a, block = split_blocks(right, left, ["zip5", "_left"], RIGHT_ROWS)
    groups = 1 + (left.count() + right.count()) // GROUP_ROWS
    group = [F.pmod(F.xxhash64("zip5"), F.lit(groups)).alias("_group"), *block[1:]]

    def compare(l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:  # noqa: E741
        l, r = l.sort_values("zip5"), r.sort_values("zip5")  # noqa: E741
        _, at = np.unique(np.concatenate([l["zip5"].to_numpy(object), r["zip5"].to_numpy(object)]), return_inverse=True)
        i, j, jw = best_in(l["name_norm"], r["ln"], at[: len(l)], at[len(l) :], threshold, whole)
        taken = lambda c, rows: pd.Series(c.to_numpy(object)[rows], dtype=object)
        return pd.DataFrame({"name_norm": taken(l["name_norm"], i), "zip5": taken(l["zip5"], i), "lead_id": taken(r["lead_id"], j), "jw": jw})

    near = a.groupBy(*group).cogroup(b.groupBy(*group)).applyInPandas(compare, "name_norm string, zip5 string, lead_id string, jw double")
    return near.groupBy("name_norm", "zip5").agg(F.min_by("lead_id", F.struct(-F.col("jw"), F.col("lead_id"))).alias("lead_id"))
