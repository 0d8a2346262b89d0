"""Jaro-Winkler as an Arrow-batched function for pairs that blocking has left: half transpositions kept, or whole ones only as in SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler(a: str, b: str) -> float:
    """1 for equal strings, two empty ones included; the prefix counts from a Jaro of 0.7 on."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, t in zip(b, taken, strict=True) if t]
    half = sum(x != y for x, y in zip(left, right, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - half) / m) / 3
    if jaro < 0.7:
        return jaro
    prefix = 0
    for x, y in zip(a[:4], b[:4]):  # noqa: B905
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


#: Behind the ends of the names of either side: no letters, and not equal.
PADS = 0xFFFFFFFF, 0xFFFFFFFE


def letters_of(names: pd.Series, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, row) code points of names, `pad` behind their ends, and the lengths."""
    text = names.fillna("").to_numpy(str)
    n = np.char.str_len(text)
    at = np.ascontiguousarray(text.view(np.uint32).reshape(len(text), -1).T) if text.itemsize else np.zeros((0, len(text)), np.uint32)
    at[np.arange(len(at))[:, None] >= n] = pad
    return at, n


def _fused(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """x * y + z rounded once: product and sum with what their rounding left over."""
    halves = lambda v: (v * 134217729.0 - (v * 134217729.0 - v), v - (v * 134217729.0 - (v * 134217729.0 - v)))
    (xh, xl), (yh, yl), p = halves(x), halves(y), x * y
    left = ((xh * yh - p) + xh * yl + xl * yh) + xl * yl
    s = p + z
    back = s - p
    return s + (((p - (s - back)) + (z - back)) + left)


def jaro_winklers(a: pd.Series, b: pd.Series, whole: bool = False) -> np.ndarray:
    """jaro_winkler of each row: its loops over places, with all rows at once in each step.

    With `whole`, an odd number of letters out of order counts as one less, the letters of b choose their partners and the boost
    is rounded once: jaro_winkler_similarity of DuckDB for names that aren't empty, of ASCII letters, to the last bit.
    """
    (x, n), (y, m) = letters_of(a, PADS[0]), letters_of(b, PADS[1])
    x, y = narrow(x, y)
    return winklers(x, n, y, m, whole)


def narrow(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of letters_of with PADS as bytes, where all fit beside the ends."""
    if max((v[v < PADS[1]].max(initial=0) for v in (x, y)), default=0) < 254:
        return x.astype(np.uint8), y.astype(np.uint8)
    return x, y


def _after(at: np.ndarray, same: np.ndarray, rows: int, pad: int) -> np.ndarray:
    """The code points behind the first `same` of each name, `rows` of them."""
    longer = np.vstack([at, np.full((1, at.shape[1]), pad & np.iinfo(at.dtype).max, at.dtype)])
    return np.take_along_axis(longer, np.minimum(same + np.arange(rows)[:, None], len(at)), axis=0)


def winklers(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, whole: bool) -> np.ndarray:
    """jaro_winklers of names given by their code points, a place in each row, and lengths.

    Equal first letters are each other's partners, so only what follows them is looked through.
    """
    k = min(len(x), len(y))
    same = np.logical_and.accumulate(x[:k] == y[:k], axis=0).sum(axis=0) if k else np.zeros(len(n), int)
    x, y = (_after(v, same, int((size - same).max(initial=0)), pad) for v, size, pad in ((x, n, PADS[0]), (y, m, PADS[1])))
    if whole:
        x, n, y, m = y, m, x, n
    reach = np.maximum(0, np.maximum(n, m) // 2 - 1)
    most, least = int(reach.max(initial=0)), int(reach.min(initial=1 << 30))
    within = [reach >= d for d in range(most + 1)]
    left, free = np.zeros(x.shape, bool), np.ones(y.shape, bool)
    for i in range(len(x)):
        open_ = np.ones(len(n), bool)
        for j in range(max(0, i - most), min(len(y), i + most + 1)):
            hit = x[i] == y[j]
            hit &= free[j]
            hit &= open_
            if abs(i - j) > least:
                hit &= within[abs(i - j)]
            free[j] ^= hit
            open_ ^= hit
        left[i] = ~open_
    common = left.sum(axis=0)
    # Row by row both have as many letters in common, in their own orders.
    apart = x.T[left.T] != y.T[~free.T]
    moved = np.bincount(np.repeat(np.arange(len(n)), common)[apart], minlength=len(n))
    c, half = (common + same).astype(float), moved // 2 if whole else moved / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(c > 0, (c / n + c / m + (c - half) / c) / 3, 0.0)
    prefix = np.minimum(same, 4)
    boosted = _fused(prefix * 0.1, 1 - jaro, jaro) if whole else jaro + prefix * 0.1 * (1 - jaro)
    out = np.where(jaro < 0.7, jaro, boosted)
    return np.where((n == m) & (same == n), 1.0, out)


def _pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winklers(a, b), dtype="float64")


def _whole_pairs(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series(jaro_winklers(a, b, True), dtype="float64")


def similarity(a: Column, b: Column, whole: bool = False) -> Column:
    # Built here: the workers import this module without a session.
    return F.pandas_udf(_whole_pairs if whole else _pairs, "double")(a, b)


#: Letters that are counted one by one, up to three of each; all other characters are counted together.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "
_A_LONG = 21


def letters(name: Column) -> Column:
    """struct<low, high, extra, n>: a name's letters as up to three bits each, how many are beyond that, and its length.

    The bits that two names share, and the smaller number beyond, are no fewer than the letters they have in common.
    """
    each = F.transform(F.array(*map(F.lit, LETTERS)), lambda x: F.length(name) - F.length(F.replace(name, x, F.lit(""))))
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x)
    counts = F.concat(each, F.array(F.length(name) - total(each)))
    unary = F.array(*(F.lit(x).cast("bigint") for x in (0, 1, 3, 7)))
    bits = F.transform(counts, lambda c, i: F.call_function("shiftleft", F.element_at(unary, F.least(c, F.lit(3)) + 1), 3 * (i % _A_LONG)))
    packed = lambda lo, k: F.aggregate(F.slice(bits, lo, k), F.lit(0).cast("bigint"), lambda t, x: t.bitwiseOR(x))
    extra = total(F.transform(counts, lambda c: F.greatest(c - 3, F.lit(0))))
    return F.struct(packed(1, _A_LONG).alias("low"), packed(_A_LONG + 1, len(LETTERS) + 1 - _A_LONG).alias("high"), extra.alias("extra"), F.length(name).alias("n"))


def may_reach(a: Column, b: Column, x: Column, y: Column, threshold: float) -> Column:
    """False only where names a and b, with letters x and y, can't have this similarity (above 0.7).

    With c letters in common Jaro is at most (c/|a| + c/|b| + 1) / 3, and of the prefix only what is
    equal counts. All of it is arithmetic on numbers, before the function.
    """
    shared = F.bit_count(x["low"].bitwiseAND(y["low"])) + F.bit_count(x["high"].bitwiseAND(y["high"])) + F.least(x["extra"], y["extra"])
    common = F.least(shared, x["n"], y["n"])
    starts = lambda k: F.substring(a, 1, k) == F.substring(b, 1, k)
    prefix = F.when(starts(4), 0.4).when(starts(3), 0.3).when(starts(2), 0.2).when(starts(1), 0.1).otherwise(0.0)
    jaro = (common / F.greatest(x["n"], F.lit(1)) + common / F.greatest(y["n"], F.lit(1)) + 1) / 3
    return (common > 0) & (jaro + prefix * (1 - jaro) >= threshold - 1e-9)
