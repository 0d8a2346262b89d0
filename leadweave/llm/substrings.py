"""Substring dedup by relative Lempel-Ziv parsing: passages that stand anywhere else are factors of the corpus.

The reference is the corpus itself, indexed by seeds. Of every window of `width` words the seed is the
gram of half its words with the least hash, so equal windows have equal seeds at equal places, and about
two of 19 positions are seeds. The index keeps for each gram that occurs again its first place. It is
dealt out by gram: every partition is a block of the reference, and each document meets all blocks that its
seeds fall into, and no others, since they can't hold any of its windows.

A document is then factored greedily from left to right: neighbouring seeds whose references continue
each other (same document, same distance, grams that overlap or touch) are one factor, which equals its
reference word for word. Windows inside a factor are repeated, at both ends of the reference. A factor
begins and ends at seeds, so a passage goes beyond it by less than a window: around factor boundaries,
and where a factor is shorter than a window, windows are looked at one by one. Each is told by
a 128-bit hash, as is the place where its seed says that the reference should have it, and those that
occur twice are repeated as well.

No window is missed. Take equal windows at two places. If one lies in a factor, the first place of its seed
has that window too. So either both are in factors; or one is and the other is compared with that
first place, or is that place and named by the factor; or both are hashed.

Which windows of a document are known is kept as masks of 64, combined by bitwise or before and after
the shuffle. So what comes together at a document, or at a passage that a third of all documents have, is
bounded by its own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from leadweave.llm.flat import _ODD, Texts, mix, slices, words
from leadweave.llm.tables import fresh, written

#: Ids up to which the documents to read again are found by a broadcast.
BROADCAST_ROWS = 1_000_000
#: Rows of seeds that are factored at a time, besides those of the document at their end.
ROWS = 100_000
_LEFT, _RIGHT = _ODD[41], _ODD[43]


def rolling(hashes: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each `width` neighbours, from differences of sums of powers; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(len(hashes), base, np.uint64))
        back = np.cumprod(np.full(n, pow(int(base), -1, 1 << 64), np.uint64))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes * base) * power, dtype=np.uint64)))
        return mix((total[width:] - total[:n]) * back)


def least(values: np.ndarray, width: int) -> np.ndarray:
    """Where each `width` neighbours have their least value, the leftmost of equal ones."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        right = values[step:] < values[:-step]
        values, at = np.where(right, values[step:], values[:-step]), np.where(right, at[step:], at[:-step])
        span += step
    return at


def gram_words(width: int) -> int:
    """Words of a seed: so many that seeds of neighbouring windows at least touch."""
    return (width + 1) // 2


def seeds(texts: Texts, width: int) -> tuple[np.ndarray, ...]:
    """(gram, row, pos, first, last): each seed's hash, row, word, and the first and last window that it stands for."""
    found = words(texts, lower=False)
    k = gram_words(width)
    n = len(found.hash) - width + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    grams = rolling(found.hash, k, _LEFT)
    window = np.flatnonzero(found.row[:n] == found.row[width - 1 :])
    at = least(grams, width - k + 1)[window]
    new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
    end = np.concatenate((new[1:], [len(at)]))[: len(new)] - 1
    row = found.row[at[new]]
    begin = found.bounds(len(texts))[row]
    return grams[at[new]], row, at[new] - begin, window[new] - begin, window[end] - begin


def _seeds(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                gram, row, pos, first, last = seeds(texts, width)
                own = batch.column(0).slice(lo, hi - lo).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), own, *(pa.array(x.astype(np.int32)) for x in (pos, first, last))], names=["gram", "own", "pos", "first", "last"])

    return docs.select("own", "text").mapInArrow(run, "gram bigint, own bigint, pos int, first int, last int")


def masks(own: np.ndarray, lo: np.ndarray, hi: np.ndarray, kind: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(own, chunk, a mask of each kind): the windows lo to hi, in chunks of 64, combined by (own, chunk)."""
    lo = np.maximum(lo, 0)
    some = hi >= lo
    own, lo, hi, kind = own[some], lo[some], hi[some], kind[some]
    times = (hi >> 6) - (lo >> 6) + 1
    step = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    own, lo, hi, kind = (np.repeat(x, times) for x in (own, lo, hi, kind))
    chunk = (lo >> 6) + step
    a, b = np.maximum(lo - (chunk << 6), 0).astype(np.uint64), np.minimum(hi - (chunk << 6), 63).astype(np.uint64)
    bits = (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - (b - a))) << a
    order = np.lexsort((chunk, own))
    own, chunk, bits, kind = own[order], chunk[order], bits[order], kind[order]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (chunk[1:] != chunk[:-1])))) if len(own) else np.zeros(0, np.int64)
    each = [np.bitwise_or.reduceat(np.where(kind == k, bits, np.uint64(0)), new) if len(new) else np.zeros(0, np.uint64) for k in range(kinds)]
    return own[new], chunk[new], each


def factor(own: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, ref: np.ndarray, ref_pos: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Masks (own, chunk, [known, asked, first place]) from whole documents' repeated seeds, by document and place.

    known: windows in factors of at least `width` words, here and at the reference. asked: windows of
    other seeds, and where the reference should have them. first place: windows of seeds that are references.
    """
    k = gram_words(width)
    root = (own == ref) & (pos == ref_pos)
    away = pos - ref_pos
    go_on = (own[1:] == own[:-1]) & (ref[1:] == ref[:-1]) & (away[1:] == away[:-1]) & (pos[1:] - pos[:-1] <= k) & ~root[1:] & ~root[:-1]
    begin = np.flatnonzero(np.concatenate(([True], ~go_on))) if len(own) else np.zeros(0, np.int64)
    run = np.cumsum(np.concatenate(([True], ~go_on)))[: len(own)] - 1
    end = np.concatenate((begin[1:], [len(own)]))[: len(begin)] - 1
    lo, hi = pos[begin], pos[end] + k - width
    full = (hi >= lo) & ~root[begin]
    b = begin[full]
    lo, hi = np.where(full, lo, 1 << 40)[run], np.where(full, hi, (1 << 40) - 1)[run]
    before, after, copy = np.minimum(last, lo - 1), np.maximum(first, hi + 1), ~root
    ranges = [
        (own[b], lo[b], hi[b], 0), (ref[b], lo[b] - away[b], hi[b] - away[b], 0),
        (own[copy], first[copy], before[copy], 1), (ref[copy], (first - away)[copy], (before - away)[copy], 1),
        (own[copy], after[copy], last[copy], 1), (ref[copy], (after - away)[copy], (last - away)[copy], 1),
        (own[root], first[root], last[root], 2),
    ]
    kind = np.concatenate([np.full(len(r[0]), r[3]) for r in ranges])
    return masks(*(np.concatenate([r[i] for r in ranges]) for i in range(3)), kind, 3)


def _factors(met: DataFrame, width: int) -> DataFrame:
    """Masks of what each document's seeds say; met is dealt out by document and sorted by document and place."""
    names = ["own", "pos", "first", "last", "ref", "ref_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        rows = 0

        def made(columns: list[np.ndarray]) -> pa.RecordBatch:
            own, chunk, each = factor(*columns, width)
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(chunk.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in each)], names=["own", "chunk", "known", "asked", "place"])

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
                rows += batch.num_rows
            if rows >= ROWS and held[0][0][0] != held[-1][0][-1]:
                columns = [np.concatenate(x) for x in zip(*held, strict=True)]
                whole = int(np.searchsorted(columns[0], columns[0][-1]))  # the last document may go on
                yield made([x[:whole] for x in columns])
                held = [[x[whole:] for x in columns]]
                rows = len(held[0][0])
        if held:
            yield made([np.concatenate(x) for x in zip(*held, strict=True)])

    return met.select(*names).mapInArrow(run, "own bigint, chunk int, known bigint, asked bigint, place bigint")


def _bits(rows: list[dict] | None, n: int) -> np.ndarray:
    """The windows, of n, that masks of 64 name."""
    out = np.zeros(max(0, n), bool)
    for r in rows or ():
        at = r["chunk"] << 6
        bits = np.unpackbits(np.array([r["bits"] & 0xFFFFFFFFFFFFFFFF], "<u8").view(np.uint8), bitorder="little").astype(bool)
        out[at : at + 64] |= bits[: len(out[at : at + 64])]
    return out


def _hashed(docs: DataFrame, width: int) -> DataFrame:
    """(x, y, own, at): 128 bits of the windows that each document's masks name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for lo, hi, texts in slices(batch.column(1)):
                found = words(texts, lower=False)
                x, y = rolling(found.hash, width, _LEFT), rolling(found.hash, width, _RIGHT)
                bounds = found.bounds(len(texts))
                at = [np.flatnonzero(_bits(lists[lo + i].as_py(), int(bounds[i + 1] - bounds[i]) - width + 1)) for i in range(hi - lo)]
                every = np.concatenate([a + b for a, b in zip(at, bounds, strict=False)]).astype(np.int64)
                own = batch.column(0).slice(lo, hi - lo).take(pa.array(np.repeat(np.arange(hi - lo), [len(a) for a in at]), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(x[every].view(np.int64)), pa.array(y[every].view(np.int64)), own, pa.array(np.concatenate(at).astype(np.int32))], names=["x", "y", "own", "at"])

    return docs.select("own", "text", "masks").mapInArrow(run, "x bigint, y bigint, own bigint, at int")


def _listed(bits: DataFrame) -> DataFrame:
    """A row per document with its masks, at most a 64th of its words."""
    return bits.groupBy("own").agg(F.collect_list(F.struct("chunk", "bits")).alias("masks"))


def repeated_windows(docs: DataFrame, width: int = 35) -> DataFrame:
    """(own, chunk, bits): of the documents (own, text), each own once, the windows of `width` words that also start elsewhere."""
    found = written(_seeds(docs, width), "seeds")
    first = F.min(F.struct("own", "pos")).alias("at")
    index = written(found.groupBy("gram").agg(F.count("*").alias("n"), first).where("n > 1").select("gram", F.col("at.own").alias("ref"), F.col("at.pos").alias("ref_pos")), "index")
    met = found.join(index, "gram").repartition("own").sortWithinPartitions("own", "pos")
    said = _factors(met, width).groupBy("own", "chunk").agg(*(F.expr(f"bit_or({c})").alias(c) for c in ("known", "asked", "place")))
    said = written(said, "factors")
    # Windows of a first place that no factor names are like those at boundaries.
    asked = written(_listed(said.select("own", "chunk", F.expr("asked | (place & ~known)").alias("bits")).where("bits <> 0")), "asked")
    ids = asked.select("own")
    near = docs.join(F.broadcast(ids) if asked.count() <= BROADCAST_ROWS else ids, "own", "left_semi")
    hashed = written(_hashed(near.join(asked, "own"), width), "boundaries")
    twice = written(hashed.groupBy("x", "y").count().where("count > 1").select("x", "y"), "twice")
    more = hashed.join(twice, ["x", "y"]).select("own", F.expr("at div 64").cast("int").alias("chunk"), F.expr("shiftleft(1L, at % 64)").alias("bits"))
    return said.selectExpr("own", "chunk", "known as bits").where("bits <> 0").unionByName(more).groupBy("own", "chunk").agg(F.expr("bit_or(bits)").alias("bits"))


def drop_repeated(df: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", kept_col: str = "kept", words_col: str = "n_words", removed_col: str = "n_removed") -> DataFrame:
    """df with, per row, its words, those that repeated windows cover, and the others joined by one blank.

    Words are runs of characters other than ASCII white space. A word is removed if a window of `width`
    words covers it whose sequence also starts elsewhere, in any row of df, this one included; all
    windows are judged on the input. Null texts are empty; texts have no greatest length; rows of one
    id, and rows without one, are rows of their own: equal rows lose every word if they have `width`; an
    empty table gives no rows. All columns of df come back, whatever their names; the three new ones must
    not be among them.
    """
    if width < 2:
        raise ValueError("a window has two words at least")
    own, twin, got = (fresh(df, x) for x in ("own", "twin", "masks"))
    named, text = F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{text_col}`")
    odd = df.select(named.alias("id")).groupBy("id").count().where("count > 1 or id is null").limit(1).count()
    # Ids that don't tell rows apart give way to 64 bits of the whole row's id and text.
    keyed = df.withColumn(own, F.xxhash64(named, text) if odd else named)
    docs = keyed.select(F.col(own).alias("own"), text.alias("text"))
    if odd:
        keyed = keyed.join(written(docs.groupBy("own").count().select(F.col("own").alias(own), (F.col("count") > 1).alias(twin)), "twins"), own)
        docs = docs.dropDuplicates(["own"])
    else:
        keyed = keyed.withColumn(twin, F.lit(False))
    lists = written(_listed(repeated_windows(docs, width)), "masks").toDF(own, got)

    schema = StructType([*df.schema.fields, StructField(words_col, LongType()), StructField(removed_col, LongType()), StructField(kept_col, StringType())])
    columns = [f.name for f in df.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept = [], [], []
            for t, all_gone, rows in zip(batch.column(text_col), batch.column(twin), batch.column(got), strict=True):
                tokens = (t.as_py() or "").encode().split()
                n.append(len(tokens))
                starts = _bits(rows.as_py(), len(tokens) - width + 1) | all_gone.as_py()
                if starts.any():
                    cover = np.zeros(len(tokens) + 1, np.int64)
                    cover[: len(starts)] += starts
                    cover[width : width + len(starts)] -= starts
                    left = np.cumsum(cover)[:-1] == 0
                    tokens = [w for w, stays in zip(tokens, left.tolist(), strict=True) if stays]
                gone.append(n[-1] - len(tokens))
                kept.append(b" ".join(tokens).decode())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*columns, words_col, removed_col, kept_col])

    ids = lists.select(own)
    if lists.count() > BROADCAST_ROWS:
        return keyed.join(lists, own, "left").mapInArrow(run, schema)
    # Only the documents that lose words go through a shuffle.
    some = keyed.join(F.broadcast(ids), own, "left_semi").join(lists, own)
    rest = keyed.join(F.broadcast(ids), own, "left_anti").withColumn(got, F.lit(None).cast(lists.schema[got].dataType))
    return some.mapInArrow(run, schema).unionByName(rest.mapInArrow(run, schema))
