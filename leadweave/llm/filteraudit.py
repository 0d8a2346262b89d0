"""Filter interaction audit: what each of five filters removes, alone, first or last, in every order.

Documents become shards of a sparse document-term matrix in CSR form. A word's column is its code in one
dictionary for all shards: 64 bits of a hash, where the dictionary, built from the distinct words of every
task, shows that no other word has them; words that share their 64 bits take other ones. So shards are
encoded where they are read, with no table of words in any task. Sums of a row's entries are its words, the
number of its entries are its distinct words; they decide filters A and B.

With the flags of all five filters a document is one of 32 cases. Cases are counted by part, and a fixed
table of what each order and step does to each case turns the counts into the audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.llm.flat import _BYTE, Texts, _hash, mix, slices, words
from leadweave.llm.tables import written

FILTERS = "ABCDE"
#: The limits of filters A, B and C, and the characters that D seeks.
LEAST_WORDS, LEAST_DISTINCT, MOST_UPPER, SYMBOLS = 50, 65, 5, "#$%&*|"
#: Groups of equal texts up to which they are broadcast (32 bytes each), and words of the dictionary that a task holds at a time.
BROADCAST_ROWS, HELD = 200_000, 1_000_000
_OTHER = np.uint64(0xA24BAED4963EE407)


@dataclass
class Shard:
    """A block of rows of the document-term matrix: row i has the entries indptr[i] to indptr[i + 1]."""

    indptr: np.ndarray
    codes: np.ndarray
    counts: np.ndarray

    def row_sums(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.counts)))
        return total[self.indptr[1:]] - total[self.indptr[:-1]]

    def row_entries(self) -> np.ndarray:
        return np.diff(self.indptr)


def _second(texts: Texts, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of words, in order of their places, that don't follow from their codes."""
    return _hash(texts.data, start, end, _BYTE[::-1], _OTHER)


def encode(texts: Texts, clash: frozenset[int] = frozenset(), bits: int = 64) -> Shard:
    """The CSR shard of some texts; words whose code is in `clash` are told apart by a second hash."""
    found = words(texts, lower=False)
    code = found.hash & np.uint64((1 << bits) - 1)
    if clash:
        at = np.flatnonzero(np.isin(code, np.array(sorted(clash), np.uint64)))
        code = code.copy()
        code[at] = mix(code[at] ^ _second(texts, found.start[at], found.end[at]))
    order = np.lexsort((code, found.row))
    row, code = found.row[order], code[order]
    new = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate((new, [len(row)]))) if len(row) else new
    return Shard(np.searchsorted(row[new], np.arange(len(texts) + 1)), code[new], counts)


def _dictionary(texts: DataFrame, bits: int) -> DataFrame:
    """(code, one, two) of every code: the least and the greatest second hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def distinct() -> np.ndarray:
            rows = np.concatenate([*held, np.zeros((0, 2), np.uint64)])
            return np.unique(rows.view("u8,u8").ravel()).view(np.uint64).reshape(-1, 2)

        def made(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i]).view(np.int64)) for i in (0, 1)], names=["code", "second"])

        for batch in batches:
            for _, _, part in slices(batch.column(0)):
                found = words(part, lower=False)
                first = np.sort(np.unique(found.hash, return_index=True)[1])
                held.append(np.stack([found.hash[first] & np.uint64((1 << bits) - 1), _second(part, found.start[first], found.end[first])], axis=1))
                if sum(map(len, held)) > HELD:
                    held = [distinct()]
                    if len(held[0]) > HELD // 2:
                        yield made(held[0])
                        held = []
        yield made(distinct())

    return texts.mapInArrow(run, "code bigint, second bigint").groupBy("code").agg(F.min("second").alias("one"), F.max("second").alias("two"))


def shared_codes(df: DataFrame, text_col: str = "text", bits: int = 64) -> frozenset[int]:
    """The codes that two words of df share: of k words, k^2 / 2^65 are expected, so next to none reach the driver."""
    return frozenset(r["code"] & 0xFFFFFFFFFFFFFFFF for r in _dictionary(df.select(F.col(f"`{text_col}`")), bits).where("one <> two").select("code").collect())


def term_shards(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """The document-term matrix of df, a row per shard of about 2 MB of text: ids, indptr, codes, counts.

    Row i of a shard is the document ids[i] with the entries indptr[i] to indptr[i + 1]; codes are the
    same in all shards. Null texts are rows without entries; an empty table gives no shards.
    """
    clash = shared_codes(df, text_col, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                s = encode(texts, clash, bits)
                ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64()).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (ids, s.indptr, s.codes.view(np.int64), s.counts)], names=["ids", "indptr", "codes", "counts"])

    return df.select(id_col, text_col).mapInArrow(run, "ids array<bigint>, indptr array<bigint>, codes array<bigint>, counts array<bigint>")


def _flags(docs: DataFrame, clash: frozenset[int]) -> DataFrame:
    """(id, part, failed, n_bytes, x, y): filters A to D as bits of `failed`, and 128 bits of the text."""
    symbols = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in slices(batch.column(2)):
                shard = encode(texts, clash)
                n, distinct, data = shard.row_sums(), shard.row_entries(), texts.data
                upper, chars, odd = (np.diff(np.concatenate(([0], np.cumsum(x)))[texts.offsets]) for x in ((data >= 65) & (data <= 90), (data & 0xC0) != 0x80, symbols[data]))
                failed = (n < LEAST_WORDS) + 2 * (100 * distinct < LEAST_DISTINCT * n) + 4 * (100 * upper > MOST_UPPER * chars) + 8 * (odd > 0)
                view = data.tobytes()
                sums = np.frombuffer(b"".join(hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(texts.offsets[:-1], texts.offsets[1:], strict=True)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(failed.astype(np.int32)), pa.array(np.diff(texts.offsets)), *(pa.array(np.ascontiguousarray(sums[:, i])) for i in (0, 1))], names=["id", "part", "failed", "n_bytes", "x", "y"]
                )

    return docs.mapInArrow(run, "id bigint, part string, failed int, n_bytes bigint, x bigint, y bigint")


def effects() -> list[tuple]:
    """(failed, filter_order, step, kept, removed, redundant, unique_fails, share): each order and step on each of the 32 cases.

    share is of 120: in how many orders the step's filter is the first that the case fails.
    """
    out = []
    for order in permutations(range(len(FILTERS))):
        for step in range(len(FILTERS)):
            bit, before = 1 << order[step], sum(1 << f for f in order[:step])
            for case in range(1 << len(FILTERS)):
                fails, earlier = bool(case & bit), bool(case & before)
                share = 120 // case.bit_count() if fails else 0
                out.append((case, "".join(FILTERS[f] for f in order), step + 1, int(not case & (before | bit)), int(fails and not earlier), int(fails and earlier), int(case == bit), share))
    return out


def audit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row per part, order of the filters and step, with long counts of the part's documents.

    A fails a text of fewer than LEAST_WORDS words, B one with too few distinct words, C too many of A to
    Z, D any of SYMBOLS, E one that equals the text of any smaller id. kept counts what is left after the
    step, removed what it takes, redundant what its filter would but an earlier one took, unique_fails
    what fails it alone, good_lost and toxic_lost what it takes of labels' quality 1 and toxic 1, shapley
    its filter's removals at any step, over all orders. Null texts are empty, a null part is the empty string, texts
    have no greatest length. A row without an id has no label, equals none smaller, and is smaller than none;
    repeated rows count each and are no copies of each other; a label holds if any of an id's rows says
    so. Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")
    docs = df.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text)
    flags = written(_flags(docs, shared_codes(docs)), "flags")
    key = ["n_bytes", "x", "y"]
    copies = written(flags.groupBy(key).agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select(*key, "least"), "copies")
    said = labels.where("quality = 1 or toxic = 1").select(F.col("doc_id").cast("bigint").alias("id"), "quality", "toxic")
    said = said.where("id is not null").groupBy("id").agg(*(F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(c) for c in ("quality", "toxic")))
    met = flags.join(F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies, key, "left").join(said, "id", "left")
    case = F.col("failed") + F.when(F.col("id") > F.col("least"), 16).otherwise(0)
    cases = met.groupBy("part", case.alias("failed")).agg(F.count("*").alias("n"), *(F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in ("quality", "toxic")))
    table = spark.createDataFrame(effects(), "failed int, filter_order string, step int, keeps int, removes int, repeats int, alone int, share int")
    total = lambda e, name: F.sum(F.expr(e)).cast("bigint").alias(name)
    return cases.join(F.broadcast(table), "failed").groupBy("part", "filter_order", "step").agg(
        total("n * keeps", "kept"), total("n * removes", "removed"), total("n * repeats", "redundant"), total("n * alone", "unique_fails"),
        total("quality * removes", "good_lost"), total("toxic * removes", "toxic_lost"), total("n * share", "shapley"),
    )
