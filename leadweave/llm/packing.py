"""Vector best-fit packing of token pieces into sequences.

Every item is a vector (tokens, one document, attention cost = tokens squared) and every bin has a
residual of each. Items go in order of falling length to an open bin that holds them under every
constraint, chosen by the smallest weighted norm of what would be left, or by the largest weighted
dot product of item and residual. A vector is a function of its length, so items of one length are
alike, and so are bins of the same content. The plan is made on counts of lengths (never more than
`capacity` rows, whatever the input) and takes whole groups of like bins at a time: choosing for one
item after the other would put the next items of that length into the same bin until it holds no more.
The plan says which ranks of each length go to which bins; pieces get their rank from running counts
of the partitions, so no row passes through the driver or one task.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadweave.llm.piece_codec import WordCache
from leadweave.llm.tables import written

#: White space of the tokenizer's pattern. It never joins other characters to white space behind them.
_WHITE = "\t-\r \x85\xa0  -     　"
_CHUNK = re.compile(f"[{_WHITE}]*[^{_WHITE}]+|[{_WHITE}]+")
_PIECES = "`{id}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole capacities, what doesn't fill one in front."""
    rest = total % capacity if total > capacity else total
    return [(0, rest)] * bool(rest) + [(at, capacity) for at in range(rest, total, capacity)]


def byte_encoder(path: str) -> tuple[Callable[[list[str]], list[bytes]], dict[str, int] | None]:
    """Encoder of words to little-endian ids for a byte-level BPE file of the tokenizers library, and its added tokens.

    Where ids follow the order of merges, the rank encoder of the tiktoken library gives the same ids
    at a third of the time. None instead of added tokens: the file is of another kind or a token takes
    what stands beside it, and the encoder, the tokenizers library, is for whole texts only.
    """
    with open(path) as f:
        file = json.load(f)
    vocab, merges = file["model"]["vocab"], file["model"]["merges"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in vocab.items() if t not in added}
    split = file["pre_tokenizer"]
    in_order = all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges)) and len(ranks) == 256 + len(merges)
    alone = not any(t[k] for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    if in_order and alone and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not file["normalizer"]:
        import tiktoken

        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda words: [array("I", encoding.encode_ordinary(w)).tobytes() for w in words], added
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(path)
    return lambda words: [array("I", e.ids).tobytes() for e in encoder.encode_batch(words, add_special_tokens=False)], None


class TextEncoder:
    """Ids of whole texts as bytes, each distinct word encoded once; added tokens come first, as in the library."""

    def __init__(self, path: str):
        encode, added = byte_encoder(path)
        self.library = encode if added is None else None
        self.added = {t: array("I", [i]).tobytes() for t, i in (added or {}).items()}
        self.either = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.whole = WordCache(encode)
        self.spaced = WordCache(lambda words: encode([" " + w for w in words]))

    def __call__(self, text: str) -> bytes:
        if self.library:
            return self.library([text])[0]
        if self.either and self.either.search(text):
            return b"".join(self.added[t] if i % 2 else self._plain(t) for i, t in enumerate(self.either.split(text)))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:  # else white space is single spaces and lines
            return b"".join(self.whole.look_up(_CHUNK.findall(text)))
        first, *rest = text.split(" ")
        return b"".join(self.whole.look_up([first] if first else []) + self.spaced.look_up(rest))


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of every text, with the partition that made them and their number among those of a length there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = TextEncoder(tokenizer)
        tail = array("I", [end_id]).tobytes()
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, nth = [], [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + tail
                for k, (begin, n) in enumerate(cut(len(ids) // 4, capacity)):
                    row.append(i)
                    piece.append(k)
                    start.append(begin)
                    length.append(n)
                    crc.append(zlib.crc32(ids[4 * begin : 4 * (begin + n)]))
                    nth.append(seen[n])
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                 pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64())],
                names=[id_col, "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    schema = _PIECES.format(id=id_col, kind=df.schema[id_col].dataType.simpleString())
    return df.select(id_col, text_col).mapInArrow(run, schema)


class Plan:
    """Bins for counts of lengths: ranges of equal bins, and for each length where its ranks go."""

    def __init__(self, counts: dict[int, int], capacity: int, max_docs: int, max_attention: float, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), choose: str = "norm"):
        if choose not in ("norm", "dot"):
            raise ValueError(choose)
        if not (max_docs >= 1 and all(n * n <= max_attention and n <= capacity for n in counts)):
            raise ValueError("an item is beyond a capacity of an empty bin")
        full = np.array([capacity, max_docs, max_attention], float)
        weight = np.array(weights)
        # A kind of bin: residuals, number of bins, and the (length, how often) that it holds.
        residual, bins, holds = np.zeros((0, 3)), [], []
        kinds: list[tuple[int, list[tuple[int, int]]]] = []
        for n in sorted(counts, reverse=True):
            left, item = int(counts[n]), np.array([n, 1, n * n], float)
            while left:
                fits = np.flatnonzero((residual >= item).all(axis=1))
                if len(fits):
                    rest = residual[fits]
                    score = -(((rest - item) / full) ** 2 @ weight) if choose == "norm" else (rest / full * (item / full)) @ weight
                    at = int(fits[np.argmax(score)])
                    room, number, content = residual[at], bins[at], holds[at]
                else:
                    at, room, content = -1, full, []
                    number = left
                each = int(min(room // item))
                used = min(number, left // each)
                each, used = (each, used) if used else (left, 1)  # the last bin of a kind may hold fewer
                left -= each * used
                if at >= 0:
                    bins[at] -= used
                    if not bins[at]:
                        residual = np.delete(residual, at, axis=0)
                        del bins[at], holds[at]
                now = room - each * item
                if now[0] < 1 or now[1] < 1 or now[2] < 1:
                    kinds.append((used, [*content, (n, each)]))
                else:
                    residual = np.vstack([residual, now])
                    bins.append(used)
                    holds.append([*content, (n, each)])
        kinds += zip(bins, holds, strict=True)
        self.bins = 0
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        taken = dict.fromkeys(counts, 0)
        for number, content in kinds:
            offset = 0
            for n, each in content:
                rows.setdefault(n, []).append((taken[n], self.bins, each, offset))
                taken[n] += number * each
                offset += n * each
            self.bins += number
        self.rows = rows

    def place(self, length: int, rank: int) -> tuple[int, int]:
        """(sequence, offset) of the piece of this length with this rank, from 0."""
        mine = self.rows[length]
        first, sequence, each, offset = mine[bisect_right(mine, rank, key=lambda r: r[0]) - 1]
        nth, slot = divmod(rank - first, each)
        return sequence + nth, offset + slot * length

    def table(self) -> pd.DataFrame:
        """The ranges as rows: length, first rank, first sequence, pieces of it in a bin, offset of the first."""
        return pd.DataFrame([(n, *r) for n, rs in self.rows.items() for r in rs], columns=["length", "first", "sequence", "each", "offset"])


def best_fit(
    df: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, max_docs: int | None = None, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), choose: str = "norm", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece of every row of df.

    A null or empty text is its end id alone. Repeated rows are packed each; an empty table gives no
    rows; other columns are ignored, whatever their names; a text has no limit, and only one of more than
    `capacity` tokens is cut; of bins that suit an item as well the one that was opened first is taken.
    `max_docs` and `max_attention` are the other capacities of a sequence; by default (capacity, capacity
    squared) they never bind. With a `max_attention` below capacity squared no piece may be as long as
    the capacity, so long texts are cut into pieces of its root.
    """
    longest = capacity if max_attention is None else min(capacity, math.isqrt(int(max_attention)))
    pieces = written(token_pieces(df, tokenizer, longest, end_id, id_col, text_col), "pieces")
    # Rows here: partitions x lengths at most, `capacity` of them a partition.
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    plan = Plan(counts, capacity, max_docs or capacity, max_attention or float(capacity) ** 2, weights, choose).rows
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = per_part.select(F.col("length").alias("l"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(begins, F.expr("length = l and part = p")).drop("l", "p")
    kind = df.schema[id_col].dataType.simpleString()
    flat = {n: np.array(r, np.int64) for n, r in plan.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("nth").to_numpy() + batch.column("before").to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                mine = flat[n]
                r = mine[np.searchsorted(mine[:, 0], rank[at], "right") - 1]
                nth, slot = np.divmod(rank[at] - r[:, 0], r[:, 2])
                sequence[at], offset[at] = r[:, 1] + nth, r[:, 3] + slot * n
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in (id_col, "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)],
                names=[id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
