"""SentencePiece BPE encoding and decoding by merge rounds over flat numpy arrays.

A word here is a maximal run of spaces with the run of other characters behind it; no piece of the
vocabulary goes on past such a place, nor past a character that no piece holds, so words are encoded
alone and each distinct one once. Words of a batch stand as one flat array of symbols. A round looks
up the rank of every pair of neighbours, takes the least rank of each word, merges its occurrences
from the left, drops the symbols merged away and forgets words without a pair. A merge that brings
up a pair of the same or a better rank ends its word's round, since that pair comes next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
_NONE = np.iinfo(np.int32).max
#: Distinct words held per task, and characters merged at a time; both bound memory.
CACHE_WORDS, CACHE_CHARS, ROUND_CHARS = 400_000, 6_000_000, 1 << 17


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Protobuf wire format: (field number, value)."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size, at = {1: (8, at), 5: (4, at)}.get(kind) or _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PieceCodec:
    """Encoder and decoder of a SentencePiece BPE model with byte fallback and identity normalising."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            model = f.read()
        text, score, kind = [], [], []
        self.dummy_prefix = True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                text.append(piece[1].decode())
                score.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
                kind.append(piece.get(3, 1))
            elif number == 3:
                norm = dict(_fields(value))
                if norm.get(2, b"") or norm.get(4, 1):
                    raise ValueError("only models that leave the text as it is are supported")
                self.dummy_prefix = bool(norm.get(3, 1))
        self.size, self.end = len(text), text.index("</s>")
        normal = {t: i for i, (t, k) in enumerate(zip(text, kind, strict=True)) if k == 1}
        self.byte_id = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = [b""] * self.size
        for i, (t, k) in enumerate(zip(text, kind, strict=True)):
            if k == 6:
                self.byte_id[int(t[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(t[3:5], 16)])
            elif k == 1:
                self.bytes_of[i] = t.replace(SPACE, " ").encode()
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte_id] = True
        order = {s: r for r, s in enumerate(sorted({score[i] for i in normal.values()}, reverse=True))}
        single = {t: i for t, i in normal.items() if len(t) == 1}
        self.char_id = np.full(0x110000, -1, np.int32)
        for t, i in single.items():
            self.char_id[ord(t)] = i
        pairs = {}
        for t, i in normal.items():
            for cut in range(1, len(t)):
                left, right = normal.get(t[:cut]), normal.get(t[cut:])
                if left is not None and right is not None:
                    pairs[left * self.size + right] = (order[score[i]], i)
        # An open hash table of 2^20 slots; an empty one points at the last key, which no pair has.
        self.keys = np.array([*pairs, -2], np.int64)
        found = np.array([*pairs.values(), (_NONE, -1)], np.int32)
        self.rank, self.into = found[:, 0].copy(), found[:, 1].copy()
        self.slots = np.full(1 << 20, len(pairs), np.int32)
        for at, key in enumerate(pairs):
            slot = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> 44
            while self.slots[slot] < len(pairs):
                slot = (slot + 1) & 0xFFFFF
            self.slots[slot] = at
        if any(SPACE in t.lstrip(SPACE) for t in normal):
            raise ValueError("a piece goes on past a space")
        # Runs of spaces are merged last, from the left, into blocks of 16: those in front can be cut off.
        runs = [normal.get(SPACE * n) for n in range(2, 18)]
        last = len(order) - 1
        even = all(i is not None and order[score[i]] == last for i in runs[:-1]) and runs[-1] is None
        blocks = " {16}(?=  )|" if even and sum(order[score[i]] == last for i in normal.values()) == 15 else ""
        loose = "".join(re.escape(c) for c in "\n\t\r" if self.char_id[ord(c)] < 0)
        self.pattern = re.compile(f"{blocks}[{loose}]| *[^ {loose}]+| +" if loose else f"{blocks} *[^ ]+| +")

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece) of each pair; the rank is _NONE if it can't be merged."""
        key = np.where((left >= 0) & (right >= 0), left.astype(np.int64) * self.size + right, -1)
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)
        at = self.slots[slot]
        while (miss := (self.keys[at] != key) & (at != len(self.keys) - 1)).any():
            slot = np.where(miss, (slot + 1) & 0xFFFFF, slot)
            at = self.slots[slot]
        return self.rank[at], self.into[at]

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, spaces included, without the dummy prefix and the end id."""
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(words):
            hi, n = lo, 0
            while hi < len(words) and (hi == lo or n + len(words[hi]) <= ROUND_CHARS):
                n += len(words[hi])
                hi += 1
            out += self._merge(words[lo:hi])
            lo = hi
        return out

    def _merge(self, words: list[str]) -> list[np.ndarray]:
        codes = np.frombuffer("".join(words).replace(" ", SPACE).encode("utf-32-le"), np.int32)
        length = np.array([len(w) for w in words], np.int64)
        word = np.repeat(np.arange(len(words), dtype=np.int32), length)
        known = self.char_id[codes]
        symbol = np.where(known >= 0, known, -2 - codes)  # a character that no piece holds
        n = len(symbol)
        # Of the pair that begins at a symbol; what is merged is looked up anew, the rest stays.
        rank, into = np.full(n, _NONE, np.int32), np.full(n, -1, np.int32)
        if n > 1:
            inner = np.flatnonzero(word[:-1] == word[1:])
            rank[inner], into[inner] = self.pair_ranks(symbol[inner], symbol[inner + 1])
        done_word, done_symbol = [], []
        while n:
            fresh = np.empty(n, bool)
            fresh[0] = True
            np.not_equal(word[1:], word[:-1], out=fresh[1:])
            first = np.flatnonzero(fresh)
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, n)))
            at = np.flatnonzero((rank == least) & (rank != _NONE))
            over = least == _NONE
            if over.mean() > 0.25 or not len(at):
                done_word.append(word[over])
                done_symbol.append(symbol[over])
                keep = ~over
                symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
                n = len(symbol)
                continue
            # Of overlapping occurrences the 1st, 3rd, ... of a run of neighbours are merged.
            run = np.concatenate(([True], at[1:] != at[:-1] + 1))
            if not run.all():
                start = at[run][np.cumsum(run) - 1]
                at = at[(at - start) % 2 == 0]
            # The pairs that a merge brings up: with what stands on its right, and on its left.
            owner, made = word[at], into[at]
            right = np.minimum(at + 2, n - 1)
            has_right = (at + 2 < n) & (word[right] == owner)
            left = np.maximum(at - 1, 0)
            has_left = (at > 0) & (word[left] == owner)
            before = symbol[left]
            joined = np.flatnonzero((at[1:] == at[:-1] + 2) & (owner[1:] == owner[:-1])) + 1
            before[joined] = made[joined - 1]
            new_right, into_right = self.pair_ranks(made, np.where(has_right, symbol[right], -1))
            new_left, into_left = self.pair_ranks(np.where(has_left, before, -1), made)
            # One of no worse rank comes before the merges on its right, so those wait.
            stops = np.minimum(new_left, new_right) <= rank[at]
            if stops.any():
                count = np.cumsum(stops) - stops
                begin = np.concatenate(([True], owner[1:] != owner[:-1]))
                go = count == count[begin][np.cumsum(begin) - 1]
                at, made, left, has_left = at[go], made[go], left[go], has_left[go]
                new_right, into_right, new_left, into_left = new_right[go], into_right[go], new_left[go], into_left[go]
            symbol[at] = made
            rank[at], into[at] = new_right, into_right
            touching = np.flatnonzero(np.concatenate(([False], at[1:] == at[:-1] + 2)))
            left = left.copy()
            left[touching] = at[touching - 1]
            rank[left[has_left]], into[left[has_left]] = new_left[has_left], into_left[has_left]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            symbol, word, rank, into = symbol[keep], word[keep], rank[keep], into[keep]
            n = len(symbol)
        if not done_word:
            return [np.zeros(0, np.int64)] * len(words)
        word, symbol = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        word, symbol = word[order], symbol[order]
        if (symbol < 0).any():
            word, symbol = self._fall_back(word, symbol)
        return np.split(symbol, np.searchsorted(word, np.arange(1, len(words))))

    def _fall_back(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = [[s] if s >= 0 else self.byte_id[list(chr(-2 - s).encode())].tolist() for s in symbol.tolist()]
        size = np.array([len(x) for x in ids])
        return np.repeat(word, size), np.array([i for x in ids for i in x], np.int64)

    def split(self, text: str) -> tuple[bool, list[str]]:
        """The words of a text, dummy prefix included; a literal space mark counts as a space.

        With True the words stand behind one space each, which they are given without.
        """
        if not text:
            return True, []
        text = text.replace(SPACE, " ")
        if self.dummy_prefix and "  " not in text and text[0] != " " and text[-1] != " ":
            return True, text.split(" ")
        return False, self.pattern.findall(" " + text if self.dummy_prefix else text)

    def decode(self, ids: Iterable[int]) -> str:
        """Text of ids; control ids say nothing and the dummy prefix goes."""
        ids = list(ids)
        if len(ids) and (min(ids) < 0 or max(ids) >= self.size):
            raise ValueError("an id outside the vocabulary")
        raw = b"".join([self.bytes_of[i] for i in ids])
        return (raw[1:] if self.dummy_prefix and raw.startswith(b" ") else raw).decode("utf-8", "replace")


def groups(column: pa.Array, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in order, null as empty, in lists of about so many characters."""
    some, n = [], 0
    for text in column:
        some.append(text.as_py() or "")
        n += len(some[-1])
        if n >= chars:
            yield some
            some, n = [], 0
    if some:
        yield some


class WordCache:
    """What `make` gives for each distinct word, for the words of a task; emptied at a fixed size."""

    def __init__(self, make):
        self.make, self.known, self.chars = make, {}, 0

    def look_up(self, words: list[str]) -> list:
        found = list(map(self.known.get, words))
        if None in found:
            missing = [i for i, x in enumerate(found) if x is None]
            new = list(dict.fromkeys([words[i] for i in missing]))
            made = dict(zip(new, self.make(new), strict=True))
            for i in missing:
                found[i] = made[words[i]]
            size = sum(map(len, new))
            if len(self.known) + len(new) > CACHE_WORDS or self.chars + size > CACHE_CHARS:
                self.known, self.chars = {}, 0
            if len(new) <= CACHE_WORDS and size <= CACHE_CHARS:
                self.known.update(made)
                self.chars += size
        return found


def encode_decode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row of df.

    The ids are those of the model with an end id behind. A null text counts as empty, which is the
    end id alone; repeated rows give repeated rows; the length of a text has no limit; an empty table
    gives no rows; other columns are ignored, whatever their names. One pass, no shuffle: a text never leaves its row.
    """
    source = df.select(id_col, text_col)
    kind = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        bytes_of = codec.bytes_of

        def make(words: list[str]) -> list[tuple[bytes, bytes]]:
            made = []
            for ids in codec.encode_words(words):
                ids = ids.tolist()
                made.append((("%d " * len(ids) % tuple(ids)).encode(), b"".join([bytes_of[i] for i in ids])))
            return made

        whole, spaced = WordCache(make), WordCache(lambda words: make([" " + w for w in words]))
        tail = b"%d" % codec.end
        for batch in batches:
            count, ids, back = [], [], []
            for texts in groups(batch.column(1)):
                split = [codec.split(t) for t in texts]
                one = iter(spaced.look_up([w for behind, s in split if behind for w in s]))
                two = iter(whole.look_up([w for behind, s in split if not behind for w in s]))
                for behind, s in split:
                    found = list(islice(one if behind else two, len(s)))
                    line = b"".join([m[0] for m in found]) + tail
                    raw = b"".join([m[1] for m in found])
                    raw = raw[1:] if codec.dummy_prefix and raw.startswith(b" ") else raw
                    count.append(line.count(b" ") + 1)
                    ids.append(hashlib.sha256(line).hexdigest())
                    back.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())],
                names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return source.mapInArrow(run, out)
