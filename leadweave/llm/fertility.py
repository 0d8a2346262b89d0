"""Tokeniser fertility: characters per token, byte-fallback share and token entropy, banded by language or script.

Every text is encoded with a public SentencePiece vocabulary. Text that the vocabulary doesn't suit, or
that says the same over and over, stands out: many tokens per character, many bytes, or tokens that
tell little. Entropy is relative: that of the text's tokens divided by the most that so many tokens
(512 at most) could have, so that it doesn't follow the length; more than that counts as 1. A text outside a band of its group is rejected. The
group is the script of most of its letters, or a column with a language where one is given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leadweave.llm.flat import Texts, lines, slices, windows, words
from leadweave.llm.piece_codec import PieceCodec, WordCache

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Band:
    """What is kept: ends included."""

    chars_per_token: tuple[float, float] = (1.0, 8.0)
    byte_share: tuple[float, float] = (0.0, 0.25)
    entropy: tuple[float, float] = (0.45, 1.0)


#: By script; a language column can have its own. Scripts without many pieces of their own fall to bytes.
BANDS = {
    "latin": Band((1.3, 8.0), (0.0, 0.1), (0.6, 1.0)),
    "cyrillic": Band((1.2, 8.0), (0.0, 0.2), (0.5, 1.0)),
    "greek": Band((0.6, 8.0), (0.0, 0.6), (0.4, 1.0)),
    "other": Band((0.2, 8.0), (0.0, 1.0), (0.3, 1.0)),
}

#: Below so many tokens the shares and the entropy say little: only the known rules hold.
LEAST_TOKENS = 20
ENTROPY_TOKENS = 512


def scripts(texts: Texts) -> list[str]:
    """By the lead bytes of letters: Latin up to U+024F, Greek, Cyrillic, other."""
    data = texts.data
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    kinds = np.stack([letter | ((data >= 0xC3) & (data <= 0xC9)), (data >= 0xD0) & (data <= 0xD3), (data >= 0xCD) & (data <= 0xCF), data >= 0xD4])
    total = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(kinds, axis=1)], axis=1)[:, texts.offsets]
    return [("latin", "cyrillic", "greek", "other")[i] for i in np.diff(total, axis=1).argmax(axis=0)]


def word_counts(texts: Texts) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    found = words(texts, lower=False)
    bounds = found.bounds(n)
    begins_char = np.append(0, np.cumsum((texts.data & 0xC0) != 0x80))
    out = {"n_words": np.diff(bounds), "word_chars": np.bincount(found.row, begins_char[found.end] - begins_char[found.start], n).astype(np.int64)}
    symbols = np.append(0, np.cumsum(_SYMBOL[texts.data]))
    out["n_symbols"] = np.diff(symbols[texts.offsets])
    rows = lines(texts)
    spoken = np.searchsorted(found.start, rows.end) > np.searchsorted(found.start, rows.start)  # a word begins in it
    row, key = rows.row[spoken], rows.hash[spoken]
    order = np.lexsort((key, row))
    again = (row[order][1:] == row[order][:-1]) & (key[order][1:] == key[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=n)
    three = windows(found.hash, 3)
    at = np.flatnonzero(found.row[2:] == found.row[:-2]) if len(found.row) > 2 else np.zeros(0, np.int64)
    order = at[np.lexsort((three[at], found.row[at]))]
    same = (three[order][1:] == three[order][:-1]) & (found.row[order][1:] == found.row[order][:-1])
    twice = np.zeros(len(found.row) + 2, bool)
    often = np.unique(np.concatenate([order[1:][same], order[:-1][same]]))
    for step in range(3):
        twice[often + step] = True
    out["n_repeat_words"] = np.bincount(found.row[twice[: len(found.row)]], minlength=n)
    return out


def measure(df: DataFrame, model: str, bands: dict[str, Band] | None = None, group_col: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of df: id, word counts, base_failed, kept, n_tokens, chars_per_token, byte_share, entropy, script.

    base_failed: fewer than 50 words, or more than half of them in repeated 3-word windows. kept: not
    base_failed, and within the bands of its group; a group without bands has those of "other". A null
    text counts as empty: no words, failed. Repeated rows come back each; a text has no limit; an empty
    table gives no rows; other columns are ignored, whatever their names. One pass, no shuffle.
    """
    bands = BANDS if bands is None else bands
    columns = [id_col, text_col, *([group_col] if group_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        make = lambda words: [x.astype(np.uint16 if codec.size <= 65536 else np.int32).tobytes() for x in codec.encode_words(words)]
        whole, spaced = WordCache(make), WordCache(lambda words: make([" " + w for w in words]))
        kind = np.uint16 if codec.size <= 65536 else np.int32
        for batch in batches:
            for lo, hi, texts in slices(batch.column(1)):
                counts = word_counts(texts)
                group = [g or "other" for g in batch.column(2).slice(lo, hi - lo).to_pylist()] if group_col else scripts(texts)
                plain = [t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()]
                split = [codec.split(t) for t in plain]
                one = iter(spaced.look_up([w for behind, s in split if behind for w in s]))
                two = iter(whole.look_up([w for behind, s in split if not behind for w in s]))
                size, per_token, share, entropy = [], [], [], []
                for t, (behind, s) in zip(plain, split, strict=True):
                    ids = np.frombuffer(b"".join(islice(one if behind else two, len(s))), kind)
                    k = len(ids)
                    times = np.bincount(ids)
                    p = times[times > 0] / max(1, k)
                    size.append(k)
                    per_token.append(len(t) / k if k else 0.0)
                    share.append(float(codec.is_byte[ids].mean()) if k else 0.0)
                    entropy.append(min(1.0, float(-(p * np.log2(p)).sum() / np.log2(min(k, ENTROPY_TOKENS)))) if k > 1 else 0.0)
                failed = (counts["n_words"] < 50) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                inside = []
                for g, k, *values in zip(group, size, per_token, share, entropy, strict=True):
                    band = bands.get(g) or bands.get("other") or Band()
                    limits = (band.chars_per_token, band.byte_share, band.entropy)
                    inside.append(k < LEAST_TOKENS or all(a <= v <= b for v, (a, b) in zip(values, limits, strict=True)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(counts[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(~failed & np.array(inside, bool)),
                     pa.array(size, pa.int64()), *(pa.array(x, pa.float64()) for x in (per_token, share, entropy)), pa.array(group, pa.string())],
                    names=[id_col, *counts, "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "script"],
                )

    schema = (
        f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint,"
        " base_failed boolean, kept boolean, n_tokens bigint, chars_per_token double, byte_share double, entropy double, script string"
    )
    return df.select(*columns).mapInArrow(run, schema)
