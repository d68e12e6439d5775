"""Distinct word shingles of many texts at once, as sorted 64-bit tokens."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

_MULTIPLY, _SPREAD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Longer words are hashed by one call each.
LONG_WORD = 512


def mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * _MULTIPLY
    return values ^ (values >> np.uint64(29))


def word_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time; ``data`` has eight bytes to spare at its end."""
    eights = np.ndarray(len(data) - 7, "<u8", data, 0, (1,))
    out = lengths.astype(np.uint64) * _SPREAD
    which = np.flatnonzero(lengths <= LONG_WORD)
    at, left = starts[which], lengths[which]
    while len(which):
        chunk = eights[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short] * 8).astype(np.uint64)) - np.uint64(1)
        out[which] = mix(out[which] ^ chunk) * _SPREAD
        more = np.flatnonzero(left > 8)
        which, at, left = which[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : starts[i] + lengths[i]])
    return out


class Sets:
    """The shingle sets of a text column: ``tokens`` (sorted and distinct by row) and the rows' ``ends``."""

    def __init__(self, texts: pa.Array, words: int):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        rows = offsets - offsets[0]
        data = np.zeros(len(raw) + 8, np.uint8)
        np.take(_LOWER, raw, out=data[: len(raw)])
        inside = ~_SPACE[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[rows] = True
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:-1]
        last[:-1] &= ~inside[1:] | edge[1:-1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        hashes = word_hashes(data, starts, stops - starts)
        cuts = np.searchsorted(starts, rows)
        many = np.diff(cuts)
        # A row of fewer words than a shingle is one shingle of all its words.
        total = hashes + np.minimum(np.repeat(many, many), words).astype(np.uint64)
        place = np.arange(len(hashes)) - np.repeat(cuts[:-1], many)
        width = np.minimum(np.repeat(many, many), words)
        for j in range(1, words):
            wide = np.flatnonzero(width[: len(total) - j] > j)
            total[wide] = mix(total[wide]) + hashes[np.minimum(wide + j, len(hashes) - 1)]
        tokens = mix(total)[place <= np.repeat(np.maximum(many - words, 0), many)]
        sizes = np.where(many, np.maximum(many - words, 0) + 1, 0)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            if b - a > 1:
                tokens[a:b].sort()
        keep = np.ones(len(tokens), bool)
        keep[1:] = tokens[1:] != tokens[:-1]
        keep[begins[begins < len(tokens)]] = True
        self.tokens = tokens[keep]
        kept = np.concatenate([[0], np.cumsum(keep)])
        self.begins, self.ends = kept[begins], kept[ends]
        self.sizes = self.ends - self.begins

    def __len__(self) -> int:
        return len(self.sizes)

    def __getitem__(self, row: int) -> np.ndarray:
        return self.tokens[self.begins[row] : self.ends[row]]

    def keys(self) -> list[bytes | None]:
        """A digest of each set, None for empty ones."""
        return [hashlib.blake2b(self[i].tobytes(), digest_size=16).digest() if n else None for i, n in enumerate(self.sizes.tolist())]
