"""Power-of-two decomposition of documents into equal-length training buckets.

A document of n ids becomes pieces whose lengths are the binary digits of n,
largest first, with lengths above the maximum repeated.  Every piece is a whole
sequence of its bucket (the pieces of that length), so no sequence crosses two
documents and no padding is ever needed.

Ids come from the JSON tokenizer with its own settings, added tokens found in
texts included.  Its byte-level split always begins a match at the last white
space before a word and after letters that a mark or white space ends, so texts
are cut there and a chunk that comes again is looked up, whatever marks follow
it: the ids are those of the whole text, at a bounded memory.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, keep, texts

END_ID = 1
#: What the byte-level split takes for white space.
_SPACE = "\t-\r \x85\xa0  -     　"
#: Some of its letters, and ASCII marks, which are none of its letters and numbers: a match ends between the two.
_LETTER, _MARK = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-/:-@\[-`{-~"
_CHUNK = re.compile(f"[{_SPACE}]?[{_LETTER}]++(?![^{_MARK}{_SPACE}])|[{_SPACE}]?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])")
#: Chunks of each of the two generations that a worker keeps, their longest, and how many are encoded at once.
KEPT_CHUNKS, KEPT_CHARS, AT_ONCE = 150_000, 64, 256
#: Bytes of text cut at once: the chunks of a slice take many times its size.
CUT_BYTES = 1 << 20


class ChunkEncoder:
    """Ids of texts by a byte-level JSON tokenizer, as little-endian uint32 bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Ids that only a chunk's first match gives: a space or a line end leads them.
        self.leads = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.leads[[i for token, i in vocabulary.items() if token[0] in "ĠĊ"]] = True
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _ids(self, texts_: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts_, add_special_tokens=False)]

    def _learn(self, new: set[str]) -> dict[str, bytes]:
        """The ids of distinct chunks; those that a lone space or line end leads are encoded in rows."""
        rows = [c for c in new if c[0] in " \n" and len(c) > 1 and not c[1].isspace()]
        alone = list(new.difference(rows))
        known = {c: ids.tobytes() for c, ids in zip(alone, self._ids(alone), strict=True)}
        if rows:
            ids = np.concatenate(self._ids(["".join(rows[i : i + AT_ONCE]) for i in range(0, len(rows), AT_ONCE)]))
            begin = (4 * np.flatnonzero(self.leads[ids])).tolist()
            data = ids.tobytes()
            known.update((c, data[a:b]) for c, a, b in zip(rows, begin, [*begin[1:], len(data)], strict=True))
        return known

    def plain(self, texts_: list[str]) -> list[bytes]:
        """The ids of whole texts that hold no added token."""
        cut = [_CHUNK.findall(text) for text in texts_]
        every = set().union(*cut)
        if len(self.young) > KEPT_CHUNKS:
            self.old, self.young = self.young, {}
        new = every.difference(self.young)
        self.young.update((c, self.old[c]) for c in new.intersection(self.old))
        self.young.update(self._learn(new.difference(self.young)))
        out = [b"".join(map(self.young.__getitem__, chunks)) for chunks in cut]
        for chunk in new:
            if len(chunk) > KEPT_CHARS:
                del self.young[chunk]
        return out

    def encode(self, texts_: list[str]) -> list[bytes]:
        """The ids of whole texts; an added token cuts a text into parts that are texts of their own."""
        parts: list[str] = []
        shape: list[list[bytes]] = []
        for text in texts_:
            found = self.added.findall(text) if self.added else []
            parts += self.added.split(text) if found else [text]
            shape.append([self.tokenizer.token_to_id(t).to_bytes(4, "little") for t in found])
        made = iter(self.plain(parts))
        return [next(made) + b"".join([end + next(made) for end in ends]) for ends in shape]


@lru_cache(maxsize=2)
def encoder(path: str) -> ChunkEncoder:
    keep("packing", encoder.cache_clear)
    return ChunkEncoder(path)


def piece_lengths(n: int, longest: int = 2048) -> list[int]:
    """Binary digits of ``n`` as lengths, none above ``longest`` (a power of two)."""
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece has to be a power of two")
    whole, rest = divmod(n, longest)
    return [longest] * whole + [1 << bit for bit in range(longest.bit_length() - 2, -1, -1) if rest >> bit & 1]


def pack(docs: DataFrame, tokenizer_file: str, longest: int = 2048, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, doc_tokens, start, length, bucket, ids_crc32, sequence_id, offset and (on demand) ids.

    ``bucket`` is log2 of the length: rows of one bucket stack into a dense
    matrix without padding.  ``sequence_id`` is unique in a job; a piece fills
    its sequence, so ``offset`` is 0.  Null and empty texts are one end id: one
    piece of length 1.  Repeated rows and null ids are packed like any other;
    an empty table gives no pieces, and extra columns are left out.
    """

    def run(batch: pa.RecordBatch) -> dict:
        out: dict[str, list] = {k: [] for k in ("doc_id", "doc_tokens", "start", "length", "bucket", "ids_crc32", "ids")}
        end = END_ID.to_bytes(4, "little")
        encoded = encoder(tokenizer_file).encode(batch.column("text").to_pylist())
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
            data = memoryview(ids + end)
            total, start = len(data) // 4, 0
            for length in piece_lengths(total, longest):
                piece = data[4 * start : 4 * (start + length)]
                row = (doc_id, total, start, length, length.bit_length() - 1, zlib.crc32(piece), bytes(piece) if with_ids else None)
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                start += length
        return out

    pieces = arrow_map(texts(docs), run, "doc_id long, doc_tokens long, start long, length long, bucket int, ids_crc32 long, ids binary", most=CUT_BYTES, owner="packing")
    pieces = pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    return pieces if with_ids else pieces.drop("ids")


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Store pieces by bucket, so a reader takes batches of one length only."""
    pieces.write.partitionBy("bucket").parquet(path)
