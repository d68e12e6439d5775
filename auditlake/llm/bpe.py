"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The split pattern always starts a new match at a single space that stands
between two characters that are not white space, so a long text is cut there
and its parts are encoded on their own: the ids are those of the whole text,
while the working memory stays that of one part.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, texts

_SAFE = re.compile(r"(?<=\S) (?=\S)")
#: Texts longer than this many characters are cut at the next safe space.
PART_CHARS = 1 << 16


@lru_cache(maxsize=4)
def encoder(rank_file: str):
    import public_tokenizers
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local-ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, part_chars: int = PART_CHARS) -> list[str]:
    """The text cut before safe spaces into parts of about ``part_chars``; joined they are the text."""
    parts, at = [], 0
    while len(text) - at > part_chars and (space := _SAFE.search(text, at + part_chars)):
        parts.append(text[at : space.start()])
        at = space.start()
    return [*parts, text[at:]]


def encode_text(text: str, rank_file: str) -> np.ndarray:
    """uint32 ids of one text, special strings taken as ordinary text."""
    found = encoder(rank_file)
    if len(text) <= PART_CHARS:
        return np.array(found.encode_to_numpy(text, disallowed_special=()))
    return np.concatenate([found.encode_to_numpy(part, disallowed_special=()) for part in safe_parts(text)])


@lru_cache(maxsize=4)
def _tables(rank_file: str) -> tuple[list[bytes], list[str]]:
    """Bytes and decimal text of every id."""
    found = encoder(rank_file)
    raw = [b""] * found.n_vocab
    for token, rank in found._mergeable_ranks.items():
        raw[rank] = token
    return raw, [str(i) for i in range(found.n_vocab)]


def encode(docs: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, ids (array of int) of every whole text; null texts count as empty.

    One row per input row, repeated rows included; an empty table gives an
    empty table.
    """

    def run(batch: pa.RecordBatch) -> dict:
        found = [encode_text(text, rank_file) for text in batch.column("text").to_pylist()]
        ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
        flat = np.concatenate(found).astype(np.int32) if found else np.empty(0, np.int32)
        return {"doc_id": batch.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))}

    return arrow_map(texts(docs), run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """doc_id, text_bytes (binary): the raw bytes of ``ids``; null lists count as empty."""

    def run(batches):
        raw = _tables(rank_file)[0]
        for batch in batches:
            made = [b"".join([raw[i] for i in ids or ()]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "text_bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, rank_file: str) -> DataFrame:
    """Token count and digests of ids and of the decoded bytes of every text.

    Null text: that of the empty text (0 tokens).  Null doc_id: kept as null.
    Repeated rows: one result each.
    """

    def run(batch: pa.RecordBatch) -> dict:
        raw, decimal = _tables(rank_file)
        lengths, ids_sha, text_sha = [], [], []
        for text in batch.column("text").to_pylist():
            ids = encode_text(text, rank_file).tolist()
            lengths.append(len(ids))
            ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
            text_sha.append(hashlib.sha256(b"".join(map(raw.__getitem__, ids))).hexdigest())
        return {"doc_id": batch.column("doc_id"), "n_tokens": lengths, "ids_sha256": ids_sha, "decoded_sha256": text_sha}

    return arrow_map(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
