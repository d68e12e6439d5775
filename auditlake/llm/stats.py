"""Statistics of one document, shared by the quality operators.

Words are runs of bytes other than the six ASCII white-space characters, which
is what ``bytes.split()`` cuts at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, texts

_SPACES = [9, 10, 11, 12, 13, 32]
_SYMBOLS = list(b"#*$%&|<>")
_ENDS = list(b".,;:?!")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features of the models, and the sign that a monotone model gives each (0: free).
FEATURES = {
    "log_words": 1, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 0, "upper_share": 0, "digit_share": 0,
    "mark_share": 0, "shout_share": -1, "other_share": 0, "short_share": 0, "line_words": 0, "byte_entropy": 0, "end_share": 0, "longest_word": 0,
}
SHAPE = ", ".join(["doc_id long", *(f"{c} long" for c in COUNTS), *(f"{f} double" for f in FEATURES)])


def repeat_words(ids: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pairs = ids[:-1] * distinct + ids[1:]
    if distinct > 2_000_000:
        _, pairs = np.unique(pairs, return_inverse=True)
    codes = pairs[:-1] * distinct + ids[2:]
    order = np.argsort(codes, kind="stable")
    ranked = codes[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    hits = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
    for shift in range(3):
        twice[hits + shift] = True
    return int(twice.sum())


def measure(text: str) -> tuple[list[int], list[float]]:
    """Counts and features of a whole text; an empty one has zeros throughout."""
    data = text.encode()
    words = data.split()
    n = len(words)
    bytes_of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    word_chars = len(text) - int(bytes_of[_SPACES].sum())
    symbols = int(bytes_of[_SYMBOLS].sum())
    seen: set[bytes] = set()
    dup = filled = 0
    for line in data.split(b"\n"):
        if line.strip(b" \t\r\x0b\x0c"):
            filled += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    index: dict[bytes, int] = {}
    number = index.setdefault
    ids = np.array([number(w, len(index)) for w in words], dtype=np.int64)
    repeats = repeat_words(ids, len(index))
    counts = [n, word_chars, symbols, dup, repeats]
    if not n:
        return counts, [0.0] * len(FEATURES)
    size = len(data)
    lengths = np.fromiter(map(len, words), np.int64, n)
    shares = bytes_of[bytes_of > 0] / size
    upper, lower = int(bytes_of[65:91].sum()), int(bytes_of[97:123].sum())
    marks = int(bytes_of[_ENDS].sum())
    features = [
        np.log1p(n), word_chars / n, symbols / word_chars, dup / filled, repeats / n, len(index) / n, upper / max(1, upper + lower), int(bytes_of[48:58].sum()) / size,
        marks / n, int(bytes_of[33]) / n, int(bytes_of[128:].sum()) / size, float((lengths <= 3).mean()), np.log1p(n / filled), float(-(shares * np.log2(shares)).sum()), int(bytes_of[46]) / n, np.log1p(int(lengths.max())),
    ]
    return counts, [float(x) for x in features]


def document_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the features of every whole text, one row per input row; null text counts as empty."""
    return arrow_map(texts(docs), _stats_batch, SHAPE)


def _stats_batch(batch: pa.RecordBatch) -> dict:
    counts, features = zip(*(measure(text) for text in batch.column("text").to_pylist()), strict=True)
    columns = dict(zip(COUNTS, map(list, zip(*counts, strict=True)), strict=True)) | dict(zip(FEATURES, map(list, zip(*features, strict=True)), strict=True))
    return {"doc_id": batch.column("doc_id")} | columns


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Rows by features, NaN where a value is null."""
    return np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in FEATURES]).astype(float)


def one_label(labels: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """doc_id and label 0/1: nulls dropped, the larger of several labels of one document taken."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    return (rows if where is None else rows.where(where)).groupBy("doc_id").agg(F.max("label").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, where: Column | None = None) -> DataFrame:
    """Text and label of at most ``most`` labelled documents, those of the smallest id hash.

    The bound makes both the broadcast of ids and the fit on the driver safe.
    """
    chosen = one_label(labels, column, where).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return texts(docs).join(F.broadcast(chosen), "doc_id")
