"""Suffix-array deduplication of passages.

Texts are kept in blocks of bounded size.  Every 50-byte window is filed under
the smallest hash of the 24-byte strings inside it, so equal windows meet in one
task wherever they stand.  A first round finds the keys that occur in two blocks
or documents; only strings under such keys go on, each distinct one once a
block.  There a suffix array is built by two-stage sorting, adjacent common
prefixes show the equal windows, and those also found in a smaller document are
removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, give_back, keep, stored, trimmed

GRAM = 24
BLOCK_BYTES = 2 << 20
NO_ID = np.iinfo(np.int64).max
#: Windows whose keys are computed at once.
KEYS_AT_ONCE = 1 << 17


# ---- suffix array ---------------------------------------------------------


def _words(data: np.ndarray, kind: str = ">u8") -> np.ndarray:
    """The eight bytes from every position on as one number; zeros follow the end."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    out = np.empty(n, np.uint64)
    for o in range(min(8, n)):
        count = len(range(o, n, 8))
        out[o::8] = padded[o : o + 8 * count].view(kind)
    return out


def _at(words: np.ndarray, where: np.ndarray) -> np.ndarray:
    return np.where(where < len(words), words[np.minimum(where, len(words) - 1)], 0)


def _sort_directly(words: np.ndarray, where: np.ndarray, depth: int) -> np.ndarray:
    """``where`` by the first ``depth`` bytes from each position: eight bytes at a time, ties only."""
    if not len(where):
        return where
    first = words[where]
    order = np.argsort(first, kind="stable")
    where, first = where[order], first[order]
    new = np.concatenate([[True], first[1:] != first[:-1]])
    for offset in range(8, depth, 8):
        tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
        if not len(tied):
            break
        group = np.cumsum(new)[tied]
        after = _at(words, where[tied] + offset)
        order = np.lexsort((after, group))
        after = after[order]
        where[tied] = where[tied][order]
        new[tied] = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
    return where


def suffix_array(data: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``data`` (uint8) in order of their first ``depth`` bytes at least.

    Only suffixes smaller than their successor are sorted directly.  The others
    follow by one scan over the buckets of first bytes: reading the array from
    the left, the predecessor of each suffix read, if it is a larger kind, takes
    the next free place of its own bucket.
    """
    n = len(data)
    if n < 2:
        return np.arange(n)
    kind = np.int32 if n < 1 << 31 else np.int64
    step = np.concatenate([np.sign(data[1:].astype(np.int16) - data[:-1]).astype(np.int8), np.array([-1], np.int8)])
    decided = np.arange(n, dtype=kind)
    decided[step == 0] = n - 1
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    small = step[decided] > 0
    del step, decided
    ordered = _sort_directly(_words(data), np.flatnonzero(small), depth)
    cuts = np.searchsorted(data[ordered], np.arange(257))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    induced[data[-1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def induce(read: np.ndarray) -> None:
        before = read[read > 0] - 1
        before = before[~small[before]]
        if not len(before):
            return
        first = data[before]
        order = np.argsort(first, kind="stable")
        before, first = before[order], first[order]
        edges = np.flatnonzero(np.concatenate([[True], first[1:] != first[:-1]]))
        for begin, end in zip(edges, [*edges[1:], len(first)], strict=True):
            induced[first[begin]].append(before[begin:end])

    for byte in range(256):
        wave = 0
        while wave < len(induced[byte]):  # a run of one byte adds to its own bucket
            induce(induced[byte][wave])
            wave += 1
        out += induced[byte]
        part = ordered[cuts[byte] : cuts[byte + 1]]
        if len(part):
            induce(part)
            out.append(part)
    return np.concatenate(out)


def common_prefixes(data: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it, up to ``depth`` (0 for the first)."""
    words = _words(data)
    here, before = order[1:], order[:-1]
    out = np.zeros(len(order), np.int64)
    open_ = np.arange(len(here))
    for offset in range(0, depth, 8):
        differ = _at(words, here[open_] + offset) ^ _at(words, before[open_] + offset)
        out[open_ + 1] += sum((differ < np.uint64(1 << 8 * k)).astype(np.int64) for k in range(8))
        open_ = open_[differ == 0]
        if not len(open_):
            break
    room = len(data) - np.maximum(here, before)
    out[1:] = np.minimum(np.minimum(out[1:], depth), room)
    return out


def repeated_windows(strings: list[bytes], ids: np.ndarray, length: int) -> list[np.ndarray]:
    """For each string, which of its windows also occur in a string with a smaller id."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    ends = np.cumsum(sizes)
    order = suffix_array(data, length)
    group = np.cumsum(common_prefixes(data, order, length) < length)
    owner = np.repeat(np.arange(len(strings)), sizes)[order]
    inside = order + length <= ends[owner]
    order, group, owner = order[inside], group[inside], owner[inside]
    removed = np.zeros(len(data), bool)
    if len(order):
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        least = np.minimum.reduceat(ids[owner], starts)
        removed[order] = np.repeat(least, np.diff(np.append(starts, len(order)))) < ids[owner]
    return [removed[e - s : e - length + 1] for s, e in zip(sizes, ends, strict=True)]


# ---- window keys ----------------------------------------------------------


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` values from each position on; shorter by width - 1."""
    span = 1
    while 2 * span <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    return np.minimum(values[: len(values) - (width - span)], values[width - span :]) if span < width else values


def _window_keys(raw: np.ndarray, length: int) -> np.ndarray:
    """The smallest hash of the strings of ``GRAM`` bytes in each window."""
    words = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    gram = words[: len(raw) - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    for offset in range(8, GRAM, 8):
        gram ^= gram >> np.uint64(29)
        gram += words[offset : offset + len(gram)]
        gram *= np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    return _slide(gram, length - GRAM + 1)


class Runs:
    """Maximal runs of windows of one block that share document and key: windows first to last."""

    def __init__(self, data: bytes, ends: np.ndarray, length: int):
        raw = np.frombuffer(data, np.uint8)
        n = len(raw)
        self.first = self.last = self.doc = np.empty(0, np.int64)
        self.key = np.empty(0, np.uint64)
        if n < length:
            return
        key = np.empty(n - length + 1, np.uint64)  # the only array of eight bytes a byte of text
        for at in range(0, len(key), KEYS_AT_ONCE):
            to = min(at + KEYS_AT_ONCE, len(key))
            key[at:to] = _window_keys(raw[at : to + length - 1], length)
        starts = np.concatenate([[0], ends[:-1]])
        edge = np.zeros(n + 1, np.int32)
        fits = ends - starts >= length
        np.add.at(edge, starts[fits], 1)
        np.add.at(edge, ends[fits] - length + 1, -1)
        valid = np.cumsum(edge, out=edge)[: len(key)] > 0
        del edge
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (valid[1:] != valid[:-1])
        new[starts[starts < len(key)]] = True
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        keep = valid[first]
        self.first, self.last, self.key = first[keep], last[keep], key[first[keep]]
        self.doc = np.searchsorted(ends, self.first, side="right")


def _distinct_keys(runs: Runs, ids: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of a block by bucket and key, their buckets, and whether two ids of the block have them."""
    owner = ids[runs.doc]
    order = np.lexsort((owner, runs.key))
    key, owner = runs.key[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    last = np.append(first[1:], len(key)) - 1 if len(key) else first
    several = owner[first] != owner[last] if len(key) else np.empty(0, bool)
    key = key[first]
    bucket = (key & np.uint64(0xFFFFFF)).astype(np.int64) % buckets
    order = np.lexsort((key, bucket))
    return key[order], bucket[order], several[order]


def _shared_runs(runs: Runs, ids: np.ndarray, buckets: int, bits: list[dict]) -> np.ndarray:
    """Indexes of the runs whose key occurs in two documents, by what the first round said."""
    key, bucket, shared = _distinct_keys(runs, ids, buckets)
    for part in bits:
        begin, end = np.searchsorted(bucket, [part["bucket"], part["bucket"] + 1])
        shared[begin:end] |= np.unpackbits(np.frombuffer(part["bits"], np.uint8), count=end - begin).astype(bool)
    wanted = np.sort(key[shared])
    if not len(wanted):
        return np.empty(0, np.int64)
    found = wanted[np.minimum(np.searchsorted(wanted, runs.key), len(wanted) - 1)] == runs.key
    return np.flatnonzero(found)


class Entries:
    """Distinct strings of a block's shared runs: key, text and smallest id, numbered by bucket."""

    def __init__(self, data: bytes, runs: Runs, chosen: np.ndarray, ids: np.ndarray, length: int, buckets: int):
        self.number: dict[bytes, int] = {}
        self.of_run = np.empty(len(chosen), np.int64)
        number = self.number
        for at, (a, b) in enumerate(zip(runs.first[chosen].tolist(), (runs.last[chosen] + length).tolist(), strict=True)):
            self.of_run[at] = number.setdefault(data[a:b], len(number))
        count = len(number)
        self.least = np.full(count, NO_ID)
        np.minimum.at(self.least, self.of_run, ids[runs.doc[chosen]])
        self.key = np.empty(count, np.uint64)
        self.key[self.of_run] = runs.key[chosen]
        self.bucket = (self.key & np.uint64(0xFFFFFF)).astype(np.int64) % buckets
        self.strings = list(number)


# ---- blocks and rounds ----------------------------------------------------


def _pack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(data)


def _unpack(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31)


def _blocks(docs: DataFrame, rest: list[str]) -> DataFrame:
    """Documents gathered into compressed blocks; columns in ``rest``, and whether the text is null, ride along as an Arrow stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, serial = TaskContext.get().partitionId(), 0
        ids: list[int] = []
        parts: list[bytes] = []
        beside: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts]).astype("<i8")
            row = (task << 24 | serial, np.array(ids, "<i8").tobytes(), ends.tobytes(), _pack(b"".join(parts)), _pack(_stream(beside)) if rest else b"")
            return _batch([row], [("block", pa.int64()), *((c, pa.binary()) for c in ("ids", "ends", "data", "rest"))])

        for batch in batches:
            begin = 0
            columns = batch.select([f"r{i}" for i in range(len(rest) + bool(rest))])
            for at, (doc_id, text) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)):
                ids.append(NO_ID if doc_id is None else doc_id)
                parts.append(text.as_buffer().to_pybytes())
                size += len(parts[-1])
                if size >= BLOCK_BYTES:
                    beside.append(columns.slice(begin, at + 1 - begin))
                    yield block()
                    ids, parts, beside, size, serial, begin = [], [], [], 0, serial + 1, at + 1
            beside.append(columns.slice(begin))
        if ids:
            yield block()

    beside = [F.col(f"`{c}`").alias(f"r{i}") for i, c in enumerate(rest)] + [F.col("text").isNull().alias(f"r{len(rest)}")] * bool(rest)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *beside)
    return stored(rows.mapInArrow(trimmed(run), "block long, ids binary, ends binary, data binary, rest binary"), "suffix-blocks")


def _stream(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes, dict]]:
    for row in batch.to_pylist():
        yield row["block"], np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["ends"], "<i8"), _unpack(row["data"]), row


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, int, int]]:
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
    for begin, end in zip(edges, [*edges[1:], len(bucket)] if len(bucket) else [], strict=True):
        yield int(bucket[begin]), int(begin), int(end)


def _rounds(docs: DataFrame, length: int, finish, shape, rest: list[str] | None = None) -> DataFrame:
    if length < GRAM + 1:
        raise ValueError(f"windows have to be longer than {GRAM} bytes")
    spark = docs.sparkSession
    bounded(spark)
    blocks = _blocks(docs, rest or [])
    # As many buckets as blocks: a bucket holds about one block's share, however large the corpus is.
    buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks.select("block").count()), 1 << 23)

    def keys(batches):
        for batch in batches:
            for block, ids, ends, data, _ in _open(batch):
                key, bucket, _ = _distinct_keys(Runs(data, ends, length), ids, buckets)
                rest = key >> np.uint64(24)
                rows = [(b, block, (rest[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (rest[i:j] >> np.uint64(32)).astype(np.uint8).tobytes()) for b, i, j in _by_bucket(bucket)]
                yield _batch(rows, [("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary())])

    def meet(table: pa.Table) -> pa.Table:
        packed = table.column("keys").to_pylist()
        found = []
        for raw in packed:
            n = len(raw) // 5
            found.append(np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.uint64) << np.uint64(32))
        every = np.sort(np.concatenate(found))
        twice = np.unique(every[1:][every[1:] == every[:-1]])
        rows = []
        for block, own in zip(table.column("block").to_pylist(), found, strict=True):
            hit = np.isin(own, twice, assume_unique=True)
            if hit.any():
                rows.append((block, table.column("bucket")[0].as_py(), np.packbits(hit).tobytes()))
        keep("groups", give_back)
        return pa.Table.from_batches([_batch(rows, [("block", pa.int64()), ("bucket", pa.int64()), ("bits", pa.binary())])])

    met = blocks.select("block", "ids", "ends", "data").mapInArrow(trimmed(keys), "bucket long, block long, keys binary").groupBy("bucket").applyInArrow(meet, "block long, bucket long, bits binary")
    bits = stored(met.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("bits")), "suffix-bits")

    def strings(batches):
        for batch in batches:
            for block, ids, ends, data, row in _open(batch):
                runs = Runs(data, ends, length)
                found = Entries(data, runs, _shared_runs(runs, ids, buckets, row["bits"] or []), ids, length, buckets)
                order = np.argsort(found.bucket, kind="stable")
                rows = []
                for b, i, j in _by_bucket(found.bucket[order]):
                    mine = order[i:j]
                    texts = [found.strings[m] for m in mine]
                    sizes = np.fromiter(map(len, texts), "<u4", len(texts))
                    rows.append((b, block, mine.astype("<u4").tobytes(), (found.key[mine] >> np.uint64(24)).astype("<u4").tobytes(), found.least[mine].astype("<i8").tobytes(), sizes.tobytes(), _pack(b"".join(texts))))
                yield _batch(rows, [("bucket", pa.int64()), ("block", pa.int64()), *((c, pa.binary()) for c in ("entry", "key", "least", "sizes", "strings"))])

    def suffix_stage(table: pa.Table) -> pa.Table:
        least: dict[bytes, int] = {}
        key_of: dict[bytes, int] = {}
        opened = []
        for row in table.to_pylist():
            ends = np.cumsum(np.frombuffer(row["sizes"], "<u4"), dtype=np.int64).tolist()
            data = _unpack(row["strings"])
            own = [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]
            ids = np.frombuffer(row["least"], "<i8")
            opened.append((row["block"], np.frombuffer(row["entry"], "<u4"), own, ids))
            for text, key, number in zip(own, np.frombuffer(row["key"], "<u4").tolist(), ids.tolist(), strict=True):
                if number < least.get(text, number + 1):
                    least[text] = number
                key_of[text] = key
        # A string that is alone under its key has no equal window anywhere.
        shared: dict[int, list[bytes]] = {}
        for text, key in key_of.items():
            shared.setdefault(key, []).append(text)
        sorted_ = [text for group in shared.values() if len(group) > 1 for text in group]
        masks = dict(zip(sorted_, repeated_windows(sorted_, np.array([least[t] for t in sorted_], np.int64), length), strict=True)) if sorted_ else {}
        rows = []
        for block, entry, own, ids in opened:
            out: list[tuple[int, int, int]] = []
            for number, text, doc_id in zip(entry.tolist(), own, ids.tolist(), strict=True):
                if doc_id > least[text]:
                    out.append((number, 0, len(text) - length + 1))
                elif text in masks and masks[text].any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], masks[text].view(np.int8), [0]])))
                    out += [(number, a, b - a) for a, b in edge.reshape(-1, 2).tolist()]
            if out:
                rows.append((block, np.array(out, "<i8").tobytes()))
        keep("groups", give_back)
        return pa.Table.from_batches([_batch(rows, [("block", pa.int64()), ("removed", pa.binary())])])

    with_bits = blocks.join(bits, "block", "left")
    found = with_bits.drop("rest").mapInArrow(trimmed(strings), "bucket long, block long, entry binary, key binary, least binary, sizes binary, strings binary")
    removed = found.groupBy("bucket").applyInArrow(suffix_stage, "block long, removed binary").groupBy("block").agg(F.collect_list("removed").alias("removed"))

    def gone(ids, ends, data, row):
        runs = Runs(data, ends, length)
        chosen = _shared_runs(runs, ids, buckets, row["bits"] or [])
        entries = Entries(data, runs, chosen, ids, length, buckets)
        edge = np.zeros(len(data) + 1, np.int32)
        # What a smaller document of the same block has is removed outright.
        later = chosen[ids[runs.doc[chosen]] > entries.least[entries.of_run]]
        np.add.at(edge, runs.first[later], 1)
        np.add.at(edge, runs.last[later] + length, -1)
        told = np.concatenate([np.frombuffer(r, "<i8").reshape(-1, 3) for r in row["removed"]]) if row["removed"] else np.empty((0, 3), np.int64)
        told = told[np.argsort(told[:, 0], kind="stable")]
        lo, hi = np.searchsorted(told[:, 0], entries.of_run, side="left"), np.searchsorted(told[:, 0], entries.of_run, side="right")
        many = hi - lo
        pick = np.repeat(lo - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else np.empty(0, np.int64)
        begin = np.repeat(runs.first[chosen], many) + told[pick, 1]
        np.add.at(edge, begin, 1)
        np.add.at(edge, begin + told[pick, 2] + length - 1, -1)
        return np.cumsum(edge, out=edge)[: len(data)] > 0

    def apply(batches):
        for batch in batches:
            for _, ids, ends, data, row in _open(batch):
                yield from finish(ids, ends, data, gone(ids, ends, data, row), row["rest"])

    return with_bits.join(removed, "block", "left").mapInArrow(trimmed(apply), shape)


def _batch(rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    made = zip(*rows, strict=True) if rows else ((),) * len(columns)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, (_, kind) in zip(made, columns, strict=True)], [name for name, _ in columns])


def _per_document(ids, ends, data, gone):
    """(id, whole bytes, removal mask) of each document of a block."""
    at = 0
    for number, end in zip(ids.tolist(), ends.tolist(), strict=True):
        yield (None if number == NO_ID else number), data[at:end], gone[at:end]
        at = end


def removed_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte goes if a string of ``length`` bytes over it also starts in a
    document with a smaller doc_id; matches stay within documents and are
    judged on the input.  Null text is empty.  Rows that repeat a doc_id do not
    remove from each other.  A null doc_id counts as larger than all others.
    Texts shorter than ``length`` lose nothing.  Other columns are left out; an
    empty table gives an empty one.  One row per input row.
    """

    def finish(ids, ends, data, gone, _):
        rows = []
        for number, raw, mask in _per_document(ids, ends, data, gone):
            edges = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if len(mask) else 0
            kept = np.frombuffer(raw, np.uint8)[~mask].tobytes() if edges else raw
            rows.append((number, len(raw), int(mask.sum()), edges, hashlib.sha256(kept).hexdigest()))
        yield _batch(rows, [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    return _rounds(docs, length, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_passages(docs: DataFrame, length: int = 50) -> DataFrame:
    """The rows of ``docs``, all columns kept, with repeated passages cut from ``text``.

    As ``removed_passages``, but only characters all of whose bytes go are cut,
    so texts stay valid.  Null texts stay null, and a text that is removed
    altogether becomes empty.  An empty table stays empty.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = docs.columns
    rest = [c for c in names if c != "text"]
    shape = docs.schema

    def finish(ids, ends, data, gone, packed):
        texts = []
        for _, raw, mask in _per_document(ids, ends, data, gone):
            if mask.any():
                values = np.frombuffer(raw, np.uint8)
                lead = np.flatnonzero((values & 0xC0) != 0x80)
                whole = np.logical_and.reduceat(mask, lead)
                raw = values[~np.repeat(whole, np.diff(np.append(lead, len(values))))].tobytes()
            texts.append(raw.decode())
        beside = pa.ipc.open_stream(_unpack(packed)).read_all().combine_chunks()
        was_null = beside.column(f"r{len(rest)}").to_pylist()
        columns = {c: beside.column(f"r{i}") for i, c in enumerate(rest)} | {"text": pa.array([None if n else t for t, n in zip(texts, was_null, strict=True)], pa.string())}
        target = to_arrow_schema(shape)
        yield from pa.table([columns[c].cast(target.field(c).type) for c in names], schema=target).combine_chunks().to_batches()

    return _rounds(docs, length, finish, shape, rest)
