"""WARC archives of pages, and the merge of their indexes into capture histories.

``write_archives`` stores one record per page (a response, or a revisit of the
response with the same payload) in gzip WARC files through Spark's own writer,
so any store Spark can write to will do.  Within each file the records are
sorted by URL key and time: each file's index is a locally sorted capture run.
``read_archives`` parses the files back, and ``merge_runs`` brings the runs into
one global order: key ranges are dealt to tasks, and within a task the sorted
fragments of all runs meet in a loser tree.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separates records; the WARC format ends each record with it.
_END = "\r\n\r\n"
#: Rows of an index range that one task merges, about.
RANGE_ROWS = 200_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 SHA-1: eight groups of five hex digits are four base32 digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def url_key(url: Column) -> Column:
    """Sort-friendly key: host labels reversed and joined by commas, then path and query, in lower case."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, r"^([^/?]*)", 1), r"^www\.|:[0-9]+$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _prepared(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    page = F.col("page_id").cast("long")
    return pages.select(
        page.alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        payload.alias("payload"),
        base32_sha1(payload).alias("digest"),
        F.octet_length(payload).cast("long").alias("n_bytes"),
        url_key(F.col("url").cast("string")).alias("key"),
        F.date_format(F.timestamp_seconds(F.coalesce(page, F.lit(0)) % 4_000_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
    )


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> None:
    """One record per row of ``pages`` (page_id, url, html) as gzip WARC files under ``path``.

    Of rows with equal payloads of at least ``min_revisit_bytes`` the one with
    the largest page_id is the response and the others revisit it; rows that
    repeat that page_id are responses too.  Null html is an empty payload, null
    url an empty one; a null page_id never is a response that others refer to
    unless its whole group has none.  The capture time is page_id seconds after
    the epoch, for the table has no time of its own.
    """
    rows = _prepared(pages)
    newest = rows.groupBy("digest").agg(F.max("page_id").alias("newest")).hint("shuffle_hash")
    rows = rows.join(newest, "digest", "left")
    revisit = (F.col("n_bytes") >= min_revisit_bytes) & ~F.col("page_id").eqNullSafe(F.col("newest"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    response = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(_END))
    body = F.when(revisit, F.lit("HTTP/1.1 200 OK" + _END).cast("binary")).otherwise(F.concat(response.cast("binary"), F.col("payload")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Date", F.col("stamp")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("newest").cast("string"), F.lit(">"))), line("X-Payload-Length", F.col("n_bytes").cast("string")))).otherwise(""),
        line("X-Url-Key", F.regexp_replace("key", r"[\r\n]", "")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("body").cast("string")),
        F.lit("\r\n"),
    )
    record = F.concat(head.cast("binary"), F.col("body")).cast("string")
    records = rows.withColumn("body", body).sortWithinPartitions("key", "stamp", "page_id").select(record.alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", 50_000).text(path)


def parse_records(stream: io.BufferedIOBase) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked stream, headers by lower-case name, content block) of each record."""
    offset = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {offset}")
        used, headers = len(first), {}
        while (raw := stream.readline()) not in (b"\r\n", b""):
            name, _, value = raw.decode().partition(":")
            headers[name.lower()] = value.strip(" \r\n")
            used += len(raw)
        length = int(headers["content-length"])
        block = stream.read(length)
        if len(block) != length or stream.read(4) != _END.encode():
            raise ValueError(f"the record at byte {offset} is cut short")
        yield offset, headers, block
        offset += used + 2 + length + 4


def _number(text: str | None) -> int | None:
    digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One index row per record of the archives under ``path``, with its payload's size and digest.

    A response's digest and size are computed from the bytes read; a revisit
    has those that its header states.  Columns: run (archive name), run_seq, key, stamp,
    page_id, payload_bytes, payload_digest, record_type, refers_to, offset,
    record_bytes.  A damaged archive raises ValueError.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["run", "run_seq", "key", "stamp", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "offset", "record_bytes"]

        def frame(rows: list[tuple]) -> pd.DataFrame:
            made = pd.DataFrame(rows, columns=names)
            return made.astype({"page_id": "Int64", "refers_to": "Int64"})

        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                rows: list[tuple] = []
                archive = name.rpartition("/")[2]
                for seq, (offset, headers, block) in enumerate(parse_records(gzip.GzipFile(fileobj=io.BytesIO(content)))):
                    payload = block.partition(_END.encode())[2]
                    response = headers["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else headers["warc-payload-digest"].removeprefix("sha1:")
                    if response and headers["warc-payload-digest"] != f"sha1:{digest}":
                        raise ValueError(f"the payload at byte {offset} of {archive} has another digest")
                    size = len(payload) if response else int(headers["x-payload-length"])
                    rows.append((archive, seq, headers["x-url-key"], headers["warc-date"], _number(headers["warc-record-id"]), size, digest, headers["warc-type"], _number(headers.get("warc-refers-to")), offset, len(block)))
                    if len(rows) >= 10_000:
                        yield frame(rows)
                        rows = []
                if rows:
                    yield frame(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    shape = "run string, run_seq long, key string, stamp string, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, offset long, record_bytes long"
    return files.mapInPandas(run, shape)


class LoserTree:
    """K-way merge of sorted lists: each inner node keeps the loser, so a step costs one path to the root."""

    _DONE = object()

    def __init__(self, runs: list[list[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(runs))
        self.heads = [next(r, self._DONE) for r in self.runs] or [self._DONE]
        self.losers = [-1] * self.k
        self.winner = self._play(1) if self.k > 1 else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is self._DONE or y is self._DONE:
            return x is not self._DONE
        return (x, a) < (y, b)

    def _play(self, node: int) -> int:
        """Winner below ``node``; leaves are numbered k to 2k - 1."""
        if node >= self.k:
            return node - self.k
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._less(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def __iter__(self) -> Iterator[tuple]:
        while (head := self.heads[self.winner]) is not self._DONE:
            yield head
            at = self.winner
            self.heads[at] = next(self.runs[at], self._DONE)
            node = (at + self.k) // 2
            while node:
                if self._less(self.losers[node], at):
                    self.losers[node], at = at, self.losers[node]
                node //= 2
            self.winner = at


def merge_runs(index: DataFrame) -> DataFrame:
    """The index in global order of (key, stamp, page_id): ``range_no`` and, within it, ``range_seq``.

    The whole triple is the range key, so a URL that holds a third of all
    captures is spread over many tasks.  Rows that repeat are all kept.  A task
    holds one range (about ``RANGE_ROWS`` rows) and gives each run's fragment to
    one leaf of the loser tree.
    """
    spark = index.sparkSession
    columns = index.columns
    order = [columns.index(c) for c in ("key", "stamp", "page_id", "run_seq")]
    run_at = columns.index("run")

    def merge(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[str, list[tuple]] = {}
        for part in parts:
            part = part.astype(object).where(part.notna(), None)
            for row in part.itertuples(index=False, name=None):
                triple = tuple((row[i] is not None, row[i]) for i in order)
                runs.setdefault(row[run_at], []).append((triple, row))
        rows: list[tuple] = []
        seq = 0
        for _, row in LoserTree([runs[name] for name in sorted(runs)]):
            rows.append((*row, seq))
            seq += 1
            if len(rows) >= 10_000:
                yield frame(rows)
                rows = []
        if rows:
            yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*columns, "range_seq"]).astype({"page_id": "Int64", "refers_to": "Int64"})

    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-index.count() // RANGE_ROWS))
    dealt = index.repartitionByRange(ranges, "key", "stamp", "page_id").sortWithinPartitions("run", "run_seq")
    merged = dealt.mapInPandas(merge, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in index.schema) + ", range_seq long")
    return merged.withColumn("range_no", F.spark_partition_id())


def capture_histories(pages: DataFrame, path: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archives, read them back and merge their runs; an empty table gives an empty history."""
    from .common import stored

    write_archives(pages, path, min_revisit_bytes)
    return merge_runs(stored(read_archives(pages.sparkSession, path), "warc-index"))
