"""Helpers shared by the operators: shared scratch space and Arrow mapping."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of text handled at once inside a Python worker.
SLICE_ROWS, SLICE_BYTES = 2000, 4 << 20
#: Bytes, about, that Spark sends a Python worker at once.
ARROW_BYTES = 4 << 20

_made: list[tuple[SparkSession, str]] = []
#: What this process keeps for later tasks: by owner, how to let go of it.
_kept: dict[str, Callable[[], None]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode and one in the warehouse on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="scratch-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _made:
        atexit.register(_sweep)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM has already gone; the folder belongs to the cluster's own clean-up
            return


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to shared scratch space and read it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.mode("overwrite").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.scratch_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that no later job reads."""
    for table in tables:
        remove(table.sparkSession, table.scratch_path)
        _made.remove((table.sparkSession, table.scratch_path))


def slim(spark: SparkSession) -> None:
    """Have the executors collect their garbage, one task for each core, so that they give freed heap and buffers back to the system.

    A heap keeps the size that an earlier stage made it grow to, and what the
    Python workers of the next one need comes on top of it.
    """
    cores = spark.sparkContext.defaultParallelism
    spark.range(0, cores, 1, cores).select(F.java_method(F.lit("java.lang.System"), F.lit("gc"))).collect()


class KeyFilter:
    """A Bloom filter of one hash over the keys of a table: at most 2^27 bits (16 MB), so it can be broadcast.

    Rows that it rejects have no key of the table; the others have to be joined.
    It only keeps rows out of a shuffle and never decides.
    """

    MOST_BITS = 27

    def __init__(self, keys: DataFrame, *columns: str, bits: int = 8):
        """``bits``: about so many for each key, as far as the filter may grow."""
        self.size = 1 << min(max((bits * keys.count()).bit_length(), 15), self.MOST_BITS)
        place = (F.pmod(F.xxhash64(*columns), F.lit(self.size)) + 1).alias("p")
        bits_of = keys.select(place).groupBy(F.bitmap_bucket_number("p").alias("_filter_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_filter_bits"))
        # Words of four bytes, made once for each bucket: a test of a row then makes no text, whose garbage made heaps grow.
        words = "transform(transform(sequence(0, 1023), i -> cast(conv(hex(substring(_filter_bits, i * 4 + 1, 4)), 16, 10) as bigint)), w -> cast(w - if(w >= 2147483648, 4294967296, 0) as int))"
        self.bits = bits_of.select("_filter_bucket", F.expr(words).alias("_filter_words"))

    def marked(self, df: DataFrame, *columns: str) -> DataFrame:
        """``df`` with a boolean column ``_filter_hit``: false only where the keys are not in the table."""
        placed = df.withColumn("_filter_place", F.pmod(F.xxhash64(*columns), F.lit(self.size)) + 1)
        placed = placed.withColumn("_filter_at", F.bitmap_bit_position("_filter_place").cast("int"))
        joined = placed.join(F.broadcast(self.bits), F.bitmap_bucket_number("_filter_place") == F.col("_filter_bucket"), "left")
        # The first of a word's bytes is its highest, the first of a byte's bits its lowest.
        hit = F.expr("coalesce(shiftright(get(_filter_words, shiftright(_filter_at, 5)), 24 - (_filter_at & 24) + (_filter_at & 7)) & 1, 0) = 1")
        return joined.withColumn("_filter_hit", hit).drop("_filter_place", "_filter_at", "_filter_bucket", "_filter_words")

    def possible(self, df: DataFrame, *columns: str) -> DataFrame:
        return self.marked(df, *columns).where("_filter_hit").drop("_filter_hit")


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each slice holds a bounded number of rows and of bytes of ``column`` (one row at least)."""
    import numpy as np
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0)
    ends = np.cumsum(lengths.to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = int(np.searchsorted(ends, base + most, side="right"))
        to = min(max(to, at + 1), at + SLICE_ROWS, batch.num_rows)
        yield batch.slice(at, to - at)
        at = to


def bounded(spark: SparkSession) -> None:
    """Lower the session's limit of bytes in an Arrow batch, so that long texts don't fill the workers."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = (spark.conf.get(key, None) or "").rstrip("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(key, str(ARROW_BYTES))


def give_back() -> None:
    """Return freed memory to the system."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def keep(owner: str, let_go: Callable[[], None]) -> None:
    """``owner`` keeps something in this process until a task of another owner begins, which calls ``let_go``."""
    _kept[owner] = let_go


def let_go_of_others(owner: str = "") -> None:
    others = [name for name in _kept if name != owner]
    for name in others:
        _kept.pop(name)()
    if others:
        give_back()


def trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, which gives back freed memory at its end, and what other owners keep at its beginning: Spark keeps idle workers for later stages."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go_of_others(owner)
        yield from run(batches)
        give_back()

    return wrapped


def arrow_map(df: DataFrame, function: Callable[[pa.RecordBatch], dict[str, object]], schema: str, column: str = "text", most: int = SLICE_BYTES, owner: str = "") -> DataFrame:
    """``function`` maps a bounded slice to columns; Arrow batches in and out, no row objects.  ``owner``: whose kept things it uses."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    struct = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(struct)
        for batch in batches:
            for part in slices(batch, column, most):
                made = function(part)
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in target], schema=target)

    return df.mapInArrow(trimmed(run, owner), struct)


def arrow_rows(df: DataFrame, function: Callable[[pa.RecordBatch, list[str | None]], pa.RecordBatch], column: str = "text") -> DataFrame:
    """``function`` changes or drops the rows of a bounded slice, given it and its texts; all columns stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column):
                yield function(part, part.column(part.schema.get_field_index(column)).to_pylist())

    bounded(df.sparkSession)
    rows = df.withColumn(column, F.col(column).cast("string"))
    return rows.mapInArrow(trimmed(run), rows.schema)


def texts(df: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text with nulls as empty; extra columns are dropped here."""
    bounded(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def crc_mod(column: str, divisor: int) -> Column:
    """crc32 of the id written as decimal text, modulo ``divisor``; null ids count as remainder -1."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % divisor, F.lit(-1))
