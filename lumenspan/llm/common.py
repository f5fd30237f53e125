"""Shared helpers: written tables in the cluster's shared folder, word
splitting over Arrow batches, and deterministic folds."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.session import scratch as scratch_path

#: Text bytes that one step of a Python worker holds at once.
CHUNK_BYTES = 1 << 19
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of a table, measured first, up to which it is broadcast.
BROADCAST_BYTES = 32 << 20


def bound_batches(spark: SparkSession) -> None:
    """Give Python workers Arrow batches of 4 MB instead of Spark's default of
    64, which long texts fill; a session that names another size keeps it."""
    if spark.conf.get(BATCH_KEY, "67108864b") == "67108864b":
        spark.conf.set(BATCH_KEY, "4m")


def lean(step: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``step`` over Arrow batches, after whose end the worker gives the memory
    that it freed back to the system: Spark keeps Python workers for the stages
    that follow, beside an executor whose heap has grown meanwhile."""

    def run(batches):
        try:
            yield from step(batches)
        finally:
            give_back()

    return run


def give_back() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries lack it
        ctypes.CDLL(None).malloc_trim(0)


def broadcast_small(df: DataFrame, row_bytes: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (a written table) to be broadcast if its rows, at ``row_bytes``
    each, hold ``most`` bytes at most; else as it is, to be joined by shuffles."""
    held = df.agg(F.sum(row_bytes.cast("long"))).first()[0] or 0
    return F.broadcast(df) if held <= most else df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage
    ends here, and a lost executor costs at most a re-read."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lumenspan/" in parent:
            path = spark._jvm.org.apache.hadoop.fs.Path(parent)
            path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished jobs now: it does so when
    the driver collects its garbage, which on a large heap may be long after."""
    spark._jvm.System.gc()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(4)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold_of(doc_id) == 2, F.lit(False))


def unit_hash(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)).cast("double") / F.lit(float(1 << 40))


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; NULL becomes empty."""
    col = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in col.cast(pa.binary()).to_pylist()]


def chunks(batches, column: str = "text", limit: int = CHUNK_BYTES):
    """(batch slice, texts) with about ``limit`` bytes of text each; a text
    longer than that makes a chunk of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.binary())), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(size, dtype=np.int64)
        lo = 0
        while lo < len(total):
            before = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, before + limit, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, texts_of(part, column)
            lo = hi


#: Lower-cases A-Z, keeps 0-9, a-z and every byte of a non-ASCII character,
#: and makes a space of anything else.
ALNUM = bytes((i + 32 if 65 <= i <= 90 else i) if 48 <= i <= 57 or 97 <= i <= 122 or 65 <= i <= 90 or i >= 128 else 32 for i in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered."""
    return text.translate(ALNUM).split()


def space_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered."""
    return text.lower().split()
