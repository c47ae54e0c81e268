"""What several operators share: scratch tables, the shared folder, Arrow buffers and row slices."""

from __future__ import annotations

import ctypes
import functools
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step works on; a longer text is a step of its own.
STEP_BYTES = 2 << 20
#: Bytes of an Arrow batch, which the JVM holds several times over outside its heap: a step, but for its last row.
BATCH_BYTES = STEP_BYTES * 7 // 8

#: Bits of the filter by which rows without a partner stay where they are: 8 MB, whatever the input.
SIEVE_BITS = 1 << 26
_BITMAP = 1 << 15  # bits that one bitmap of Spark's holds
#: Keys that are spread over several tasks are those with more than this part of all rows; so no more can be hot.
HOT_KEYS = 10_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one where it is unset and the master is local."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="locusforge-")
    spark.conf.set("spark.checkpoint.dir", path)
    spark.sparkContext.setCheckpointDir(path)
    return path


_MADE: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    folder = f"{shared_dir(spark)}/locusforge/{uuid.uuid4().hex}"
    _MADE.append(folder)
    return f"{folder}/{name}"


def release(spark: SparkSession) -> None:
    """Delete what this process has put into the shared folder; results that read from there are gone with it."""
    while _MADE:
        delete(spark, _MADE.pop())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it: cuts lineage, survives lost executors, is computed once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def prepare(spark: SparkSession) -> None:
    """Before Python stages: bound Arrow batches by bytes besides rows, and ship this package to the executors once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    context = spark.sparkContext
    if getattr(context, "_locusforge_shipped", None):
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="locusforge-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent).as_posix())
    context.addPyFile(str(archive))
    context._locusforge_shipped = True


def _give_back() -> None:
    """What allocators keep for later goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker, which waits beside the JVM for other tasks, is left as small as it can be."""

    @functools.wraps(run)
    def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return small


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one like it that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def sieve(rows: DataFrame, some: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys are surely not in `some`, the others: those that are, and a few that aren't).

    The keys of `some` set bits of a bitmap of fixed size, which is all that is broadcast; so that a join of the others
    moves about as many rows as have a partner. Where `some` has more keys than the map has bits, it moves most rows. Keys aren't null.
    """
    number, held = fresh(rows, "lf_map"), fresh(rows, "lf_bits")
    place = F.pmod(F.xxhash64(*on), F.lit(SIEVE_BITS))
    bits = some.select(place.alias("place")).groupBy((F.col("place") / _BITMAP).cast("int").alias(number)).agg(F.bitmap_construct_agg(F.col("place") % _BITMAP).alias(held))
    at = F.pmod(place, F.lit(_BITMAP)).cast("int")
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.bit_get(byte, at % 8) == 1, F.lit(False))
    tagged = rows.withColumn(number, (place / _BITMAP).cast("int")).join(F.broadcast(bits), number, "left")
    return tagged.where(~marked).select(*rows.columns), tagged.where(marked).select(*rows.columns)


def without(rows: DataFrame, some: DataFrame, on: list[str]) -> DataFrame:
    """The rows whose keys aren't in `some`."""
    clear, others = sieve(rows, some, on)
    return clear.union(others.join(some.select(*on), on, "left_anti").select(*rows.columns))


def join_spread(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with a table that has a key once; a key with many rows is dealt over several tasks, beside copies of its entry.

    With cap = rows / HOT_KEYS, at most HOT_KEYS keys have more rows than cap; these are broadcast, and have 2 x HOT_KEYS
    copies in all. Call it on narrow rows that are written already.
    """
    cap = max(1, rows.count() // HOT_KEYS)
    hot = rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > cap).select(key, F.ceil(F.col("n") / cap).alias("lf_salts"))
    hot = F.broadcast(materialize(hot, "hot"))
    salt = F.when(F.col("lf_salts").isNotNull(), F.pmod(F.monotonically_increasing_id(), F.col("lf_salts"))).otherwise(F.lit(0)).cast("long")
    left = rows.join(hot, key, "left").withColumn("lf_salt", salt).drop("lf_salts")
    right = table.join(hot, key, "left").withColumn("lf_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("lf_salts"), F.lit(1)).cast("long") - 1))).drop("lf_salts")
    return left.join(right, [key, "lf_salt"], how).drop("lf_salt")


def key_text(name: str) -> Column:
    """A key column as text that is never null, for joins that must not lose rows with null keys."""
    return F.coalesce(F.col(name).cast("string"), F.lit("\x00null"))


def text_bytes(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit("")).cast("binary").alias("text")


def local_path(uri: str) -> tuple[object, str]:
    """(pyarrow filesystem, path) of a folder in shared storage."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a binary or string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def steps(batch: pa.RecordBatch, column: str, most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of whole rows with about `most` bytes in a column, as (rows, bytes, offsets)."""
    data, off = buffers(batch.column(column))
    i, n = 0, batch.num_rows
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j
