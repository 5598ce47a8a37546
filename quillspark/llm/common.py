"""Helpers that the training-data operators share: Arrow text buffers, checkpoints, row keys."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a vectorised kernel works on at once; its temporaries are a few dozen times this.
BLOCK_BYTES = 1 << 19
#: Bytes of an Arrow batch that goes to a worker.
ARROW_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, as the session names it; without one, only a local master has a folder that all see."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = os.path.join(tempfile.gettempdir(), f"checkpoints-{uuid.uuid4().hex}")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write the rows to the shared checkpoint folder and go on from there."""
    ensure_checkpoint_dir(df.sparkSession)
    made = df.checkpoint(eager=True)
    relieve(df.sparkSession)
    return made


def staged(df: DataFrame) -> DataFrame:
    """Write the rows as a compressed table in the shared checkpoint folder and read them from there: lineage ends."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    relieve(spark)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove staged tables that no later step reads, whole folders of this module's own naming only."""
    for df in tables:
        spark = df.sparkSession
        folder = ensure_checkpoint_dir(spark).rstrip("/")
        for path in {re.sub(r"/[^/]*$", "", f) for f in df.inputFiles()}:
            if re.search(r"/table-[0-9a-f]{32}$", path) and path.split("/")[-2] == folder.split("/")[-1]:
                place = spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow with batches of a few MB in this session: the default of 64 MB stands once in the JVM and once in the worker
    of every task. A session that has another bound keeps it."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if conf.get(name, None) in (None, "64MB", str(64 << 20)):
        conf.set(name, str(ARROW_BYTES))
    return df.mapInArrow(run, schema)


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of df has, whatever the case."""
    taken = {c.lower() for c in df.columns}
    name, n = stem, 0
    while name.lower() in taken:
        n += 1
        name = f"{stem}_{n}"
    return name


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column; a null has no bytes. No text is copied."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    n = len(column)
    valid = np.ones(n, bool) if column.null_count == 0 else np.asarray(column.is_valid())
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if n == 0 or off is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64), valid
    offsets = np.frombuffer(off, kind, n + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets, valid


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes each, one row at least."""
    n, row = len(offsets) - 1, 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end
        row = end


def release() -> None:
    """Give freed memory back to the system; workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def relieve(spark: SparkSession) -> None:
    """Give memory that the driver's JVM has freed back to the system, once a query has ended. Planning and compiling leave holes in
    its native memory, which only a trim returns; a heap that has grown to over half of its limit is collected, and shrinks.
    A JVM without the trim command goes on without it."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() * 2 > runtime.maxMemory():
        jvm.java.lang.System.gc()
    of = jvm.java.lang.Class.forName
    kinds, args = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for k, name in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
        kinds[k] = of(name)
    args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    args[2], args[3] = gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)
    try:  # by the interface, as the server's own class is closed to reflection
        of("javax.management.MBeanServerConnection").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)
    except Py4JError:
        pass


def small(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most `limit` bytes of text each, one row at least; nothing is copied."""
    for batch in batches:
        _, offsets, _ = utf8(batch.column(column))
        for a, b in blocks(offsets, limit):
            yield batch.slice(a, b - a)
        del batch
        release()


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: The bytes between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_RNG = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(0, 2**63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def row_words(raw: np.ndarray, offsets: np.ndarray, a: int, b: int, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of each word of the rows a to b: runs of bytes that are no gap, never across rows."""
    lo, hi = int(offsets[a]), int(offsets[b])
    inside = ~gap[raw[lo:hi]]
    before = np.concatenate(([False], inside[:-1])) if hi > lo else np.empty(0, bool)
    firsts = (offsets[a:b] - lo)[offsets[a:b] < offsets[a + 1 : b + 1]]
    before[firsts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.concatenate((inside[1:], [False])) if hi > lo else np.empty(0, bool)
    after[firsts[firsts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    rows = np.searchsorted(offsets[a : b + 1], starts + lo, side="right") - 1 + a
    return starts + lo, ends + lo, rows


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, gap: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word's bytes and length (multilinear, then mixed); equal words have equal hashes anywhere."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lo, hi = int(starts[0]), int(ends[-1])
    lens = ends - starts
    place = np.arange(hi - lo, dtype=np.int64) - np.repeat(starts - lo, np.diff(np.concatenate((starts - lo, [hi - lo]))))
    value = _BYTE[raw[lo:hi]]
    value *= _PLACE[np.minimum(place, 4095)] if lens.max() <= 4096 else _PLACE[place & 4095] + mix64((place >> 12).astype(np.uint64))
    value[gap[raw[lo:hi]]] = 0
    total = np.add.reduceat(value, starts - lo)
    return mix64(total ^ (lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def long_id(column: pa.Array) -> np.ndarray:
    """A column of whole numbers as int64, nulls as the smallest long; other values by a hash of their text."""
    if pa.types.is_integer(column.type):
        return np.asarray(column.cast(pa.int64()).fill_null(-(2**63)))
    return np.array([-(2**63) if x is None else xxhash.xxh64_intdigest(str(x)) - 2**63 for x in column.to_pylist()], np.int64)


def typed(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    """The schema of df with more fields at its end."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in fields)])

