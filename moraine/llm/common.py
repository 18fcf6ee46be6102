"""Helpers shared by the training-data operators: storage, batches, words, hashes."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel takes at a time; bounds its NumPy temporaries.
SLICE_BYTES = 1 << 20
#: Bytes of rows that a worker gathers for a row group of a file.
GROUP_BYTES = 8 << 20


#: Arrow batches of texts are held by the JVM and by the worker at once: their size, where the session has Spark's own.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers on this machine import the package (a cluster has it installed); set BATCH."""
    for name, (usual, ours) in BATCH.items():
        if spark.conf.get(name, usual) == usual:
            spark.conf.set(name, ours)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session may lack it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("moraine.shared.dir", None)
    if not at:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="moraine-")
        spark.conf.set("moraine.shared.dir", at)
    return at.rstrip("/")


def path_of(spark: SparkSession, at: str):
    """The file system and path of a name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


_own: dict[str, SparkSession] = {}


def clear() -> None:
    """Delete what keep() of this process has written and drop() has not deleted."""
    for at, spark in _own.items():
        try:
            fs, path = path_of(spark, at)
            fs.delete(path, True)
        except Exception:  # noqa: BLE001 - the session has ended: the folder bears the application's id
            continue
    _own.clear()


atexit.register(clear)


def keep(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as Parquet in the shared folder and read it back.

    A folder for each application holds its tables; it goes when the process ends.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/moraine/{spark.sparkContext.applicationId}"
    _own[home] = spark
    path = f"{home}/{name}-{uuid.uuid4().hex}"
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made.kept_at = path
    return made


def filed(df: DataFrame, name: str) -> DataFrame:
    """keep() whose files the Python workers write, where the shared folder is a mounted one.

    Hadoop starts a command for each file and folder that it makes in such a folder,
    to set its permissions; until the command runs it shares the JVM's memory, which
    counts twice for that moment. A worker makes its file without any command.

    A task writes a hidden file with a name of its own and returns the name; the
    driver shows those of the tasks that ended well, so a failed or repeated attempt
    adds no rows. For columns of numbers, bytes and texts, and lists and structs of them.
    """
    spark = df.sparkSession
    home = f"{shared_dir(spark)}/moraine/{spark.sparkContext.applicationId}"
    at = f"{home}/{name}-{uuid.uuid4().hex}"
    fs, path = path_of(spark, at)
    if fs.getUri().getScheme() != "file":
        return keep(df, name)
    _own[home] = spark
    folder = path.toUri().getPath()
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, out, held, size = f"_{uuid.uuid4().hex}.parquet", None, [], 0
        for batch in chain(batches, [None]):
            if batch is not None and batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if held and (batch is None or size >= GROUP_BYTES):
                out = out or pq.ParquetWriter(f"{folder}/{file}", held[0].schema)
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([file])], ["file"])

    for r in df.mapInArrow(lean(run), "file string").collect():
        os.rename(f"{folder}/{r.file}", f"{folder}/{r.file[1:]}")
    made = spark.read.schema(df.schema).parquet(at)
    made.kept_at = at
    return made


def drop(df: DataFrame) -> None:
    """Delete a table of keep() that nothing reads any more."""
    fs, path = path_of(df.sparkSession, df.kept_at)
    fs.delete(path, True)


def few(df: DataFrame) -> DataFrame:
    """Rows of a shuffle in fewer tasks, for tables of short rows: small files cost opens and calls.

    At most eight partitions of the shuffle make a task, and only as long as
    every core has one.
    """
    spark = df.sparkSession
    return df.coalesce(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def loose(df: DataFrame) -> DataFrame:
    """df as if dealt at random, so that a join deals it anew and Spark can split the other side's hot keys."""
    return df.coalesce(1 << 20)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, whose worker gives unused memory back at the end of a task: workers go on living, one for each core."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # not glibc
            return

    return wrapped


def fresh(base: str, taken: list[str]) -> str:
    """A column name that is not taken, in any case of letters."""
    have = {x.lower() for x in taken}
    while base.lower() in have:
        base += "_"
    return base


def quoted(names: list[str]) -> list[str]:
    return ["`" + x.replace("`", "``") + "`" for x in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bucket5(doc_id) -> F.Column:
    """crc32 of doc_id as text, mod 5."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def ascii_lower(col) -> F.Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Bits of an id bitmap, whatever the input.
BITS = 1 << 26


def bit_of(column: str) -> F.Column:
    """The bit that stands for an id in a bitmap of ids."""
    return F.pmod(F.xxhash64(column), F.lit(BITS))


def id_bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """BITS bits in which those of the ids are set: what has its bit unset is none of them.

    Rows of 4 KB are gathered, BITS / 32768 at most.
    """
    bits = np.zeros(BITS // 8, np.uint8)
    # bitmap positions count from 1, in buckets of 32768 from 1
    rows = ids.select((bit_of(column) + 1).alias("p")).groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits"))
    for r in rows.toLocalIterator():
        part = np.frombuffer(bytes(r["bits"]), np.uint8)
        at = (r["k"] - 1) * 4096
        bits[at : at + len(part)] |= part[: len(bits) - at]
    return bits


def has_bit(bits: np.ndarray, place: pa.Array) -> np.ndarray:
    p = place.to_numpy(zero_copy_only=False)
    return (bits[p // 8] >> (p % 8).astype(np.uint8)) & 1 == 1


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that column has about limit bytes in each part, a row at least."""
    col = batch.column(batch.schema.get_field_index(column))
    size = pc.binary_length(col).fill_null(0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and n + 1 offsets; null counts as empty."""
    parts = [x or b"" for x in col.cast(pa.binary()).to_pylist()]
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(x) for x in parts], out=off[1:])
    return np.frombuffer(b"".join(parts), np.uint8), off


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(buf: np.ndarray, off: np.ndarray, gap: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each maximal run of bytes outside gap; no run crosses rows."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    void = gap[buf]
    before, after = np.empty_like(void), np.empty_like(void)
    before[0], before[1:] = True, void[:-1]
    after[-1], after[:-1] = True, void[1:]
    full = np.flatnonzero(off[1:] > off[:-1])
    before[off[full]] = True
    after[off[full + 1] - 1] = True
    word = ~void
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer; uint64 wraps around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_RADIX = 0x9E3779B97F4A7C15 | 1
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_power: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the radix and of its inverse, modulo 2 ** 64."""
    if len(_power[0]) < n:
        for k, r in enumerate((_RADIX, pow(_RADIX, -1, 1 << 64))):
            x = np.full(n, r, np.uint64)
            x[0] = 1
            _power[k] = np.cumprod(x)
    return _power[0][:n], _power[1][:n]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by one running sum over the buffer."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[: len(buf)], out=total[1:])
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
