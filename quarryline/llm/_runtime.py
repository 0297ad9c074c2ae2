"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where lineage is cut if the cluster names no shared folder (local tests).
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Rows that a file of :func:`durable` has at least, where their number is known.
ROWS_A_FILE = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's
    ``spark.checkpoint.dir``. In local mode a local one will do; on a cluster
    executors would each see another folder, so there it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or LOCAL_CHECKPOINTS


def durable(df: DataFrame, release: bool = False, rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut; a lost executor
    costs no recomputation. With ``release`` the driver collects its garbage
    then: executors keep shuffle files until the driver finds that nothing
    refers to them, which in a job of many rounds it may do too late.

    ``rows`` is about how many there are at most. If the shuffle's partitions
    would make smaller files of them than ROWS_A_FILE, there are fewer files,
    one for each core at least: for each file an executor may start a process
    that sets its mode, and small files by the thousand cost more than their rows."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(spark))
    if rows is not None:
        files = max(sc.defaultParallelism, math.ceil(rows / ROWS_A_FILE))
        if files < int(spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(files)
    out = df.checkpoint(eager=True)
    if release:
        sc._jvm.System.gc()
    return out


def give_back() -> None:
    """Returns what this process has freed to the system: both allocators keep it
    otherwise, and a worker that waits for its next task holds as much as its largest batch took."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, a function of mapInArrow, that gives memory back at the end of its task."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return told


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes that ``df`` scans."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def groups_for(df: DataFrame, bytes_each: int, text_col: str = "text", least: int = 8) -> int:
    """How many groups of about ``bytes_each`` scanned bytes ``df`` holds; where
    the optimizer knows no size, its texts' lengths are added up."""
    size = input_bytes(df)
    if size >= 1 << 50:
        size = (df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // 2  # as compressed
    return max(least, math.ceil(size / bytes_each))


def texts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """Only the id and the text (null: empty), whatever other columns there are."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


#: Fixed values of the 32-bit MurmurHash3 by which Spark deals rows to partitions; the factors' inverses undo them.
SEED, BITS_32 = 42, 0xFFFFFFFF
_FINAL = (pow(0xC2B2AE35, -1, 1 << 32), pow(0x85EBCA6B, -1, 1 << 32))
_BLOCK = (pow(5, -1, 1 << 32), pow(0x1B873593, -1, 1 << 32), pow(0xCC9E2D51, -1, 1 << 32))
_ADDED = 0xE6546B64


def _hashed_to(number, right: Callable, times: Callable, let: Callable):
    """The 32 bits whose hash is ``number``: each step of the hash undone."""
    turn = lambda x, k: (right(x, k) | (x * (1 << (32 - k)))) & BITS_32
    x = let(number, lambda x: times(x ^ right(x, 16), _FINAL[0]))
    x = let(x, lambda x: times(x ^ right(x, 13) ^ right(x, 26), _FINAL[1]))
    x = let(x, lambda x: times(((x ^ right(x, 16) ^ 4) - _ADDED) & BITS_32, _BLOCK[0]))
    x = let(x, lambda x: times(turn(x, 13) ^ SEED, _BLOCK[1]))
    return let(x, lambda x: times(turn(x, 15), _BLOCK[2]))


def dealing_keys(numbers: np.ndarray) -> np.ndarray:
    """By number: the int that Spark deals to the partition of that number.

    Hashes of small ints leave many partitions empty and others with several
    groups; dealt by these keys, each of n groups has a partition of its own."""
    x = np.asarray(numbers, np.uint64)
    right = lambda x, k: x >> np.uint64(k)
    times = lambda x, c: (x * np.uint64(c)) & np.uint64(BITS_32)
    return _hashed_to(x, right, times, lambda x, of: of(x)).astype(np.uint32).view(np.int32)


def dealing_key(number: Column) -> Column:
    """:func:`dealing_keys` of a column."""

    def times(x: Column, c: int) -> Column:  # by halves of c, so that nothing overflows
        return (x * (c & 0xFFFF) + (x * (c >> 16)).bitwiseAND(F.lit(0xFFFF)) * (1 << 16)).bitwiseAND(F.lit(BITS_32))

    class Bits:
        """A column of 32 bits as a long, with Python's operators on bits."""

        def __init__(self, c: Column):
            self.c = c

        def __xor__(self, o):
            return Bits(self.c.bitwiseXOR(o.c if isinstance(o, Bits) else F.lit(o)))

        def __or__(self, o):
            return Bits(self.c.bitwiseOR(o.c))

        def __and__(self, o):
            return Bits(self.c.bitwiseAND(F.lit(o)))

        def __mul__(self, o):
            return Bits(self.c * o)

        def __sub__(self, o):
            return Bits(self.c - o)

    let = lambda x, of: Bits(F.transform(F.array(x.c), lambda y: of(Bits(y)).c)[0])
    right = lambda x, k: Bits(F.shiftrightunsigned(x.c, k))
    found = _hashed_to(Bits(number.cast("long")), right, lambda x, c: Bits(times(x.c, c)), let).c
    return F.when(found >= 1 << 31, found - (1 << 32)).otherwise(found).cast("int")
