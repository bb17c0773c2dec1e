"""What the corpus operators share: tables written to cut lineage, and words of whole Arrow batches as numpy arrays.

Words are the maximal runs of bytes other than space and 0x09-0x0D.  Everything works on the UTF-8 bytes of a
text, a slice of a batch at a time, so that memory follows the slice (or the longest single text), never the batch.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import IntegralType, NullType

#: Bytes of text that one numpy pass handles; a longer single text is handled alone.
SLICE_BYTES = 1 << 20
#: Rows of an Arrow batch between the JVM and Python: texts are long, so batches are short.
BATCH_ROWS = 500

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_LEFT: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where that is unset, a local one if the executors are this very process, else none."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file:///tmp/checkpoints/latticore"
    return at.rstrip("/")


#: Spark removes a query's shuffle files at its end, not when the driver's collector next runs.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str = "part", codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs one task.

    The shuffle files behind df go then.  What is written is removed by drop(), or when the driver's process ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _LEFT[path] = spark
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*cuts: DataFrame) -> None:
    """Remove the files of frames that cut() gave and that nothing reads any more."""
    for df in cuts:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            at = next((p for p in _LEFT if p.rpartition("/")[2] == path.rpartition("/")[2]), None)
            if at:
                _delete(_LEFT.pop(at), at)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove() -> None:
    for path, spark in _LEFT.items():
        try:
            _delete(spark, path)
        except Exception:  # the JVM may be gone already; the files are then the cluster's to clean
            return


atexit.register(_remove)


def short_batches(spark: SparkSession) -> None:
    """Keep Arrow batches short, unless the session asks for still shorter ones."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def need(df: DataFrame, *columns: str) -> None:
    """Refuse a table without the columns an operator reads."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")


def need_integer(df: DataFrame, column: str) -> None:
    """Refuse a column of ids that aren't integers: their order would not be that of their values as numbers."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (IntegralType, NullType)):
        raise TypeError(f"{column} must be of an integer type, not {kind.simpleString()}")


# ---------------------------------------------------------------- words


def binary(column: pa.Array | pa.ChunkedArray) -> pa.LargeBinaryArray:
    """A string column as large binary; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    return column.cast(pa.large_binary()).fill_null(b"")


class Words:
    """The words of consecutive texts: byte ranges, the text of each, and where each text's words begin."""

    __slots__ = ("data", "starts", "ends", "first", "offsets", "n")

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = _LOWER[data] if lower else data
        self.offsets, self.n = offsets, len(offsets) - 1
        inside = ~_SPACE[data]
        size = len(data)
        edge = np.zeros(size + 1, bool)
        edge[offsets] = True
        before = np.empty(size, bool)
        after = np.empty(size, bool)
        if size:
            before[0] = after[-1] = True
            before[1:] = ~inside[:-1]
            after[:-1] = ~inside[1:]
            before |= edge[:-1]
            after |= edge[1:]
        self.starts = np.flatnonzero(inside & before)
        self.ends = np.flatnonzero(inside & after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts())

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each word, from prefix sums of a polynomial over random byte values."""
        values, power, inverse = _poly(seed, _roof(len(self.data) + 1))
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(values[self.data] * power[: len(self.data)], out=sums[1:])
        return mix((sums[self.ends] - sums[self.starts]) * inverse[self.starts] + (self.ends - self.starts).astype(U))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def _roof(n: int) -> int:
    return max(1 << 12, 1 << (int(n) - 1).bit_length())


@lru_cache(maxsize=8)
def _poly(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(0x5EED + seed)
    values = rng.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
    base = int(rng.integers(1, 2**62)) * 2 + 1
    power = np.empty(size, U)
    inverse = np.empty(size, U)
    for out, b in ((power, base), (inverse, pow(base, -1, 1 << 64))):
        out[0] = 1
        done = 1
        while done < size:  # doubling: powers done..2*done-1 are the first ones times b**done
            out[done : 2 * done] = out[: min(done, size - done)] * U(pow(b, done, 1 << 64))
            done *= 2
    return values, power, inverse


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads 64 bits over 64 bits, one to one."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of `width` consecutive word hashes (len(hashes) - width + 1 of them)."""
    if len(hashes) < width:
        return np.zeros(0, U)
    rng = np.random.default_rng(0xC0DE + 31 * width + seed)
    out = np.zeros(len(hashes) - width + 1, U)
    for k, m in enumerate(rng.integers(1, 2**62, width, dtype=np.int64).astype(U) * U(2) + U(1)):
        out += hashes[k : len(hashes) - width + 1 + k] * m
    return mix(out)


def slices(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(from row, to row, words) over a whole column, about SLICE_BYTES of text at a time."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        b = min(b, n)
        yield a, b, Words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], lower)
        a = b


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
