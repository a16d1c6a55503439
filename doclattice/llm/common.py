"""Pieces that several corpus operators share: storage, Arrow text, word tables.

Everything here works on the raw UTF-8 buffers of an Arrow batch, so a batch is
handled with a fixed number of numpy calls instead of a Python loop per word.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass takes at a time; bounds the working memory of a task.
CHUNK_BYTES = 2 << 20


# -- storage

#: Stand-in for the shared folder by application, single-JVM sessions only.
_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir``.

    Where the setting is absent (tests, a single JVM) a temporary folder takes its
    place; on a cluster its absence is an error, as a machine-local folder would
    not be seen by the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _LOCAL.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="doclattice-")
        _LOCAL[spark.sparkContext.applicationId] = root
    return root.rstrip("/")


#: Paths that this driver has handed out and not discarded, in order.
MADE: list[str] = []


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    MADE.append(f"{shared_root(spark)}/{label}-{uuid.uuid4().hex[:12]}")
    return MADE[-1]


def discard(*places: str | DataFrame) -> None:
    """Delete tables (or paths) of the shared folder that nothing will read any more."""
    for place in places:
        path = place if isinstance(place, str) else place._place
        fs, at = open_fs(path)
        if fs.get_file_info(at).type != pafs.FileType.NotFound:
            fs.delete_dir(at)
        if path in MADE:
            MADE.remove(path)


def discard_since(mark: int, *keep: DataFrame) -> None:
    """Delete what was made after the first ``mark`` paths, but for the tables to keep."""
    kept = {t._place for t in keep}
    discard(*[p for p in MADE[mark:] if p not in kept])


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._place = path
    return out


BATCH_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def prepare(spark: SparkSession) -> None:
    """Session settings of the queries: batches of whole documents, 2,000 rows in place of the default 10,000, unless set otherwise."""
    if spark.conf.get(BATCH_KEY) == "10000":
        spark.conf.set(BATCH_KEY, "2000")


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Batches of at most ``rows`` rows between Spark and Python, for what runs inside."""
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder or file in the shared folder."""
    if urlparse(uri).scheme in ("", "file"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def save_array(uri: str, values: np.ndarray) -> None:
    """Write raw values so that workers can map them; renamed into place when whole."""
    fs, path = open_fs(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex[:8]}"
    with fs.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    fs.move(part, path)


def load_array(uri: str, dtype: str) -> np.ndarray:
    """Memory-map a saved array (read whole where the file system can't be mapped)."""
    fs, path = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        if fs.get_file_info(path).size == 0:
            return np.zeros(0, dtype)
        return np.memmap(path, dtype=dtype, mode="r")
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)


# -- worker memory

#: What a worker keeps between tasks of one operator; tasks of others drop it.
CACHES: list = []


def release() -> None:
    """Drop what tasks of other operators have left in this worker, and hand freed memory back."""
    while CACHES:
        CACHES.pop()()
    trim()


def trim() -> None:
    """Return freed memory to the system, where its allocator can."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


# -- Arrow text


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each; a longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) for bounded parts of a batch."""
    release()
    data, off = text_buffers(batch.column(column))
    for i, j in chunks(off, limit):
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]


# -- hashing and words

_RNG = np.random.default_rng(20240117)
BYTE_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_P_INV = np.uint64(pow(int(_P), -1, 2**64))
_POWERS: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64; the two arrays are kept while they suffice."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        with np.errstate(over="ignore"):
            both = []
            for base in (_P, _P_INV):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                both.append(np.multiply.accumulate(out))
        if size > 4 * CHUNK_BYTES:
            return both[0], both[1]
        _POWERS[:] = both
    return _POWERS[0], _POWERS[1]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """S with S[j] - S[i] the weighted sum of bytes i..j-1; see span_hash."""
    pw, _ = _powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(BYTE_VALUE[data] * pw[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span from the prefix sums; equal bytes give equal hashes wherever they stand."""
    _, inv = _powers(len(prefix))
    with np.errstate(over="ignore"):
        h = (prefix[ends] - prefix[starts]) * inv[starts] + (ends - starts).astype(np.uint64)
    return mix64(h)


def word_spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (byte positions) of all words and, per row, the index of its first word.

    ``separator`` is a table of 256 booleans. Words never cross rows.
    """
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    inside = ~separator[data]
    inner = off[(off > 0) & (off < n)]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    before[inner] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Words parted by blank characters only.
BLANK = separators((0x20, 0x20), (0x09, 0x0D))
#: Words of digits, letters and everything beyond ASCII, after lower-casing.
NOT_ALNUM = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clashes(df: DataFrame) -> bool:
    """Whether columns differ in nothing but case, so that Spark can't tell them apart by name."""
    return len({c.lower() for c in df.columns}) < len(df.columns)


def numbered(df: DataFrame) -> DataFrame:
    """The same columns under names that can't clash."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` that keeps the columns, whatever their names."""
    own = numbered(docs)
    return own.mapInArrow(run, own.schema).toDF(*docs.columns)


def from_files(df: DataFrame) -> bool:
    """Whether rows can be told apart by the file and row that they come from."""
    if "_metadata" in map(str.lower, df.columns) or clashes(df):
        return False
    try:
        return bool(df.select("_metadata.file_path", "_metadata.row_index").columns)
    except AnalysisException:
        return False


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, whatever else the table carries."""
    if clashes(docs):
        return numbered(docs).select(*[F.col(f"c{docs.columns.index(c)}").alias(c) for c in columns])
    return docs.select(*[F.col(f"`{c}`") for c in columns])
