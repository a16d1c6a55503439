"""Token ids in Arrow's file format, as fixed-size lists for random access without copies.

Documents are laid end to end in ascending id order (null ids first) and cut into
sequences of ``length`` ids, which are rows of two fixed-size-list columns: ``tokens``
(the smallest unsigned type that holds the vocabulary) and ``mask`` (bits; false where the
last row of a shard is padded). A shard is one file of batches of ``rows_per_batch`` rows,
so sequence i lies in batch ``i // rows_per_batch`` at row ``i % rows_per_batch``, read from
the mapped file without copying; a second file per shard has each document's start and
number of ids.

Rows are encoded where they are read. Bounds that split the ids evenly come from the id
column alone; the ids then take one shuffle of packed ids to their shard, are sorted
there, and written under a temporary name that is renamed when whole, so a lost or
repeated task leaves a whole file or none. Shard totals (a row per shard) give the starts.

Defined results: null and empty texts are documents of the end id alone; rows with equal
ids stay apart, in an order of their ids' bytes; empty tables give no shards and an empty result;
extra columns are ignored; the ids of a very long text cross batches of its shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc as ipc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .encode import encoder

SCHEMA = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
LENGTH, ROWS_PER_BATCH = 1024, 1024
#: A shard has about so much text, where that makes more shards than there are partitions.
SHARD_BYTES = 64 << 20
#: Pieces kept by a worker; it holds little else here.
KEPT_PIECES = 800_000


# -- the format


class ShardWriter:
    """Writes one shard: ids come document by document, rows leave in batches."""

    def __init__(self, uri: str, dtype: np.dtype, length: int = LENGTH, rows_per_batch: int = ROWS_PER_BATCH):
        self.uri, self.length, self.rows, self.dtype = uri, length, rows_per_batch, np.dtype(dtype)
        self.schema = pa.schema([("tokens", pa.list_(pa.from_numpy_dtype(self.dtype), length)), ("mask", pa.list_(pa.bool_(), length))], {"length": str(length), "rows_per_batch": str(rows_per_batch)})
        self.fs, self.path = c.open_fs(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.part = f".{uuid.uuid4().hex[:8]}.part"
        self.sink = self.fs.open_output_stream(f"{self.path}.arrow{self.part}")
        self.writer = ipc.new_file(self.sink, self.schema)
        self.held: list[bytes] = []
        self.n_held = self.total = 0
        self.docs: tuple[list, list, list] = ([], [], [])

    def _batch(self, ids: np.ndarray) -> None:
        rows = -(-len(ids) // self.length)
        padded = np.zeros(rows * self.length, self.dtype)
        padded[: len(ids)] = ids
        tokens = pa.FixedSizeListArray.from_arrays(pa.array(padded), self.length)
        mask = pa.FixedSizeListArray.from_arrays(pa.array(np.arange(len(padded)) < len(ids)), self.length)
        self.writer.write_batch(pa.RecordBatch.from_arrays([tokens, mask], schema=self.schema))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        for column, value in zip(self.docs, (doc_id, self.total, n)):
            column.append(value)
        self.total += n
        self.held.append(ids)
        self.n_held += n
        full = self.length * self.rows
        if self.n_held >= full:
            raw = np.frombuffer(b"".join(self.held), self.dtype)
            for a in range(0, len(raw) - full + 1, full):
                self._batch(raw[a : a + full])
            rest = raw[len(raw) // full * full :]
            self.held, self.n_held = [rest.tobytes()], len(rest)

    def close(self) -> None:
        if self.n_held:
            self._batch(np.frombuffer(b"".join(self.held), self.dtype))
        self.writer.close()
        self.sink.close()
        with self.fs.open_output_stream(f"{self.path}.docs{self.part}") as sink:
            table = pa.table([pa.array(self.docs[0], pa.int64()), pa.array(self.docs[1], pa.int64()), pa.array(self.docs[2], pa.int64())], names=["doc_id", "start", "n_tokens"])
            with ipc.new_file(sink, table.schema) as w:
                w.write_table(table)
        for kind in ("arrow", "docs"):
            self.fs.move(f"{self.path}.{kind}{self.part}", f"{self.path}.{kind}")


class ShardReader:
    """Random access to the sequences of a shard, and to its documents' ids."""

    def __init__(self, uri: str):
        fs, path = c.open_fs(uri)
        local = fs.type_name == "local"
        source = (lambda kind: pa.memory_map(f"{path}.{kind}")) if local else (lambda kind: fs.open_input_file(f"{path}.{kind}"))
        self.file, self.index = ipc.open_file(source("arrow")), ipc.open_file(source("docs")).read_all()
        meta = self.file.schema.metadata
        self.length, self.rows = int(meta[b"length"]), int(meta[b"rows_per_batch"])

    def sequence(self, i: int) -> tuple[np.ndarray, pa.Array]:
        """Ids of sequence i as a view of the file, and its mask."""
        batch, at = self.file.get_batch(i // self.rows), i % self.rows
        return batch.column(0).slice(at, 1).flatten().to_numpy(), batch.column(1).slice(at, 1).flatten()

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, start in the shard, ids) of every document; at most one batch beyond a document is held."""
        starts, sizes = self.index.column("start").to_pylist(), self.index.column("n_tokens").to_pylist()
        have, begin, k = np.zeros(0, np.uint16), 0, 0
        for doc, start, n in zip(self.index.column("doc_id").to_pylist(), starts, sizes):
            parts = [have[start - begin :]]
            got = len(parts[0])
            while got < n:
                flat = self.file.get_batch(k).column(0).flatten().to_numpy()
                k += 1
                parts.append(flat)
                got += len(flat)
            if len(parts) > 1:
                have, begin = np.concatenate(parts) if len(parts[0]) or len(parts) > 2 else parts[1], start
            yield doc, start, have[start - begin : start - begin + n]


# -- over a corpus


def write(docs: DataFrame, tokenizer: str, place: str, end: int = 2, shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int, int]]:
    """Encode ``docs`` and write them below ``place``; returns (shard, documents, ids) in id order."""
    spark = docs.sparkSession
    size = 0 if shards else c.keyed(docs, text_col).toDF("text").agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    n = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    ids = c.keyed(docs, id_col).toDF("doc_id").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    cuts = ids.stat.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    bounds = np.unique(np.array(cuts, np.float64)).astype(np.int64)
    lowest = np.iinfo(np.int64).min

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, KEPT_PIECES)
        tail = np.array([end], own.dtype).tobytes()
        for batch in batches:
            _, off = c.text_buffers(batch.column(1))
            for i, j in c.chunks(off):
                part = batch.slice(i, j - i)
                key = part.column(0).fill_null(lowest).to_numpy(zero_copy_only=False)
                packed = [pa.compress(x + tail, "zstd", asbytes=True) for x in own.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.searchsorted(bounds, key, "right").astype(np.int32)), pa.array(packed, pa.binary())], names=["doc_id", "shard", "ids"])

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own, writer, shard, n_docs = encoder(tokenizer, KEPT_PIECES), None, -1, 0
        for batch in batches:
            for doc, at, packed in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "shard", "ids"))):
                if writer is None:
                    shard, writer = at, ShardWriter(f"{place}/shard-{at:06d}", own.dtype)
                writer.add(doc, zstandard.decompress(packed))
                n_docs += 1
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([n_docs], pa.int64()), pa.array([writer.total], pa.int64())], names=["shard", "n_docs", "n_tokens"])

    texts = c.keyed(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    coded = texts.mapInArrow(encode, "doc_id bigint, shard int, ids binary")
    sorted_ = coded.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    made = sorted_.mapInArrow(store, "shard bigint, n_docs bigint, n_tokens bigint").collect()
    return [(f"{place}/shard-{r[0]:06d}", r[1], r[2]) for r in sorted(made)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(spark: SparkSession, shards: list[tuple[str, int, int]]) -> DataFrame:
    """One row per document, from the files alone: where its ids begin in the corpus, how many, their crc."""
    rows, at = [], 0
    for place, _, n in shards:
        rows.append((place, at))
        at += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out: list[tuple] = []
                for doc, start, ids in ShardReader(place).documents():
                    out.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(out) == 10_000:
                        yield _batch(out)
                        out = []
                yield _batch(out)

    if not rows:
        return spark.createDataFrame([], SCHEMA)
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, place string, base bigint")
    return table.repartitionById(len(rows), "k").select("place", "base").mapInArrow(run, SCHEMA)
