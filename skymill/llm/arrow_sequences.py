"""Token sequences in Arrow files whose rows are fixed-size lists, readable in place.

Every shard is one Arrow IPC file. Its record batches have the columns

* ``ids``: fixed-size list of unsigned ids (16 bits where the vocabulary allows it), one row per sequence;
* ``mask``: fixed-size list of booleans (bit-packed), true for ids, false for the padding of a shard's last row;
* ``begins``: fixed-size list of booleans, true where a document begins;
* ``doc_ids``: list of the ids of the documents that begin in the row.

Since every list has the same size, sequence ``i`` of a batch is a slice of one buffer: ``open_shard`` maps the file
and ``sequence`` slices it without copying.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skymill.llm.tables import bounded_batches, text_of
from skymill.llm.tokens import encoder, vocabulary
from skymill.runtime import cut, scratch_path

SHARD_BYTES = 32 << 20  # of text in a shard, about
BATCH_ROWS = 256

MANIFEST = "shard int, file string, first_doc long, last_doc long, n_docs long, n_tokens long"
READ = "shard int, at long, doc_id long, local_start long, n_tokens long, ids_crc32 long"


def schema(length: int, dtype: np.dtype) -> pa.Schema:
    flags = pa.list_(pa.bool_(), length)
    return pa.schema(
        [("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", flags), ("begins", flags), ("doc_ids", pa.list_(pa.int64()))]
    )


def filesystem(uri: str):
    """The file system of a folder given as path or URI, and the folder's path there."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


class ShardWriter:
    """Appends documents to one shard file; a batch is written as soon as it is full."""

    def __init__(self, sink, length: int, dtype: np.dtype):
        self.length, self.dtype, self.schema = length, dtype, schema(length, dtype)
        self.out = pa.ipc.new_file(sink, self.schema)
        self.held: list[np.ndarray] = []
        self.begins: list[int] = []  # positions among the ids not yet written
        self.docs: list[int | None] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.begins.append(self.n_held)
        self.docs.append(doc_id)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.length * BATCH_ROWS:
            self._write(self.n_held // self.length)

    def _write(self, rows: int) -> None:
        size = rows * self.length
        flat = np.concatenate([*self.held, np.zeros(max(0, size - self.n_held), self.dtype)])
        mask = np.arange(size) < self.n_held
        starts = np.array(self.begins, dtype=np.int64)
        here = starts < size
        begins = np.zeros(size, dtype=bool)
        begins[starts[here]] = True
        n_here = int(here.sum())
        offsets = np.searchsorted(starts[:n_here], np.arange(rows + 1) * self.length).astype(np.int32)
        lists = lambda a: pa.FixedSizeListArray.from_arrays(pa.array(a), self.length)
        docs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(self.docs[:n_here], pa.int64()))
        self.out.write_batch(pa.record_batch([lists(flat[:size]), lists(mask), lists(begins), docs], schema=self.schema))
        self.begins = (starts[n_here:] - size).tolist()
        self.docs = self.docs[n_here:]
        self.held = [flat[size:]] if len(flat) > size else []
        self.n_held = max(0, self.n_held - size)

    def close(self) -> None:
        if self.n_held:
            self._write(-(-self.n_held // self.length))
        self.out.close()


def write_sequences(
    docs: DataFrame, folder: str, length: int = 2048, end_id: int = 2, path: str | None = None, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """Encode every text, append ``end_id``, write the ids in ascending ``doc_id`` order; returns the manifest.

    The manifest names each shard's file with its documents and tokens, in order of ``shard``. A shard is a range of
    document ids; null ids come first, rows with equal ids follow each other by text. Null texts count as empty, so every document has at least the
    end id. No document, no shard. Each task writes under a name of its own, and only files in the manifest count, so a
    task that runs twice does no harm. Extra columns are left out.
    """
    at = path or vocabulary()

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc = encoder(at)
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        writer, shard = None, TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.arrow"
        first = last = None
        n_docs = n_tokens = 0
        for pdf in frames:
            if writer is None and len(pdf):
                sink = fs.open_output_stream(f"{base}/{name}")
                writer = ShardWriter(sink, length, enc.dtype)
                first = pdf["doc_id"].iloc[0]
            end = np.array([end_id], dtype=enc.dtype).tobytes()
            for k in range(0, len(pdf), 500):
                part = pdf.iloc[k : k + 500]
                for doc_id, raw in zip(part["doc_id"], enc.encode(part["text"])):
                    doc_id = None if pd.isna(doc_id) else int(doc_id)
                    ids = np.frombuffer(raw + end, dtype=enc.dtype)
                    writer.add(doc_id, ids)
                    last, n_docs, n_tokens = doc_id, n_docs + 1, n_tokens + len(ids)
        if writer is not None:
            writer.close()
            sink.close()
            first = None if pd.isna(first) else int(first)
            row = pd.DataFrame([[shard, f"{folder}/{name}", first, last, n_docs, n_tokens]], columns=[c.split()[0] for c in MANIFEST.split(", ")])
            yield row.astype({"first_doc": "Int64", "last_doc": "Int64"})

    rows = bounded_batches(docs).select("doc_id", text_of().alias("text"))
    sized = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-sized // shard_bytes))
    ordered = rows.repartitionByRange(int(shards), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "text"
    )
    return cut(ordered.mapInPandas(write, MANIFEST))


def open_shard(file: str) -> pa.ipc.RecordBatchFileReader:
    """Random access to a shard: mapped into memory on a local or mounted disk, read by range elsewhere."""
    from pyarrow import fs

    system, path = filesystem(file)
    if isinstance(system, fs.LocalFileSystem):
        return pa.ipc.open_file(pa.memory_map(path))
    return pa.ipc.open_file(system.open_input_file(path))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and mask of sequence ``i`` of a shard; the ids are a view of the file's buffer."""
    batch = reader.get_batch(i // BATCH_ROWS)
    k = i % BATCH_ROWS
    ids, mask = batch.column("ids"), batch.column("mask")
    size = ids.type.list_size
    return ids.values.slice((ids.offset + k) * size, size).to_numpy(), mask.values.slice((mask.offset + k) * size, size).to_numpy(zero_copy_only=False)


def _documents(file: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """Document id and ids of every document of a shard, in order."""
    reader = open_shard(file)
    held: list[np.ndarray] = []
    current: list = []
    for b in range(reader.num_record_batches):
        batch = reader.get_batch(b)
        real = int(batch.column("mask").values.true_count)
        flat = batch.column("ids").values.to_numpy()[:real]  # padding only follows the last id
        starts = np.flatnonzero(batch.column("begins").values.to_numpy(zero_copy_only=False)).tolist()
        names = batch.column("doc_ids").flatten().to_pylist()
        for k, (doc_id, start) in enumerate(zip(names, starts)):
            if k == 0 and current:
                yield current[0], np.concatenate([*held, flat[:start]])
            stop = starts[k + 1] if k + 1 < len(starts) else None
            if stop is not None:
                yield doc_id, flat[start:stop]
            else:
                current, held = [doc_id], [flat[start:]]
        if not starts and current:
            held.append(flat)
    if current:
        yield current[0], np.concatenate(held)


def read_sequences(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, from the files alone.

    start: ids of all documents before it, over all shards. ids_crc32: unsigned crc32 of the ids as little-endian
    unsigned 32-bit integers. An empty manifest gives no row.
    """

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for shard, file in zip(pdf["shard"], pdf["file"]):
                rows, start = [], 0
                for k, (doc_id, ids) in enumerate(_documents(file)):
                    rows.append((shard, k, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    start += len(ids)
                    if len(rows) == 20_000:
                        yield _frame(rows)
                        rows = []
                if rows:
                    yield _frame(rows)

    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select(F.col("shard").alias("_s"), F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_base"))
    n = max(1, manifest.count())
    rows = manifest.select("shard", "file").repartitionByRange(n, "shard").mapInPandas(read, READ)
    return rows.join(bases, F.col("shard") == F.col("_s")).select(
        "doc_id", (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in READ.split(", ")]).astype({"doc_id": "Int64"})


def round_trip(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write, then read back; the folder is a new one in the shared storage unless given."""
    at = folder or scratch_path(docs.sparkSession, "sequences")
    return read_sequences(write_sequences(docs, at, **options))
