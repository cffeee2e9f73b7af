"""Token-ID output: Arrow IPC files of equal-length sequences with masks (operator 7).

Documents are put in ascending ``doc_id`` order by a range shuffle (ties: by text, so reruns
agree), encoded, and written as one pair of files for each range:

* ``part-NNNNN.arrow``: record batches of a fixed-size-list column ``ids``, one row for each sequence of
  ``seq_len`` ids, and ``length``, how many of them count.  The lists have no offsets, so sequence ``i`` lies
  at a fixed place of the mapped file and is read without copying; its mask is ``length`` ones and then
  zeros, a view of one constant row.  Only the last sequence of a file is padded.
* ``part-NNNNN.index.arrow``: ``doc_id``, ``start`` (ids before it in this file), ``n_tokens``.

Files appear under a temporary name and are moved into place when complete, under a name that
depends on the range only, so a task that runs again replaces its own file.

Defined cases: null text counts as empty (the end id alone); repeated ``doc_id`` rows each keep
their own ids, one after another in the order of their texts; equal rows are interchangeable; very long texts run over as
many sequences as they need; an empty table writes no file; columns of other names are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs, ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veridian.llm._bpe import default_tokenizer, encoder
from veridian.llm._shared import delete, folder_of, materialize, new_folder, read_table, shuffle_partitions
from veridian.llm._textbytes import row_blocks

MANIFEST = "shard int, path string, n_docs long, n_tokens long, n_sequences long"
READ_BACK = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _schema(seq_len: int, width: int) -> pa.Schema:
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([("ids", pa.list_(kind, seq_len)), ("length", pa.int32())])


class SequenceFile:
    """Writes equal-length sequences as fixed-size-list batches, some rows at a time."""

    def __init__(self, sink, seq_len: int, dtype: np.dtype, rows: int = 256):
        self.schema = _schema(seq_len, np.dtype(dtype).itemsize)
        self.writer = ipc.new_file(sink, self.schema)
        self.seq_len, self.block = seq_len, seq_len * rows
        self.held: list[np.ndarray] = []
        self.n_held, self.n_sequences, self.dtype = 0, 0, dtype

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            cut = len(flat) // self.block * self.block
            for at in range(0, cut, self.block):
                self._write(flat[at : at + self.block], self.block)
            self.held, self.n_held = [flat[cut:]], len(flat) - cut

    def _write(self, flat: np.ndarray, used: int) -> None:
        lengths = np.clip(used - np.arange(0, len(flat), self.seq_len), 0, self.seq_len).astype(np.int32)
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(pa.array(flat), self.seq_len), pa.array(lengths)], schema=self.schema))
        self.n_sequences += len(flat) // self.seq_len

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            padded = np.zeros(-(-len(flat) // self.seq_len) * self.seq_len, dtype=self.dtype)
            padded[: len(flat)] = flat
            self._write(padded, len(flat))
        self.writer.close()


class SequenceReader:
    """Random access to the sequences of one file; local files are mapped, not read."""

    def __init__(self, path: str):
        store, at = fs.FileSystem.from_uri(path)
        self.source = pa.memory_map(at) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(at)
        self.file = ipc.open_file(self.source)
        self.seq_len = self.file.schema.field("ids").type.list_size
        # a mask is ones and then zeros, so every mask is a stretch of this
        self.masks = np.arange(2 * self.seq_len) < self.seq_len
        self.per_batch = self.file.get_batch(0).num_rows if self.file.num_record_batches else 1

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and mask of sequence ``i``, both views: of the file, and of one row of ones and zeros."""
        batch, k = self.file.get_batch(i // self.per_batch), i % self.per_batch
        length = batch.column(1)[k].as_py()
        return batch.column(0).values.to_numpy()[k * self.seq_len : (k + 1) * self.seq_len], self.masks[self.seq_len - length : 2 * self.seq_len - length]

    def flat_batches(self) -> Iterator[np.ndarray]:
        """The ids that the masks keep, batch by batch."""
        for i in range(self.file.num_record_batches):
            batch = self.file.get_batch(i)
            # only the last sequence of a file is padded
            yield batch.column(0).values.to_numpy()[: int(batch.column(1).to_numpy().sum(dtype=np.int64))]


def write_token_stream(docs: DataFrame, folder: str, tokenizer: str | None = None, seq_len: int = 2048, end_id: int = 2) -> DataFrame:
    """Encode ``docs`` (doc_id, text) in ascending ``doc_id`` order into ``folder``; the manifest, one row for each file."""
    spark = docs.sparkSession
    path = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, ids_done, doc_ids, lengths = None, 0, [], []
        shard = TaskContext.get().partitionId()
        store, base = fs.FileSystem.from_uri(folder)
        name, own = f"part-{shard:05d}", f".{TaskContext.get().taskAttemptId()}"
        enc = encoder(path)
        for batch in batches:
            for block in row_blocks(batch, "text"):
                if out is None:
                    store.create_dir(base, recursive=True)
                    sink = store.open_output_stream(f"{base}/{name}{own}")
                    out = SequenceFile(sink, seq_len, enc.dtype)
                ids, bounds = enc.encode(block.column(1), end_id)
                out.add(ids)
                ids_done += len(ids)
                doc_ids.append(block.column(0))
                lengths.append(np.diff(bounds))
        if out is None:
            return
        out.close()
        sink.close()
        n = np.concatenate(lengths)
        index = pa.table({"doc_id": pa.chunked_array(doc_ids).combine_chunks(), "start": np.cumsum(n) - n, "n_tokens": n})
        with store.open_output_stream(f"{base}/{name}.index{own}") as f, ipc.new_file(f, index.schema) as w:
            w.write_table(index)
        store.move(f"{base}/{name}.index{own}", f"{base}/{name}.index.arrow")
        store.move(f"{base}/{name}{own}", f"{base}/{name}.arrow")
        yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), *(pa.array([v], pa.int64()) for v in (len(n), ids_done, out.n_sequences))], names=["shard", "path", "n_docs", "n_tokens", "n_sequences"])

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        # the beginning of the text parts rows that share an id
        .repartitionByRange(shuffle_partitions(spark), "doc_id", F.substring("text", 1, 32))
        .sortWithinPartitions("doc_id", "text")
    )
    manifest = materialize(ordered.mapInArrow(write, MANIFEST), "manifest")
    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    return manifest


def read_token_stream(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the written files: doc_id, start over all files, n_tokens, crc32 of the ids."""
    # one row for each file, as many as shuffle partitions: small on any corpus
    files, before, rows = manifest.orderBy("shard").collect(), 0, []
    for f in files:
        rows.append((f.path, before))
        before += f.n_tokens
    if not rows:
        return spark.createDataFrame([], READ_BACK)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, at = fs.FileSystem.from_uri(f"{path}.index.arrow")
                with store.open_input_file(at) as f:
                    index = ipc.open_file(f).read_all()
                ends = np.cumsum(index["n_tokens"].to_numpy())
                crc, done, k, value = [], 0, 0, 0
                for ids in SequenceReader(f"{path}.arrow").flat_batches():
                    data, first = ids.astype("<u4"), done
                    done += len(data)
                    while k < len(ends) and ends[k] <= done:
                        begin = max(0, (ends[k - 1] if k else 0) - first)
                        crc.append(zlib.crc32(data[begin : ends[k] - first], value))
                        k, value = k + 1, 0
                    if k < len(ends):
                        begin = max(0, (ends[k - 1] if k else 0) - first)
                        value = zlib.crc32(data[begin:], value)
                yield pa.record_batch([index["doc_id"].combine_chunks(), pa.array(index["start"].to_numpy() + base), index["n_tokens"].combine_chunks(), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    places = spark.createDataFrame(rows, "path string, base long").repartition(min(len(rows), shuffle_partitions(spark)))
    return places.mapInArrow(read, READ_BACK)


def op7_token_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written, and read back from the files."""
    docs = read_table(spark, sf_dir, "documents")
    manifest = write_token_stream(docs, new_folder(spark, "tokens"))
    out = read_token_stream(spark, manifest)
    delete(spark, folder_of(manifest)) if manifest.inputFiles() else None
    return out
