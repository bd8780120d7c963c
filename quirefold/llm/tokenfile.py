"""Token ids of a corpus in Arrow files of equal-length sequences with masks.

A shard is two Arrow IPC files (the stream format with a footer, so any batch can be reached without reading others):

* ``*.tokens.arrow``: columns ``ids`` (fixed-size list of uint16 or uint32) and ``mask`` (fixed-size list of bool); the
  shard's ids run through the sequences one after another, and only the last sequence is padded (mask false).
* ``*.docs.arrow``: one row per document, ``doc_id``, ``start`` (ids of the shard before it), ``n_tokens``.

Shards hold ascending ranges of doc_id.  ``manifest`` is a Parquet table naming the files of the tasks that succeeded;
files of lost or repeated tasks are not in it and are never read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytebpe import encoder
from .common import filesystem, qualified, texts, tidy, tune

MANIFEST = "shard int, tokens_file string, docs_file string, n_docs long, n_ids long, n_sequences long"


def fixed(values: np.ndarray, length: int) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values), length)


class ShardWriter:
    """Appends documents to the two files of a shard; holds one batch of sequences and one of documents at most."""

    def __init__(self, folder: str, name: str, dtype: np.dtype, length: int, batch: int) -> None:
        store, path = filesystem(folder)
        store.create_dir(path, recursive=True)
        self.length, self.size, self.dtype = length, length * batch, dtype
        self.names = f"{name}.tokens.arrow", f"{name}.docs.arrow"
        self.files = [store.open_output_stream(f"{path}/{n}") for n in self.names]
        kind = pa.from_numpy_dtype(dtype)
        tokens = pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.docs_schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.tokens, self.docs = pa.ipc.new_file(self.files[0], tokens), pa.ipc.new_file(self.files[1], self.docs_schema)
        self.schema, self.parts, self.held, self.n_ids, self.n_docs, self.n_seq = tokens, [], 0, 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, bounds: np.ndarray) -> None:
        """Documents in order: their ids one after another, with the bounds of each."""
        self.docs.write_batch(pa.record_batch([doc_ids, pa.array(bounds[:-1] + self.n_ids), pa.array(np.diff(bounds))], schema=self.docs_schema))
        self.n_ids += len(ids)
        self.n_docs += len(doc_ids)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.size:
            self._flush(self.held // self.size * self.size)

    def _flush(self, take: int) -> None:
        flat = np.concatenate(self.parts)
        for at in range(0, take, self.size):
            part = flat[at : at + self.size]
            real = len(part)
            full = -(-real // self.length) * self.length
            if full > real:
                part = np.concatenate([part, np.zeros(full - real, self.dtype)])
            self.tokens.write_batch(pa.record_batch([fixed(part, self.length), fixed(np.arange(full) < real, self.length)], schema=self.schema))
            self.n_seq += full // self.length
        self.parts, self.held = ([flat[take:].copy()], self.held - take) if self.held > take else ([], 0)

    def close(self) -> None:
        if self.held:
            self._flush(self.held)
        for x in (self.tokens, self.docs, *self.files):
            x.close()


class TokenShard:
    """Random access to the sequences of a shard's token file; on a local path the arrays are views of the mapped file."""

    def __init__(self, uri: str) -> None:
        uri = f"file://{uri}" if uri.startswith("/") else uri
        store, path = filesystem(uri)
        local = uri.startswith("file:")
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else store.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batch = self.reader.get_batch(0).num_rows if self.reader.num_record_batches else 0

    def __len__(self) -> int:
        n = self.reader.num_record_batches
        return (n - 1) * self.batch + self.reader.get_batch(n - 1).num_rows if n else 0

    def __getitem__(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """(ids, mask) of sequence i: all batches but the last are equally long, so its place follows from i."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        batch = self.reader.get_batch(i // self.batch)
        row = i % self.batch
        ids, mask = batch.column(0), batch.column(1)
        return ids.values.to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length], mask.values.slice(row * self.length, self.length)

    def runs(self) -> Iterator[np.ndarray]:
        """All real ids in order, a batch at a time."""
        for k in range(self.reader.num_record_batches):
            batch = self.reader.get_batch(k)
            flat = batch.column(0).values.to_numpy(zero_copy_only=True)
            last = k == self.reader.num_record_batches - 1
            yield flat[: int(batch.column(1).values.true_count)] if last else flat


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 0, length: int = 2048, batch: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append end_id, and write the ids in ascending order of doc_id; gives the manifest.

    Null texts count as empty (their only id is end_id).  Rows with one doc_id follow each other by text, null ids come
    first.  An empty table gives an empty manifest.  Texts move once, to ranges of doc_id; a task holds one batch of each.
    """
    spark = docs.sparkSession
    tune(spark)
    folder = qualified(spark, folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, out = encoder(tokenizer_path), None
        for b in batches:
            if out is None:
                shard = TaskContext.get().partitionId()
                out = ShardWriter(f"{folder}/shards", f"{shard:06d}-{uuid.uuid4().hex[:12]}", code.dtype, length, batch)
            for at, to, ids, bounds in code.runs(b.column(1), end_id):
                out.add(b.column(0).slice(at, to - at), ids, bounds)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "tokens_file": out.names[0], "docs_file": out.names[1], "n_docs": out.n_docs, "n_ids": out.n_ids, "n_sequences": out.n_seq}], schema=pa.schema([("shard", pa.int32()), ("tokens_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_sequences", pa.int64())]))

    ordered = texts(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(tidy(write), MANIFEST).write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start in the whole corpus, n_tokens, ids_crc32, shard, shard_start.

    A task reads one shard, whatever its name's bytes are.  Repeated and null ids come back as they were written, in the
    order of the files; an empty manifest gives no rows.
    """
    folder = qualified(spark, folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    # one row for each shard: their number follows the number of write tasks, not the corpus
    based = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("shard_start", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                yield from read_shard(f"{folder}/shards", row)

    def read_shard(where: str, row: dict) -> Iterator[pa.RecordBatch]:
        store, path = filesystem(f"{where}/{row['docs_file']}")
        index = pa.ipc.open_file(store.open_input_file(path))
        runs, run, at = TokenShard(f"{where}/{row['tokens_file']}").runs(), np.empty(0, np.uint32), 0
        for k in range(index.num_record_batches):
            docs = index.get_batch(k)
            crcs = []
            for n in docs.column("n_tokens").to_numpy():
                crc, left = 0, int(n)
                while left:
                    if at == len(run):
                        run, at = next(runs).astype("<u4"), 0
                    step = min(left, len(run) - at)
                    crc = zlib.crc32(run[at : at + step], crc)
                    at, left = at + step, left - step
                crcs.append(crc)
            start = docs.column("start").to_numpy()
            yield pa.record_batch([docs.column("doc_id"), pa.array(start + row["base"]), docs.column("n_tokens"), pa.array(crcs, pa.int64()), pa.array(np.full(len(start), row["shard"], np.int32)), pa.array(start)], schema=schema)

    # a number that is given stays: adaptive execution would put all of the few small rows into one task
    return based.repartition(max(1, manifest.count())).mapInArrow(tidy(read), "doc_id long, start long, n_tokens long, ids_crc32 long, shard int, shard_start long")
