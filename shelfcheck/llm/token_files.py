"""Token files: flat unsigned ids plus 64-bit document offsets, memory-mapped on reading.

Documents are dealt by ranges of their id (equal ids by text hash), each task writes one ``.bin`` file with the
ids of its documents back to back, one ``.off`` file with n + 1 little-endian 64-bit offsets, and one ``.doc``
Parquet file with the document ids. A task names its files by attempt; the manifest, written by Spark's own
commit, lists the files that count, so a task that runs again after a lost executor leaves no double. Prefix
sums of the file totals give each file its base in the whole sequence.

Null texts are empty and have the end id alone. Null document ids come first. Repeated rows are kept. An empty
table gives an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, saved, shared_folder
from .pieces import encoder

MANIFEST = "part int, stem string, n_docs long, n_tokens long"
_STEP = 1 << 21


def _write_part(folder: str, vocabulary: str, end_id: int, dtype: str):
    def run(batches) -> Iterator:
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        context = TaskContext.get()
        stem = f"{folder}/tokens-{context.partitionId():06d}-{context.taskAttemptId()}"
        store, path = filesystem(stem)
        ids_of, end = encoder(vocabulary).ids, np.array([end_id], dtype).tobytes()
        out, docs, offsets, kind = None, [], [np.zeros(1, "<i8")], None
        for batch in batches:
            if out is None:
                store.create_dir(os.path.dirname(path), recursive=True)
                out = store.open_output_stream(f"{path}.bin")
            lengths = []
            for text in batch.column(1):
                ids = np.frombuffer(ids_of(text.as_py()), "<u4")
                if len(ids) and ids.max() > np.iinfo(dtype).max:
                    raise ValueError(f"token id {ids.max()} does not fit {dtype}; use <u4")
                ids = ids.astype(dtype)
                out.write(ids.tobytes() + end)
                lengths.append(len(ids) + 1)
            docs.append(batch.column(0))
            kind = batch.schema.field(0)
            offsets.append(offsets[-1][-1] + np.cumsum(lengths, dtype="<i8"))
        if out is None:
            return
        out.close()
        offsets = np.concatenate(offsets)
        with store.open_output_stream(f"{path}.off") as f:
            f.write(offsets.tobytes())
        with store.open_output_stream(f"{path}.doc") as f:
            pq.write_table(pa.table([pa.chunked_array(docs)], schema=pa.schema([kind])), f)
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([context.partitionId()], pa.int32()), "stem": [stem],
            "n_docs": pa.array([len(offsets) - 1], pa.int64()), "n_tokens": pa.array([int(offsets[-1])], pa.int64())})

    return run


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None,
                      id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Write all documents in ascending id order; returns the manifest, one row for each file.

    ``dtype`` must hold the largest id, ``<u2`` or ``<u4``; an id beyond it stops the job.
    """
    folder = folder or shared_folder(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h")
    dealt = dealt.sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return saved(dealt.mapInArrow(_write_part(folder, vocabulary, end_id, dtype), MANIFEST), "token-manifest")


class TokenFile:
    """One written file: ``ids(a, b)`` reads ids a to b, by memory map where the store is a local one."""

    def __init__(self, stem: str, dtype: str = "<u2"):
        from pyarrow import fs

        self.store, self.path = filesystem(stem)
        self.dtype = np.dtype(dtype)
        with self.store.open_input_file(f"{self.path}.off") as f:
            self.offsets = np.frombuffer(f.read(), "<i8")
        local = isinstance(self.store, fs.LocalFileSystem)
        self.map = np.memmap(f"{self.path}.bin", self.dtype, "r") if local and self.offsets[-1] else None

    def ids(self, a: int, b: int) -> np.ndarray:
        if self.map is not None or a == b:
            return self.map[a:b] if a < b else np.empty(0, self.dtype)
        with self.store.open_input_file(f"{self.path}.bin") as f:
            return np.frombuffer(f.read_at((b - a) * self.dtype.itemsize, a * self.dtype.itemsize), self.dtype)

    def doc_ids(self):
        import pyarrow.parquet as pq

        with self.store.open_input_file(f"{self.path}.doc") as f:
            return pq.read_table(f).column(0)


def based(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """The manifest with ``base``, the ids in all earlier files. The driver sees one row for each file."""
    files = sorted(manifest.collect())
    bases = np.cumsum([0, *[x.n_tokens for x in files]])
    rows = [(*x, int(b)) for x, b in zip(files, bases, strict=False)]
    return spark.createDataFrame(rows, MANIFEST + ", base long").repartition(max(1, len(rows)))


def read_token_files(spark: SparkSession, manifest: DataFrame, dtype: str = "<u2", doc_type: str = "long") -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens and the crc32 of its ids as unsigned 32-bit."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for stem, base in zip(batch.column("stem").to_pylist(), batch.column("base").to_pylist(), strict=True):
                file = TokenFile(stem, dtype)
                off, docs = file.offsets, file.doc_ids().combine_chunks()
                for at in range(0, len(off) - 1, 4096):
                    o = off[at : at + 4097]
                    crcs = []
                    for a, b in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                        crc = 0
                        for i in range(a, b, _STEP):
                            crc = zlib.crc32(file.ids(i, min(b, i + _STEP)).astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    yield pa.RecordBatch.from_arrays([
                        docs.slice(at, len(crcs)), pa.array(base + o[:-1]), pa.array(np.diff(o)),
                        pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    schema = f"doc_id {doc_type}, start long, n_tokens long, ids_crc32 long"
    return based(spark, manifest).select("stem", "base").mapInArrow(run, schema)
