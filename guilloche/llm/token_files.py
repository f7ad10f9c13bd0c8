"""Token files: Parquet list columns in document order, with dictionary or delta encoding.

A file holds the documents of one key range in ascending order. Small row groups and a page
index let a reader fetch the ids of a few documents, and the id, length and offset columns
are read without any token page.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, small, stage
from .hashing import blocks
from .tokenize import encoder, vocabulary

_FILE = "doc_id long, shard long, start_in_shard long, n_tokens long, tokens array<int>"
_MANIFEST = "shard long, path string, n_docs long, n_tokens long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("shard", pa.int64()), ("start_in_shard", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.field("element", pa.int32())))])


def _options(encoding: str) -> dict:
    numbers = {"doc_id": "DELTA_BINARY_PACKED", "start_in_shard": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}
    if encoding == "delta":
        return {"use_dictionary": ["shard"], "column_encoding": numbers | {"tokens.list.element": "DELTA_BINARY_PACKED"}}
    if encoding == "dictionary":
        return {"use_dictionary": ["shard", "tokens.list.element"], "column_encoding": numbers}
    raise ValueError(f"encoding is dictionary or delta, not {encoding!r}")


def write_token_files(docs: DataFrame, path: str, vocabulary_path: str, *, end_id: int | None = 2, encoding: str = "dictionary", row_group_docs: int = 512, page_bytes: int = 64 << 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id`` and write token files below ``path``; returns their manifest.

    Documents are dealt out by ranges of their id and sorted within a range, so that files in
    order of ``shard`` hold all documents in ascending id order (a null id comes first; rows
    that repeat an id stand side by side). A null or empty text gives the end id alone. Files
    have names of their own for each attempt of a task, and only those of the attempts that
    Spark accepted are in the manifest, so a lost executor leaves no wrong file in it. An
    empty table gives an empty manifest. Other columns are ignored.
    """

    def write(batches):
        import pyarrow.parquet as pq
        from pyarrow import fs
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), encoder(vocabulary_path)
        store, base = fs.FileSystem.from_uri(path)
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        out, name, at, rows, held = None, f"{base}/shard-{shard:06d}-{uuid.uuid4().hex}.parquet", 0, 0, []

        def flush():
            nonlocal out, at, rows
            if out is None:
                store.create_dir(base, recursive=True)
                out = pq.ParquetWriter(name, _ARROW, filesystem=store, compression="zstd", data_page_size=page_bytes, write_page_index=True, **_options(encoding))
            n = np.array([len(x) // 4 for _, x in held], np.int64)
            starts = at + np.concatenate([[0], np.cumsum(n)])
            tokens = pa.ListArray.from_arrays(pa.array(starts - at, pa.int32()), pa.array(np.frombuffer(b"".join(x for _, x in held), "<i4")))
            out.write_table(pa.table([pa.array([i for i, _ in held], pa.int64()), pa.array([shard] * len(held), pa.int64()), pa.array(starts[:-1]), pa.array(n), tokens], schema=_ARROW), row_group_size=row_group_docs)
            at, rows = int(starts[-1]), rows + len(held)
            held.clear()

        size = 0
        for batch in batches:
            ids, texts, k = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for run in blocks(texts):
                for x in enc.encode(run):
                    held.append((ids[k], x + tail))
                    size, k = size + len(x), k + 1
                    if len(held) >= row_group_docs or size > 16 << 20:
                        flush()
                        size = 0
        if held:
            flush()
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [name], "n_docs": [rows], "n_tokens": [at]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return stage(rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id").mapInArrow(write, _MANIFEST), "token-manifest")


def read_token_files(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Rows of the files that the manifest names: ``_FILE`` columns plus ``start``, the ids of all documents before.

    Columns that are not asked for are not read; filters on ``doc_id`` skip row groups by
    their statistics. Only the manifest's files count, whatever else lies below ``path``.
    """
    files = [r.path for r in manifest.select("path").toLocalIterator()]
    if not files:
        return spark.createDataFrame([], _FILE).withColumn("start", F.lit(0).cast("long"))
    scheme = path.partition("://")[0] + "://" if "://" in path else ""
    rows = spark.read.schema(_FILE).parquet(*[scheme + f for f in files])
    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = manifest.select("shard", before.alias("base"))
    return rows.join(small(bases), "shard").withColumn("start", F.col("base") + F.col("start_in_shard")).drop("base")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Digest columns doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def digest(batches):
        for b in batches:
            lists = b.column(3)
            lists = lists.cast(pa.list_(pa.int32())) if lists.type != pa.list_(pa.int32()) else lists
            data, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            crc = [zlib.crc32(data[i:j].tobytes()) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = new_path(spark, "token-files")
    manifest = write_token_files(docs, path, vocabulary("word_bpe_49k.json"), end_id=2)
    return with_crc32(read_token_files(spark, manifest, path))
