"""Sequence packing by shortest-pack-first over the length histogram.

Only the histogram, with one entry for each possible length, meets on the driver. It is
placed longest length first: each length goes to the shortest open pattern that it fits,
and what changes is how many packs follow a pattern. Documents then find their pack by
their rank among the pieces of equal length.
"""

from __future__ import annotations

import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage
from .hashing import blocks
from .tokenize import encoder, vocabulary

#: Groups into which the pieces of one length are dealt, so that no length is ranked by one task.
RANK_GROUPS = 256
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pack_histogram(counts: dict[int, int], size: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Patterns (number of packs, [(length, how many of it), ...]) that use up the histogram.

    Lengths are placed longest first. A length goes to the shortest pattern, the one with the
    most room, as long as it fits; one pack takes as many of it as fit at once only while
    enough are left. Patterns are at most twice as many as lengths.
    """
    open_: list[tuple[int, int]] = []  # (-used, key): the shortest stands last
    packs: dict[int, tuple[int, int, list[tuple[int, int]]]] = {}
    fresh = 0

    def put(used: int, n: int, parts: list[tuple[int, int]]) -> None:
        nonlocal fresh
        packs[fresh] = (used, n, parts)
        if used < size:
            insort(open_, (-used, fresh))
        fresh += 1

    for length in sorted((k for k, n in counts.items() if n > 0), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a length is from 1 to {size}, not {length}")
        left = counts[length]
        while left:
            if open_ and size + open_[-1][0] >= length:
                _, key = open_.pop()
                used, n, parts = packs.pop(key)
                many = min((size - used) // length, max(1, left // n))
                take = min(n, left // many)
                if take < n:
                    put(used, n - take, parts)
                put(used + many * length, take, [*parts, (length, many)])
                left -= take * many
            else:
                many = min(size // length, left)
                take = left // many
                put(many * length, take, [(length, many)])
                left -= take * many
    return [(n, parts) for _, n, parts in packs.values()]


def cut_pieces(docs: DataFrame, vocabulary_path: str, size: int, end_id: int, *, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` and cut each document into full sequences and a rest."""

    def pieces(batches):
        enc, tail = encoder(vocabulary_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts, k = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for run in blocks(texts):
                rows: list[list] = [[], [], [], [], []]
                data = []
                for x in enc.encode(run):
                    x += tail
                    for at in range(0, len(x), 4 * size):
                        part = x[at : at + 4 * size]
                        for column, v in zip(rows, (ids[k], at // 4, len(part) // 4, zlib.crc32(part), len(x) // 4)):
                            column.append(v)
                        if with_ids:
                            data.append(np.frombuffer(part, "<i4"))
                    k += 1
                columns = [pa.array(c, pa.int64()) for c in rows] + ([pa.array(data, pa.list_(pa.int32()))] if with_ids else [])
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(columns)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(pieces, _PIECES + (", ids array<int>" if with_ids else ""))


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (doc_id, start, length, ...) of length 1 to ``size``.

    Ranks are counted within a length and one of ``RANK_GROUPS`` groups by the hash of the
    piece, after the groups before; only the histogram of lengths is gathered. Equal
    rows are told apart by their rank. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    grouped = stage(pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "start"), F.lit(RANK_GROUPS)).cast("int")), "pieces")
    counts = grouped.groupBy("length", "_g").agg(F.count("*").alias("_c"))
    before = Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # at most RANK_GROUPS rows a length
    bases = counts.select("length", "_g", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    by_length = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_c").alias("n")).collect()}  # at most size rows
    # For each length its runs of ranks: first rank, first sequence, pieces a sequence, offset of the first of them.
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    sequence = 0
    for n, parts in pack_histogram(by_length, size):
        offset = 0
        for length, many in parts:
            rank = seen.get(length, 0)
            runs.setdefault(length, []).append((rank, sequence, many, offset))
            seen[length] = rank + n * many
            offset += length * many
        sequence += n
    tables = spark.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in runs.items()})
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches):
        runs = tables.value
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_n"))
            seq, off = np.zeros_like(rank), np.zeros_like(rank)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, edges) if len(order) else []:
                run = runs[int(length[at[0]])]
                k = np.searchsorted(run[:, 0], rank[at], "right") - 1
                within = rank[at] - run[k, 0]
                seq[at] = run[k, 1] + within // run[k, 2]
                off[at] = run[k, 3] + within % run[k, 2] * length[at]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(names) - 2)] + [pa.array(seq), pa.array(off)], names)

    ranked = grouped.withColumn("_n", F.row_number().over(Window.partitionBy("length", "_g").orderBy("doc_id", "start")).cast("long"))
    ranked = ranked.join(bases, ["length", "_g"]).withColumn("_n", F.col("_n") + F.col("_b") - 1)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.select(*pieces.columns, "_n").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary_path: str, *, size: int = 2048, end_id: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all whole texts into sequences of at most ``size`` ids; one row for each piece.

    A document is cut only where it exceeds ``size``: into full sequences and a rest, and the
    rests are packed. Null and empty texts are the end id alone; documents that repeat an id
    are packed each on its own; a null id stays null; other columns are left out. With
    ``with_ids`` the pieces carry their ids.
    """
    return pack(cut_pieces(docs, vocabulary_path, size, end_id, with_ids=with_ids, id_col=id_col, text_col=text_col), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"), size=2048, end_id=1)
