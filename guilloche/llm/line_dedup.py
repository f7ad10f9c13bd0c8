"""Line deduplication by pairwise alignment.

Documents meet through hashes of the shortest runs of lines that have enough words to go: the
one from each line on and the one up to each line, so that every line of a block lies in a
run that is looked up. A run that several documents share belongs to the first of them. A
document is aligned with the owner of its rarest shared run, and with the owners of those
runs that the first one lacks; so a notice in a million documents makes a million pairs at
most, not their square. Patience diff aligns a pair on the lines that occur once in both;
what it leaves is looked up in the whole earlier document, so that repeated and swapped
blocks are found as well. Common blocks of enough words are deleted from the later document.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage

_LINES = "id long, text_key long, lines array<long>, words array<int>, runs array<long>"


def _key(line: str) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(line.split()).encode("utf-8", "surrogatepass")) - (1 << 63)


def _longest_rising(values: list[int]) -> list[int]:
    """Positions of a longest increasing run of values."""
    tails: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        back.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned pairs (position in a, position in b) of equal lines, rising in both.

    Equal lines at both ends match; lines that occur once in each side anchor the rest, by a
    longest increasing run; what lies between anchors is aligned in the same way.
    """
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        once_a, once_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: j for j, x in enumerate(b[b0:b1], b0) if once_b[x] == 1}
        unique = [(i, where[x]) for i, x in enumerate(a[a0:a1], a0) if once_a[x] == 1 and x in where]
        last_a, last_b = a0, b0
        chosen = [unique[k] for k in _longest_rising([j for _, j in unique])]
        for i, j in chosen:
            out.append((i, j))
            todo.append((last_a, i, last_b, j))
            last_a, last_b = i + 1, j + 1
        if chosen:
            todo.append((last_a, a1, last_b, b1))
    return sorted(out)


def shortest_runs(words: list[int], min_words: int) -> set[tuple[int, int]]:
    """(first line, line after the last) of the shortest runs of ``min_words`` words that start, or end, at each line with words.

    Whatever longer run two documents share, each of its lines with words lies in one of these.
    """
    out, least = set(), max(1, min_words)
    total = end = 0
    for first, n in enumerate(words):
        while end < len(words) and total < least:
            total, end = total + words[end], end + 1
        if total < least:
            break
        if n:
            out.add((first, end))
        total -= n
    total = first = 0
    for end, n in enumerate(words, 1):
        total += n
        while total - words[first] >= least:
            total, first = total - words[first], first + 1
        if n and total >= least:
            out.add((first, end))
    return out


def common_blocks(earlier: list[int], later: list[int], words: list[int], min_words: int) -> list[tuple[int, int]]:
    """Ranges (first line, line after the last) of the later document that the earlier one holds in runs of enough words.

    One alignment finds the blocks that stand in the same order. Where it leaves lines with
    words, repeated passages and passages in another order are looked up in the whole
    earlier document.
    """
    gone, run = bytearray(len(later)), None
    for i, j in [*patience(earlier, later), (-9, -9)]:
        if run and i == run[2] + 1 and j == run[1]:
            run = (run[0], j + 1, i)
            continue
        if run and sum(words[run[0] : run[1]]) >= min_words:
            gone[run[0] : run[1]] = b"\1" * (run[1] - run[0])
        run = (j, j + 1, i)
    if any(n and not g for n, g in zip(words, gone)):
        count = dict(zip(later, words))  # a line that the later document has not is in no common run
        known = array("q", earlier).tobytes()
        runs = {known[8 * a : 8 * b] for a, b in shortest_runs([count.get(x, 0) for x in earlier], min_words)}
        own = array("q", later).tobytes() if runs else b""
        for a, b in shortest_runs(words, min_words) if runs else ():
            if own[8 * a : 8 * b] in runs:
                gone[a:b] = b"\1" * (b - a)
    edges = [j for j in range(len(gone) + 1) if (j > 0 and gone[j - 1]) != (j < len(gone) and gone[j])]
    return list(zip(edges[::2], edges[1::2]))


def document_lines(docs: DataFrame, min_words: int) -> DataFrame:
    """Line hashes, words of each line and hashes of the shortest runs of ``min_words`` words, for each row of ``docs`` with an id."""

    def run(batches):
        for batch in batches:
            ids, keys, lines, words, runs = batch.column(0).to_pylist(), batch.column(1), [], [], []
            for t in batch.column(2):
                rows = (t.as_py() or "").split("\n")
                lines.append([_key(x) for x in rows])
                words.append([len(x.split()) for x in rows])
                packed = array("q", lines[-1]).tobytes()
                runs.append(list({xxhash.xxh3_64_intdigest(packed[8 * a : 8 * b]) - (1 << 63) for a, b in shortest_runs(words[-1], min_words)}))
            columns = [pa.array(ids, pa.int64()), keys, *(pa.array(c, pa.list_(t)) for c, t in ((lines, pa.int64()), (words, pa.int32()), (runs, pa.int64())))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "text_key", "lines", "words", "runs"])

    return docs.mapInArrow(run, _LINES)


def pairs_of(lines: DataFrame) -> DataFrame:
    """(owner, owner_key, id, text_key): documents and the earlier ones that they are aligned with.

    Documents are in order of id, those of equal id in order of their text's hash. A run
    belongs to the first document that holds it, its owner. A document meets the owner of its
    rarest shared run first. A commoner run, such as a notice that every page repeats, makes
    a pair of its own only if that owner does not hold it too. Whatever run a document shares with
    an earlier one is thus held by one that it is aligned with.
    """
    seeds = stage(lines.select(F.struct("id", "text_key").alias("row"), F.explode("runs").alias("h")), "line-seeds")
    # The owners are written before they meet the seeds again: a very common run then is a
    # skewed key of a plain join, which Spark splits, and not of an aggregate.
    known = seeds.groupBy("h").agg(F.min("row").alias("owner"), F.max("row").alias("last"), F.count("*").alias("df"))
    owners = stage(known.where("owner < last").select("h", "owner", "df"), "line-owners")
    met = stage(seeds.join(owners, "h").where("owner < row").select("row", "h", "owner", "df"), "line-met")
    rarest = stage(met.groupBy("row").agg(F.min_by("owner", F.struct("df", "h")).alias("first")), "line-rarest")
    others = met.join(rarest, "row").where("owner != first").select("row", "h", "owner", "first")
    holders = met.select(F.col("row").alias("first"), "h").unionByName(owners.select(F.col("owner").alias("first"), "h"))
    more = others.join(holders, ["first", "h"], "left_anti").select("row", "owner")
    pairs = rarest.select("row", F.col("first").alias("owner")).unionByName(more).distinct()
    return pairs.select(F.col("owner.id").alias("owner"), F.col("owner.text_key").alias("owner_key"), "row.id", "row.text_key")


def duplicate_spans(docs: DataFrame, *, min_words: int = 10) -> DataFrame:
    """(id, text_key, spans): line ranges of each document that an aligned earlier document has as well.

    ``docs``: id, text_key, text, none of them null. Rows of equal id and text are one document.
    """
    lines = stage(document_lines(docs, min_words).dropDuplicates(["id", "text_key"]), "lines")
    pairs = stage(pairs_of(lines), "line-pairs")
    once = lines.select("id", "text_key", "lines", "words")
    owners = once.select(F.col("id").alias("owner"), F.col("text_key").alias("owner_key"), F.col("lines").alias("earlier"))
    both = pairs.join(owners, ["owner", "owner_key"]).join(once, ["id", "text_key"])
    schema = pa.schema([("id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))])

    def align(batches):
        for batch in batches:
            rows = []
            for i, k, first, later, words in zip(*(batch.column(n).to_pylist() for n in range(5))):
                if found := common_blocks(first, later, words, min_words):
                    rows.append({"id": i, "text_key": k, "spans": [{"a": x, "b": y} for x, y in found]})
            yield pa.RecordBatch.from_pylist(rows, schema)

    found = both.select("id", "text_key", "earlier", "lines", "words").mapInArrow(align, "id long, text_key long, spans array<struct<a:int,b:int>>")
    # A document has one row for each document that it is aligned with: at most as many as it has runs.
    return found.groupBy("id", "text_key").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))


def deduplicate(docs: DataFrame, *, min_words: int = 10, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with its own columns, ``text`` without the duplicate blocks and three counts more: n_lines, n_removed, removed_chars.

    Lines are equal if their words are. A block is a run of lines that any earlier document,
    one with a smaller ``id_col``, holds without a gap. It goes if it has ``min_words`` words
    or more, so short lines that many documents happen to share stay. Its order and number in
    either document do not matter. A blank line beside a block goes if the documents that it
    is compared with have it there. Deletions refer to the texts as they came, and the first
    holder of a block keeps it. Null and empty texts stay as they are. Rows of equal id are in
    order of their text's hash, and equal ones lose the same lines. A row without id is
    neither compared nor changed. Empty tables give no rows. Columns of ``docs`` may have any
    names; those named like an added count are replaced.
    """
    added = ("n_lines", "n_removed", "removed_chars")
    own = [c for c in docs.columns if c not in added]
    text = F.col("text").cast("string")
    keyed = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.alias("raw"), F.xxhash64(text).alias("text_key"), F.struct(*[F.col(f"`{c}`") for c in own if c != "text"]).alias("own") if own != ["text"] else F.lit(None).alias("own"))
    spans = duplicate_spans(keyed.where("id is not null and raw is not null").select("id", "text_key", "raw"), min_words=min_words)
    spans = stage(spans, "line-spans")
    # Merged at any size: a broadcast on small inputs alone would hide what the texts cost to shuffle.
    joined = keyed.join(spans.hint("merge"), ["id", "text_key"], "left")
    is_gone = lambda i: F.exists("spans", lambda s: (s["a"] <= i) & (i < s["b"]))
    marked = F.transform(F.split("raw", "\n", -1), lambda x, i: F.struct(x.alias("x"), is_gone(i).alias("gone")))
    kept = F.array_join(F.transform(F.filter(marked, lambda v: ~v["gone"]), lambda v: v["x"]), "\n")
    whole = F.col("spans").isNull()
    counted = joined.select(
        "own",
        "raw",
        F.when(whole, F.col("raw")).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.split("raw", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(whole, 0).otherwise(F.size(F.filter(marked, lambda v: v["gone"]))).cast("long").alias("n_removed"),
    )
    removed = F.coalesce(F.length("raw") - F.length("text"), F.lit(0)).cast("long").alias("removed_chars")
    back = [F.col("text") if c == "text" else F.col("own").getField(c).alias(c) for c in own]
    return counted.select(*back, "n_lines", "n_removed", removed)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicate(docs, min_words=10).select("doc_id", "text", "n_lines", "n_removed", "removed_chars")
