"""Cross-tokenizer alignment: token groups, links and corpus-wide link counts of two tokenizers.

Neither tokenizer joins anything across the start of a run of white space, so a text is cut
there. The parts that a Python worker meets for the first time are encoded by both libraries
where they stand in their documents and aligned with ``merge_asof`` over the tokens' byte
offsets, by document, in both directions; later occurrences of a part take what was found.
"""

from __future__ import annotations

import gc
import hashlib
import os
import re
from array import array
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stage
from .hashing import text_runs
from .tokenize import vocabulary

#: White space, as both tokenizers see it. A run of it, unless it starts with a carriage return (which B joins with what is before), starts a part.
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PARTS = re.compile(f"[{_SPACE}]*[^{_SPACE}]+(?:\\r[{_SPACE}]*[^{_SPACE}]*)*|[{_SPACE}]+")
#: Characters that some count as white space: texts with them are one part.
_ODD = re.compile("[\\x1c-\\x1f\\u180e\\u200b\\ufeff]")
#: A part of Latin letters, digits and marks after one blank: all libraries have the same notion of these.
_SIMPLE = re.compile(" [!-~\\xa1-\\u024f]+")
#: Parts that a worker keeps, and the bytes that they and their alignments may take.
HELD_PARTS, HELD_BYTES = 400_000, 160 << 20
_BYTE = re.compile("<0x([0-9A-F]{2})>")
_aligners: dict[tuple[str, str], "Aligner"] = {}


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class _Numbers(dict):
    """Numbers by part; one that it has not seen gets the next."""

    def __init__(self, items=()):
        super().__init__(items)
        self.fresh: list[str] = []

    def __missing__(self, part: str) -> int:
        self[part] = n = len(self)
        self.fresh.append(part)
        return n


class Aligner:
    """Alignments of parts of texts: ``known`` numbers the parts, the arrays hold what was found at these numbers."""

    def __init__(self, a_path: str, b_path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        of = byte_level()
        entries = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(of.__getitem__, t)) if set(t) <= of.keys() else t.encode() for t in entries]
        added = set(self.a.get_added_tokens_decoder())
        # The vocabulary's ids are the ranks of its merges, so that simple parts may be encoded by a faster library from the same entries.
        ranks = {x: i for i, x in enumerate(self.a_bytes) if i not in added}
        self.fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := _BYTE.fullmatch(p)) else p.replace("▁", " ").encode() for p in pieces]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        most = max(len(self.a_bytes), len(self.b_bytes))
        self.written = [f"{i}{mark}" for i in range(most) for mark in ",|;"]
        self.blank = self.b.piece_to_id("▁")
        self.line = ranks[b"\n"]
        self.clear()

    def clear(self) -> None:
        self.known = _Numbers()
        self.groups: list[bytes | None] = []  # as they are written; None where the bytes of either side differ from the part's
        self.sizes = array("q")  # bytes
        self.counts = array("q")  # tokens of A, of B, groups, links: four numbers a part
        self.pairs, self.at = array("q"), array("q", [0])  # id of A << 32 | id of B of each link
        self.held = 0

    def shrink(self) -> None:
        """Forget the later half of the parts, as those seen first are those seen most; all, if the rest is still too large."""
        keep = len(self.known) // 2
        self.known = _Numbers(islice(self.known.items(), keep))
        del self.groups[keep:], self.sizes[keep:], self.counts[4 * keep :], self.at[keep + 1 :]
        del self.pairs[self.at[keep] :]
        self.held = sum(map(len, self.known)) + sum(len(g or b"") for g in self.groups) + 8 * len(self.pairs)
        if self.held > HELD_BYTES // 2:
            self.clear()

    def _encode(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a: list = [None] * len(parts)
        simple = [i for i, p in enumerate(parts) if _SIMPLE.fullmatch(p)]
        for k in range(0, len(simple), 512):  # a line feed stands between them, which nothing is joined with
            run = simple[k : k + 512]
            ids = self.fast.encode_ordinary("\n".join([parts[i] for i in run]))
            cut = [j for j, t in enumerate(ids) if t == self.line]
            if len(cut) != len(run) - 1:
                raise ValueError("the tokenizer joins what a line feed separates")
            for i, x, y in zip(run, [-1, *cut], [*cut, len(ids)]):
                a[i] = ids[x + 1 : y]
        rest = [i for i, x in enumerate(a) if x is None]
        for i, e in zip(rest, self.a.encode_batch_fast([parts[i] for i in rest], add_special_tokens=False)):
            a[i] = e.ids
        # The library puts a blank in front: the part's own if it has one, else a token that is not the part's.
        b = self.b.encode([p[1:] if p[0] == " " and p != " " else p for p in parts], num_threads=1)
        return a, [[self.blank] if p == " " else x if p[0] == " " else x[1:] for p, x in zip(parts, b)]

    def _spelt(self, raw: list[bytes], ids: list[np.ndarray], sizes: list[np.ndarray], tokens) -> np.ndarray:
        """Which parts are what the tokens of both sides spell."""
        whole, length = b"".join(raw), np.array([len(r) for r in raw])
        if all(np.array_equal(n, length) and b"".join([t[i] for i in flat.tolist()]) == whole for flat, n, t in zip(ids, sizes, (self.a_bytes, self.b_bytes))):
            return np.ones(len(raw), bool)
        return np.array([b"".join([self.a_bytes[i] for i in x]) == r == b"".join([self.b_bytes[i] for i in y]) for x, y, r in zip(*tokens, raw)])

    def add(self, parts: list[str], raw: list[bytes], docs: np.ndarray, starts: np.ndarray) -> None:
        """Encode and align new parts, each at its first place: a document and the byte offset there."""
        tokens = self._encode(parts)
        spread = lambda tokens: (np.fromiter(chain.from_iterable(tokens), np.int64), np.array([len(x) for x in tokens], np.int64))
        sides = [spread(t) for t in tokens]
        within = [np.diff(np.concatenate([[0], np.cumsum(size[flat])])[np.concatenate([[0], np.cumsum(n)])]) for (flat, n), size in zip(sides, (self.a_size, self.b_size))]
        right = self._spelt(raw, [s[0] for s in sides], within, tokens)
        if not right.all():
            good = np.flatnonzero(right).tolist()
            sides = [spread([t[i] for i in good]) for t in tokens]
        docs, starts = docs[right], starts[right]
        length = np.array([len(r) for r in raw], np.int64)
        base = np.concatenate([[0], np.cumsum(length[right])])  # the parts one after the other
        frames, ends = [], []
        for (flat, n), size in zip(sides, (self.a_size, self.b_size)):
            part = np.repeat(np.arange(len(n)), n)
            end = np.cumsum(size[flat])
            at = end - size[flat] + (starts - base[:-1])[part]
            frames.append(pd.DataFrame({"doc": docs[part], "at": at, "token": np.arange(len(flat))}).sort_values("at", kind="stable"))
            ends.append(end)
        x, y = frames
        over, under = (pd.merge_asof(p, q, on="at", by="doc", suffixes=("", "_other")) for p, q in ((x, y), (y, x)))  # the other side's last token that starts no later
        (a, _), (b, _) = sides
        width = len(b) + 1
        links = np.unique(np.concatenate([over["token"] * width + over["token_other"], under["token_other"] * width + under["token"]]).astype(np.int64))
        i, j = np.divmod(links, width)
        common = np.intersect1d(*ends, assume_unique=True)  # where groups end
        # Tokens in the order in which groups are written, each with the mark that follows it.
        to_a, to_b = (np.concatenate([[0], np.searchsorted(e, common, "right")]) for e in ends)
        of_a, of_b = (np.searchsorted(common, e) for e in ends)
        order = np.empty(len(a) + len(b), np.int64)
        order[np.arange(len(a)) + to_b[of_a]] = 3 * a + np.isin(np.arange(1, len(a) + 1), to_a)
        order[np.arange(len(b)) + to_a[of_b + 1]] = 3 * b + 2 * np.isin(np.arange(1, len(b) + 1), to_b)
        words = list(map(self.written.__getitem__, order.tolist()))
        # Of each part: tokens of A and B, groups and links up to its end.
        upto = [np.searchsorted(e, base, "right") for e in (*ends, common, ends[0][i])]
        counts = np.zeros((len(parts), 4), np.int64)
        counts[right] = np.diff(np.array(upto), axis=1).T
        k = iter((upto[0] + upto[1]).tolist())
        first = next(k)
        for ok in right.tolist():
            if ok:
                last = next(k)
                self.groups.append("".join(words[first:last])[:-1].encode())
                self.held += len(self.groups[-1])
                first = last
            else:
                self.groups.append(None)
        self.counts.frombytes(counts.tobytes())
        self.at.frombytes((self.at[-1] + np.cumsum(counts[:, 3])).tobytes())
        self.pairs.frombytes((a[i] << 32 | b[j]).tobytes())
        self.held += int(length.sum()) + 8 * len(i)

    def align(self, texts: list[str | None]) -> list[tuple]:
        """For each text: (tokens of A, of B, groups, links), digest of the groups, distinct pairs and how often each is linked."""
        if len(self.known) > HELD_PARTS or self.held > HELD_BYTES:
            self.shrink()
        seen, number = len(self.known), self.known.__getitem__
        rows = [list(map(number, [" " + t] if _ODD.search(t) else _PARTS.findall(" " + t))) if t else [] for t in texts]
        if parts := self.known.fresh:
            self.known.fresh = []
            raw = [p.encode() for p in parts]
            self.sizes.extend(map(len, raw))
            size = np.frombuffer(self.sizes, np.int64)
            every = np.fromiter(chain.from_iterable(rows), np.int64)
            start = np.cumsum(size[every]) - size[every]
            doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            start = start - start[np.searchsorted(doc, doc)]
            fresh = np.flatnonzero(every >= seen)
            place = fresh[np.unique(every[fresh], return_index=True)[1]]
            self.add(parts, raw, doc[place], start[place])
            del size
        counts, at, pairs = np.frombuffer(self.counts, np.int64).reshape(-1, 4), np.frombuffer(self.at, np.int64), np.frombuffer(self.pairs, np.int64)
        return [self._total(r, counts, at, pairs) for r in rows]

    def _total(self, own: list[int], counts: np.ndarray, at: np.ndarray, pairs: np.ndarray) -> tuple:
        groups = list(map(self.groups.__getitem__, own))
        if not own or None in groups:
            return (0, 0, 0, 0), "", np.empty(0, np.int64), np.empty(0, np.int64)
        ordered = np.fromiter(own, np.int64, len(own))
        ordered.sort()
        bounds = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        which, times = ordered[bounds], np.diff(bounds, append=len(ordered))
        first, n = at[which], at[which + 1] - at[which]
        where = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        found, often = pairs[where], np.repeat(times, n)
        by = np.argsort(found)
        found, often = found[by], often[by]
        bounds = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        return tuple((counts[which] * times[:, None]).sum(0).tolist()), hashlib.sha256(b";".join(groups)).hexdigest(), found[bounds], np.add.reduceat(often, bounds)


def alignments(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, row, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct linked pairs (id of A << 32 | id of B) with their numbers of links."""
    names = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches):
        key = (a_path, b_path)
        if key not in _aligners:
            _aligners[key] = Aligner(*key)
        gc.disable()  # long lists of numbers and texts, and no cycles, for the collector to walk over and over
        for part in text_runs(batches, 2):
            found = _aligners[key].align(part.column(2).to_pylist())
            numbers = [pa.array([f[0][k] for f in found], pa.int64()) for k in range(4)]
            lists = [pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(f[k]) for f in found]), pa.int32()), pa.array(np.concatenate([f[k] for f in found]))) for k in (2, 3)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *numbers, pa.array([f[1] for f in found], pa.string()), lists[0], lists[1].cast(pa.list_(pa.int32()))], ["doc_id", "row", *names, "groups_sha256", "pairs", "links"])
        gc.enable()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, row long, " + "".join(f"{n} long, " for n in names) + "groups_sha256 string, pairs array<long>, links array<int>")


def link_counts(aligned: DataFrame) -> DataFrame:
    """pair, docs (the documents that hold it) and best (whether no pair of its A id is in more)."""
    counted = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    counted = stage(counted, "link-counts")
    most = counted.groupBy(F.expr("shiftright(pair, 32)").alias("_a")).agg(F.max("docs").alias("_most"))
    return stage(counted.join(most, F.expr("shiftright(pair, 32)") == F.col("_a")).select("pair", "docs", (F.col("docs") == F.col("_most")).alias("best")), "links")


def cross_tokenizer(docs: DataFrame, a_path: str, b_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Alignment of two tokenizers over each text: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a blank and the text, B the text; special tokens within a text are plain text.
    Bytes at which tokens of both end bound the groups; two tokens are linked if their bytes
    overlap. A text that is null, empty or not what either side's tokens spell (one with U+2581)
    has no tokens. Rows without id, rows that repeat one and equal rows are documents of their
    own and counted as such; an empty table gives no rows; other columns do not matter. A task
    holds one text with its tokens, and ``HELD_BYTES`` of aligned parts.
    """
    aligned = stage(alignments(docs, a_path, b_path, id_col=id_col, text_col=text_col), "alignments")
    # The pairs are broadcast if they are few, else joined by a shuffle: distinct pairs of ids grow more slowly than texts.
    counted = small(link_counts(aligned), max_rows=1_000_000)
    linked = aligned.select("row", F.explode(F.arrays_zip("pairs", "links")).alias("_l")).select("row", F.col("_l.pairs").alias("pair"), F.col("_l.links").cast("long").alias("links")).join(counted, "pair")
    sums = linked.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("links") * F.col("docs")).alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))
