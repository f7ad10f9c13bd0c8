"""MinHash near-duplicates by an inverted join over signature coordinates.

Texts with equal shingle sets are one class. Each class is posted under the (coordinate,
value) pairs of its signature. Two signatures that collide in M of ``COORDINATES``
coordinates share one of the first COORDINATES - M + 1 postings of each in order of rarity
(prefix), so only the lists of those are merged; the long ones at the end of that order are
skipped, and their collisions counted position by position for a pair that has met. Pairs
with M collisions or more are confirmed on full shingle sets.

No list is paired off, however short. First its classes meet only the most central class of
the list; that joins most of a group of copies. Classes of a list that then lie in different
components are compared exactly: they meet on the rarest of their shingles that another
component has as well (prefix), if their sizes and the number of such shingles allow the
similarity at all. In the worst case, many components whose classes share almost as much as
the threshold asks for, that makes as many candidates as pairs of such classes; signatures
and sizes drop them before any set is read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage
from .graph import connected_components
from .hashing import blocks, lower, shingle_sets

COORDINATES = 64
#: Chance at which a pair at the threshold may agree in too few coordinates to be compared.
MISS = 1e-7
_MULTIPLY = np.random.default_rng(5).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = np.random.default_rng(6).integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (rows: sets, none of them empty; columns: coordinates)."""
    if not sets:
        return np.empty((0, COORDINATES), np.int32)
    every = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), COORDINATES), np.uint32)
    for i in range(COORDINATES):
        out[:, i] = np.minimum.reduceat(((every * _MULTIPLY[i] + _ADD[i]) >> np.uint64(32)).astype(np.uint32), at)
    return out.view(np.int32)


def least_matches(percent: int, miss: float = MISS) -> int:
    """Match threshold: a pair of that similarity agrees in fewer coordinates with a chance of ``miss`` at most."""
    p, tail = percent / 100, 0.0
    for k in range(COORDINATES + 1):
        tail += math.comb(COORDINATES, k) * p**k * (1 - p) ** (COORDINATES - k)
        if tail > miss:
            return k
    return COORDINATES


def fingerprints(docs: DataFrame, shingle: int, *, with_set: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, key (equal for equal sets only), signature and, if asked for, the packed set of each whole text."""
    names = ["doc_id", "n_shingles", "key", "signature", "set"][: 4 + with_set]

    def run(batches):
        for batch in batches:
            ids, texts, k = batch.column(0).to_pylist(), batch.column(1).to_pylist(), 0
            for part in blocks(texts):
                sets = shingle_sets([lower(t) for t in part], shingle)
                full = [i for i, s in enumerate(sets) if len(s)]
                sigs = dict(zip(full, signatures([sets[i] for i in full])))
                own = ids[k : k + len(part)]
                k += len(part)
                keys = [xxhash.xxh3_128_digest(s) if len(s) else f"empty {i}".encode() for s, i in zip(sets, own)]
                found = [sigs.get(i) for i in range(len(part))]
                columns = [pa.array(own, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int32()))]
                if with_set:
                    columns.append(pa.array([s.astype("<u8").tobytes() if len(s) else None for s in sets], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, key binary, signature array<int>" + ", set binary" * with_set)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int, matches: int) -> DataFrame:
    """Pairs (a, b) of classes whose signatures agree often enough and whose full sets are similar enough.

    Signatures and sizes drop most pairs before any set is fetched. A class that many pairs
    name is an ordinary skewed join key: Spark splits its pairs.
    """
    side = lambda k: sets.select(F.col("rep").alias(k), F.col("signature").alias(f"s{k}"), F.col("n_shingles").alias(f"n{k}"))
    agree = F.size(F.filter(F.arrays_zip("sa", "sb"), lambda p: p["sa"] == p["sb"]))
    sizes = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)
    met = pairs.join(side("a"), "a").join(side("b"), "b").where(sizes).where(agree >= matches).select("a", "b")
    met = stage(met, "matches")
    full = lambda k: sets.select(F.col("rep").alias(k), F.col("set").alias(f"x{k}"))

    def compare(batches):
        last = (None, None)
        for t in batches:
            a, b = t.column(0).to_pylist(), t.column(1).to_pylist()
            keep = []
            for x, y in zip(t.column(2), t.column(3)):
                x, y = x.as_py(), y.as_py()
                if last[0] != x:
                    last = (x, np.frombuffer(x, "<u8"))
                p, q = last[1], np.frombuffer(y, "<u8")
                at = np.minimum(np.searchsorted(p, q), len(p) - 1)
                common = int((p[at] == q).sum())
                keep.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, k in zip(x, keep) if k], pa.int64()) for x in (a, b)], ["a", "b"])

    return met.join(full("a"), "a").join(full("b"), "b").select("a", "b", "xa", "xb").mapInArrow(compare, "a long, b long")


def _postings(classes: DataFrame, matches: int) -> DataFrame:
    """The prefix postings (token, rep, size, weight) of the classes that can match another at all."""
    tokens = classes.select("rep", F.posexplode("signature").alias("i", "v")).select("rep", F.expr("(cast(i as bigint) << 32) | (cast(v as bigint) & 4294967295L)").alias("token"))
    # Written before they meet the tokens again: a very common token then is a skewed key of a plain join.
    common = stage(tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "tokens")
    shared = tokens.join(common, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"))
    # Unique tokens stand first in the order of rarity and fill the prefix; what is left of it are shared ones.
    prefix = shared.where(F.size("t") >= matches).select("rep", F.expr("aggregate(t, 0D, (s, x) -> s + ln(x.df))").alias("weight"), F.slice("t", F.lit(1), F.size("t") - matches + 1).alias("t"))
    return stage(prefix.select("rep", "weight", F.explode("t.token").alias("token")), "postings")


def components(docs: DataFrame, *, shingle: int = 5, percent: int = 80, matches: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id, kept.

    Two rows are linked if 100 * |common shingles| >= percent * |all shingles|. The component
    is the smallest doc_id reachable and ``kept`` its first document. Null and empty texts
    have no shingles and no links; a text shorter than a shingle is one shingle. Repeated
    rows are copies of each other. A row without doc_id joins no component's name: it gets
    the id of its equals (null if none) and is not kept. Empty tables give no rows; extra
    columns do not matter. Signatures must agree in ``matches`` coordinates, by default in
    ``least_matches(percent)``. A task holds one text and about 40 bytes for each of its bytes.
    """
    matches = least_matches(percent) if matches is None else matches
    prints = stage(fingerprints(docs, shingle, id_col=id_col, text_col=text_col), "fingerprints")
    named = prints.where(F.col("doc_id").isNotNull())
    reps = stage(named.groupBy("key").agg(F.min("doc_id").alias("rep")), "classes")
    classes = named.where("n_shingles > 0").join(reps, "key").where("doc_id = rep").select("rep", "key", "signature").dropDuplicates(["rep", "key"])
    posted = _postings(classes.select("rep", "signature"), matches)
    lists = posted.groupBy("token").agg(F.max(F.struct("weight", (-F.col("rep")).alias("r"))).alias("top"), F.count("*").alias("n")).where("n > 1")
    lists = stage(lists.select("token", (-F.col("top.r")).alias("a")), "lists")
    # Full sets are made again, for the classes alone that a list brings together with others.
    met = stage(posted.join(lists, "token", "left_semi").select("rep").distinct(), "met")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).cast("string").alias("text")).join(met.hint("merge"), "rep", "left_semi")
    sets = stage(fingerprints(texts, shingle, with_set=True, id_col="rep").withColumnRenamed("doc_id", "rep").where("n_shingles > 0").dropDuplicates(["rep", "key"]), "sets")
    stars = posted.join(lists, "token").where("rep != a").select("a", F.col("rep").alias("b")).distinct()
    links = stage(confirm(stars, sets, percent, matches), "star-links")
    found = connected_components(links, "a", "b")
    rest = _between(posted, sets, found, percent)
    links = links.unionByName(stage(confirm(rest, sets, percent, matches), "rest-links"))
    final = connected_components(links, "a", "b")
    rows = prints.select("doc_id", "n_shingles", "key").join(reps, "key", "left").join(final, F.col("rep") == F.col("node"), "left")
    component = F.coalesce("component", "rep")
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def _between(posted: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components, among the classes of lists that hold several, that can still be similar enough."""
    here = posted.select("token", "rep").join(found, F.col("rep") == F.col("node"), "left").select("token", "rep", F.coalesce("component", "rep").alias("comp"))
    here = stage(here, "list-components")
    mixed = here.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("token")
    open_ = stage(here.join(mixed, "token"), "open-lists")
    members = open_.select("rep", "comp").distinct()
    full = members.join(sets.select("rep", "set"), "rep")

    def explode(batches):
        for t in batches:
            for rep, comp, x in zip(t.column(0).to_pylist(), t.column(1).to_pylist(), t.column(2)):
                s = np.frombuffer(x.as_py(), "<i8")
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, rep)), pa.array(np.full(n, comp)), pa.array(s)], ["rep", "comp", "s"])

    one = full.select("rep", "comp", "set").mapInArrow(explode, "rep long, comp long, s long")
    # Shingles of one component alone cannot be shared with another. They stand first in the order of rarity.
    met = one.groupBy("s").agg(F.count("*").alias("df"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x != y").select("s", "df")
    mine = one.join(met, "s").groupBy("rep", "comp").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("t")).join(sets.select("rep", F.col("n_shingles").alias("n")), "rep")
    # Sets as similar as that share one of the rarest n - percent * n + 1 shingles of each; unshared ones fill that prefix first.
    length = F.size("t") - F.ceil(F.lit(percent) * F.col("n") / 100).cast("int") + 1
    prefix = mine.where(length > 0).select("rep", "comp", "n", F.size("t").alias("c"), F.posexplode(F.slice("t", F.lit(1), length)).alias("i", "p"))
    prefix = stage(prefix.select("rep", "comp", "n", (F.col("c") - F.col("i")).alias("left"), "p.s"), "rest-postings")
    side = lambda k: prefix.select("s", *[F.col(c).alias(c + k) for c in ("rep", "comp", "n", "left")])
    # At its first common shingle a pair has no other behind it: it and what is left of both bound the overlap.
    most = F.least("lefta", "leftb")
    fits = (F.col("compa") < F.col("compb")) & (100 * most >= percent * (F.col("na") + F.col("nb") - most))
    return side("a").join(side("b"), "s").where(fits).select(F.col("repa").alias("a"), F.col("repb").alias("b")).distinct()


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4, percent=80)


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 4], ' ') AS s FROM w, unnest(generate_series(0, greatest(len(w) - 4, 0))) t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a) c USING (doc_id)
"""
