"""Source divergence audit: kept terms by iceberg prefix refinement, exact divergences of sources.

Tasks count terms by language and source, and, for terms longer than a level's prefix, the
documents that hold the prefix. Refinement starts with short byte prefixes: those in fewer than
``min_docs`` documents go, and with them every longer prefix and term that begins with them,
before these are shuffled at all. The next level extends what is left; terms no longer than
its prefix are complete there, and kept if enough documents hold them. It ends when no prefix
is left to extend, so that its depth follows the longest term that may still be kept.

A document is read by one task and counted in one partial count, so that partial numbers of
documents add up to exact ones, of prefixes as well.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stage
from .hashing import text_runs

#: Bytes of the first level's prefixes; each level's are twice as long as those before.
FIRST = 8
#: Distinct terms and prefixes, and their bytes, that a task counts before it hands them on.
HELD_TERMS, HELD_BYTES = 500_000, 32 << 20
#: Letters stay (A-Z lower-cased) as does what is not ASCII; all else separates.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
SCALE = 1_000_000_000
#: Values of a dense block of terms by sources, and of the sums that a task holds.
_DENSE, _SUMS = 1 << 20, 1 << 22


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in UTF-8: runs of letters and of characters beyond ASCII, with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LETTERS).split()


def partial_counts(docs: DataFrame, first: int = FIRST, *, held_terms: int = HELD_TERMS, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Counts of parts of the documents: level, lang, term, source, n, docs.

    A row with a source is a complete term of that level, ``n`` its occurrences; one without is
    a prefix of longer terms. ``docs`` are documents of the part that hold it.
    """
    bounds = first << np.arange(40)
    schema = pa.schema([("level", pa.int32()), ("lang", pa.string()), ("term", pa.binary()), ("source", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def rows(counts, holders, prefixes):
        for (lang, source), c in counts.items():
            terms = sorted(c)
            d = holders[lang, source]
            yield from table(lang, source, terms, [c[t] for t in terms], [d[t] for t in terms])
        for lang, p in prefixes.items():
            terms = sorted(p)
            yield from table(lang, None, terms, None, [p[t] for t in terms])

    def table(lang, source, terms, n, d):
        term = pa.array(terms, pa.large_binary()).cast(pa.binary())
        level = pa.array(np.searchsorted(bounds, pc.binary_length(term).to_numpy()).astype(np.int32))
        fill = lambda v: pa.array([v], pa.string()).take(pa.array(np.zeros(len(terms), np.int32)))
        number = pa.nulls(len(terms), pa.int64()) if n is None else pa.array(n, pa.int64())
        batch = pa.RecordBatch.from_arrays([level, fill(lang), term, fill(source), number, pa.array(d, pa.int64())], schema=schema)
        for k in range(0, len(terms), 1 << 15):
            yield batch.slice(k, 1 << 15)

    def run(batches):
        counts, holders, prefixes, size, held = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter), 0, 0
        for part in text_runs(batches, 2):
            langs, sources, texts = (c.to_pylist() for c in part.columns)
            for lang, source, text in zip(langs, sources, texts):
                words = terms_of(text)
                distinct = set(words)
                before = len(counts[lang, source])
                counts[lang, source].update(words)
                holders[lang, source].update(distinct)
                fresh, longer, k = len(counts[lang, source]) - before, [w for w in distinct if len(w) > first], first
                held += fresh
                size += 16 * fresh + sum(map(len, longer))
                while longer:
                    prefixes[lang].update({w[:k] for w in longer})
                    k *= 2
                    longer = [w for w in longer if len(w) > k]
                if held > held_terms or size > held_bytes:
                    yield from rows(counts, holders, prefixes)
                    counts.clear(), holders.clear(), prefixes.clear()
                    size = held = 0
        yield from rows(counts, holders, prefixes)

    return docs.select("lang", "source", "text").mapInArrow(run, "level int, lang string, term binary, source string, n long, docs long")


def kept_counts(partial: DataFrame, *, min_docs: int = 3, first: int = FIRST) -> DataFrame:
    """Occurrences n of each kept term in each source that has it (lang, source, term), refined level by level from ``partial_counts``."""
    kept, alive, level, length = [], None, 0, first
    while True:
        rows = partial.where(F.col("level") == level)
        if alive is not None:
            rows = rows.withColumn("_p", F.substring("term", 1, length // 2)).join(small(alive), ["lang", "_p"], "left_semi").drop("_p")
        whole = rows.where("source is not null").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        enough = F.sum("docs").over(Window.partitionBy("lang", "term")) >= min_docs  # a row for each source at most
        kept.append(stage(whole.withColumn("_enough", enough).where("_enough").select("lang", "source", "term", "n"), f"terms-{length}"))
        alive = rows.where("source is null").groupBy("lang", F.col("term").alias("_p")).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs)
        alive = stage(alive.select("lang", "_p"), f"prefixes-{length}")
        if alive.isEmpty():
            break
        level, length = level + 1, length * 2
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def _filled(docs: DataFrame) -> DataFrame:
    """Columns lang and source without nulls, and the text."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("text").cast("string").alias("text"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact at any count."""
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(12,0)") * (n + 1).cast("decimal(20,0)"), (total + terms).cast("decimal(20,0)"))).cast("long")


def _pair_sums(vectors: DataFrame) -> DataFrame:
    """Sums over all terms of the divergence of source ``a`` from ``b`` by numbers of sources: lang, a, sums by b.

    A batch of terms becomes dense blocks; no row is made for a pair of sources and a term.
    """

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            lang = batch.column(0).dictionary_encode()
            base, at, p = (c if c.type == pa.list_(c.type.value_type) else c.cast(pa.list_(c.type.value_type)) for c in batch.columns[1:])
            code = lang.indices.to_numpy()
            for i, name in enumerate(lang.dictionary.to_pylist()):
                mine = np.flatnonzero(code == i)
                zero = np.asarray(base[int(mine[0])].values.to_numpy(), np.int64)
                s = len(zero)
                if name not in held:
                    if sum(x.size for x in held.values()) + s * s > _SUMS and held:
                        yield from rows(held)
                        held.clear()
                    held[name] = np.zeros((s, s), np.int64)
                step = max(1, _DENSE // s)
                for k in range(0, len(mine), step):
                    take = pa.array(mine[k : k + step])
                    x, y = at.take(take), p.take(take)
                    n = np.diff(x.offsets.to_numpy())
                    dense = np.tile(zero, (len(n), 1))
                    dense[np.repeat(np.arange(len(n)), n), x.flatten().to_numpy()] = y.flatten().to_numpy()
                    for a in range(s):
                        gap = dense[:, a : a + 1] - dense
                        held[name][a] += (gap * gap // dense).sum(0)
        yield from rows(held)

    def rows(held):
        for name, sums in held.items():
            for a, row in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([a], pa.int32()), pa.array([row], pa.list_(pa.int64()))], ["lang", "a", "sums"])

    return vectors.select("lang", "base", "at", "p").mapInArrow(run, "lang string, a int, sums array<long>")


def divergence(docs: DataFrame, *, min_docs: int = 3, top: int = 200, first: int = FIRST) -> DataFrame:
    """Divergence of each source of a language from the others, and the terms that set it apart: lang, source, part, item, value, rank.

    Null text, lang and source count as ''. Each language keeps the terms that ``min_docs`` of
    its documents hold; rows that repeat a document are documents. Shares are integers in
    billionths with one occurrence added to each kept term, and all arithmetic is exact.
    Part ``pair`` has a row for each ordered pair of sources of a language, part ``term`` the
    ``top`` kept terms of a source that stand out from its language. Ties are in order of the
    item's bytes. A source whose texts are empty has pairs and no terms; a language that keeps
    no term has pairs of value 0. An empty table gives no rows; other columns do not matter.
    A task holds one text, ``HELD_TERMS`` counts and the counts of one text.
    """
    rows = _filled(docs)
    partial = stage(partial_counts(rows, first), "term-parts")
    kept = kept_counts(partial, min_docs=min_docs, first=first)
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("_n"))
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("_n")).groupBy("lang").agg(F.sum("_n").alias("_total"), F.count("*").alias("_terms"))
    groups = rows.select("lang", "source").distinct().join(by_source, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)  # a row for each source
    groups = stage(groups.select("lang", "source", "at", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("_n", "_total", "_terms")]), "sources")
    full = groups.where("_terms > 0")
    bases = full.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", _share(F.lit(0), F.col("_n"), F.col("_terms")).alias("p")))).getField("p").alias("base"), F.first("_total").alias("_total"), F.first("_terms").alias("_terms"))
    shares = kept.join(small(full.select("lang", "source", "at", "_n", "_terms")), ["lang", "source"]).select("lang", "term", "n", "at", _share(F.col("n"), F.col("_n"), F.col("_terms")).alias("p"))
    vectors = shares.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.collect_list(F.struct("at", "p")).alias("v"))  # bounded by the sources of a language
    vectors = stage(vectors.select("lang", "term", "n", F.col("v.at").alias("at"), F.col("v.p").alias("p")), "term-vectors")
    summed = _pair_sums(vectors.join(small(bases.select("lang", "base")), "lang"))
    sums = summed.select("lang", "a", F.posexplode("sums").alias("b", "s")).groupBy("lang", "a", "b").agg(F.sum("s").alias("s"))
    one, other = (groups.select("lang", F.col("source").alias(s), F.col("at").alias(k)) for s, k in (("source", "a"), ("item", "b")))
    pairs = one.join(other, "lang").where("a != b").join(sums, ["lang", "a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), F.encode("item", "utf-8").alias("item"), F.coalesce("s", F.lit(0)).alias("value"))
    apart = vectors.join(small(bases.select("lang", "_total", "_terms")), "lang").withColumn("_q", _share(F.col("n"), F.col("_total"), F.col("_terms")))
    apart = apart.select("lang", "term", "_q", F.explode(F.arrays_zip("at", "p")).alias("e")).where("e.p > _q")
    gap = F.col("e.p") - F.col("_q")
    apart = apart.select("lang", F.col("e.at").alias("at"), F.col("term").alias("item"), F.call_function("div", gap * gap, F.col("_q")).alias("value"))
    rank = Window.partitionBy("lang", "at").orderBy(F.desc("value"), "item")
    apart = apart.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)
    apart = apart.join(groups.select("lang", "at", "source"), ["lang", "at"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(rank))
    return pairs.select(*apart.columns).unionByName(apart).withColumn("item", F.decode("item", "utf-8"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"), min_docs=3, top=200)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT k, lang, source, t, count(*) AS n FROM (SELECT k, lang, source, unnest(w) AS t FROM d) GROUP BY ALL),
keep AS (SELECT lang, t, CAST(sum(n) AS HUGEINT) AS n FROM o GROUP BY lang, t HAVING count(*) >= 3),
c AS (SELECT o.lang, source, t, CAST(sum(o.n) AS HUGEINT) AS n FROM o JOIN keep USING (lang, t) GROUP BY ALL),
l AS (SELECT lang, sum(n) AS total, CAST(count(*) AS HUGEINT) AS v FROM keep GROUP BY lang),
g AS (SELECT lang, source, coalesce((SELECT sum(n) FROM c WHERE c.lang = x.lang AND c.source = x.source), 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN l USING (lang)),
p AS (SELECT g.lang, g.source, keep.t, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (g.total + g.v) AS p FROM g JOIN keep USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.t = keep.t),
q AS (SELECT lang, t, 1 + 1000000000::HUGEINT * (keep.n + 1) // (l.total + l.v) AS q FROM keep JOIN l USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS s FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, t AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, t) WHERE n > 0 AND p > q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""
