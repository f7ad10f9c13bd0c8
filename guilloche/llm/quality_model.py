"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model over hashed words, word pairs, character trigrams and text statistics gives
each document its own evidence. Hosts and the paths below them are judged by grouped sums of
what is known of their documents: labels where there are any, evidence elsewhere. A site's
mean is shrunk towards the level above by the ratio of the variance within sites to that
between them, so sparse sites say little, and none says anything where sites do not differ. A
document's odds are then corrected by its site, as judged without the document itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stage
from .hashing import blocks, lower, windows, words
from .quality_rules import _measure

#: Labelled rows on which the model is fitted at most; chosen by a hash of the id.
MAX_TRAINING_ROWS = 4_000
#: Hash slots of words and word pairs, and of character trigrams; text statistics follow them.
WORDS, CHARS = 1 << 13, 1 << 13
STATISTICS = ("symbols", "repeats", "dup_lines", "word_length", "short", "symbols_per_line")
#: Scale of the statistics beside the slots, whose squares add up to about one for each kind.
STATISTICS_SCALE = 4.0
#: Bytes of a text whose trigrams are hashed at once.
_PIECE = 1 << 18
_CLIP = 0.01


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(_CLIP)), F.lit(1 - _CLIP))
    return F.log(q / (1 - q))


def trigram_slots(raw: bytes):
    """Slots of the byte trigrams of a text, piece by piece, so that a very long text needs no more memory than a piece."""
    for at in range(0, len(raw) - 2, _PIECE):
        x = np.frombuffer(raw, np.uint8, min(_PIECE + 2, len(raw) - at), at).astype(np.uint32)
        yield ((x[:-2] | x[1:-1] << np.uint32(8) | x[2:] << np.uint32(16)) * np.uint32(2654435761)) >> np.uint32(32 - CHARS.bit_length() + 1)


def text_slots(texts: list[str | None]) -> list[tuple[np.ndarray, bytes, np.ndarray]]:
    """For each whole text its word slots, its bytes for ``trigram_slots`` and its bounded statistics.

    A text without words has no slots and ``short`` 1.
    """
    stats = _measure(texts).astype(float)
    n, chars, symbols, lines, dup, repeat = stats.T
    n, lines = np.maximum(n, 1), np.maximum(lines, 1)
    dense = np.stack([np.minimum(symbols / n, 2), repeat / n, dup / lines, np.minimum(chars / n, 20) / 10, 1 / (1 + stats[:, 0] / 20), np.minimum(symbols / lines, 20) / 20], 1) * STATISTICS_SCALE
    low = [lower(t) for t in texts]
    h, at = words(low)
    two = (windows(h, 2) % np.uint64(WORDS)).astype(np.int32)
    one = (h % np.uint64(WORDS)).astype(np.int32)
    out = []
    for i, t in enumerate(low):
        a, b = at[i], at[i + 1]
        out.append((np.concatenate([one[a:b], two[a : max(a, b - 1)]]), t if b > a else b"", dense[i]))
    return out


def training_vectors(rows: DataFrame) -> DataFrame:
    """(label, features) of rows (label, text): counts of each slot over the root of the text's words, or trigrams, then its statistics."""
    from pyspark.ml.linalg import Vectors, VectorUDT

    def vectors(batches):
        for batch in batches:
            texts, labels, k = batch.column(1).to_pylist(), batch.column(0), 0
            for part in blocks(texts):
                at, values = [], []
                for word, raw, dense in text_slots(part):
                    three = sum((np.bincount(x, minlength=CHARS) for x in trigram_slots(raw)), np.zeros(CHARS, np.int64))
                    ends = [np.unique(word, return_counts=True), (np.flatnonzero(three), three[three > 0])]
                    at.append(np.concatenate([ends[0][0], ends[1][0] + WORDS, np.arange(len(dense)) + WORDS + CHARS]))
                    values.append(np.concatenate([*(c / np.sqrt(max(1, c.sum())) for _, c in ends), dense]))
                yield pa.RecordBatch.from_arrays([labels.slice(k, len(part)), pa.array(at, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], ["label", "at", "values"])
                k += len(part)

    sparse = F.udf(lambda at, values: Vectors.sparse(WORDS + CHARS + len(STATISTICS), at, values), VectorUDT())
    # Written in between, so that no task runs two Python workers at once.
    slots = stage(rows.select("label", "text").mapInArrow(vectors, "label double, at array<long>, values array<double>"), "training-slots")
    return slots.select("label", sparse("at", "values").alias("features"))


def fit(docs: DataFrame, truth: DataFrame, *, max_rows: int = MAX_TRAINING_ROWS) -> tuple[float, np.ndarray]:
    """Intercept and weights of a ridge logistic model on at most ``max_rows`` labelled documents.

    ``docs``: doc_id, text; ``truth``: doc_id, label (0 or 1), each id once. Of several texts
    of an id the first in order counts. The sample's ids are chosen first, so only its texts
    are gathered.
    """
    from pyspark.ml.classification import LogisticRegression

    none = np.zeros(WORDS + CHARS + len(STATISTICS))
    known = stage(truth.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "training-ids")
    sample = docs.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # max_rows ids
    shares = dict(known.groupBy("label").count().collect())  # two rows
    if len(shares) < 2:
        return (0.0 if not shares else 3.0 if 1.0 in shares else -3.0), none
    model = LogisticRegression(regParam=1e-3, maxIter=100, standardization=False).fit(training_vectors(sample))
    return float(model.intercept), np.array(model.coefficients.toArray())


def evidence(rows: DataFrame, model: tuple[float, np.ndarray], *, keep: tuple[str, ...]) -> DataFrame:
    """``keep`` columns and ``evidence``, the model's chance that a whole text is good. ``rows`` have ``text`` as well."""
    intercept, weights = model
    shared = rows.sparkSession.sparkContext.broadcast(weights)  # one number for each slot

    def score(batches):
        w = shared.value
        first, second, third = w[:WORDS], w[WORDS : WORDS + CHARS], w[WORDS + CHARS :]
        for batch in batches:
            texts, out = batch.column(len(keep)).to_pylist(), []
            for part in blocks(texts):
                for word, raw, dense in text_slots(part):
                    three = sum(float(second[x].sum()) for x in trigram_slots(raw))
                    z = intercept + dense @ third + first[word].sum() / np.sqrt(max(1, len(word))) + three / np.sqrt(max(1, len(raw) - 2))
                    out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(out, pa.float64())], [*keep, "evidence"])

    chosen = rows.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(score, f"{fields}, evidence double")


def prior_weight(groups: DataFrame) -> float | None:
    """How many documents the level above weighs; None if groups do not differ more than chance makes them.

    ``groups``: n, s and q (number, sum and sum of squares of what is known of their
    documents) and ``prior``, the mean of the level above. The variance within groups over
    the one between them, both by the method of moments.
    """
    n, s, q, p = (F.col(c) for c in ("n", "s", "q", "prior"))
    within, between = F.sum(q - s * s / n), F.sum(n * F.pow(s / n - p, 2))
    m = groups.agg(within.alias("w"), between.alias("b"), F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(n * n).alias("nn")).first()
    if not m["n"] or m["k"] < 2 or m["n"] <= m["k"]:
        return None
    inner = max(m["w"], 0.0) / (m["n"] - m["k"])
    spread = (m["b"] - (m["k"] - 1) * inner) / (m["n"] - m["nn"] / m["n"])
    return inner / spread if spread > 0 else None


def _shrunk(s: Column, n: Column, prior: Column, weight: float | None) -> Column:
    return prior if weight is None else F.when(n + weight > 0, (s + weight * prior) / (n + weight)).otherwise(prior)


def with_sites(scored: DataFrame, *, threshold: float) -> DataFrame:
    """Add host_posterior, path_posterior, quality_score and kept to rows (doc_id, _host, _path, evidence, _known).

    ``_known`` is a document's label, or null. A site's posterior for a document leaves that
    document out, so neither its label nor its evidence counts twice.
    """
    y = F.coalesce("_known", "evidence")
    paths = stage(scored.groupBy("_host", "_path").agg(F.sum(y).alias("s"), F.sum(y * y).alias("q"), F.count("*").alias("n")), "path-sums")
    overall = paths.agg(F.sum("s") / F.sum("n")).first()[0]
    overall = 0.5 if overall is None else overall
    sums = [F.sum(c).alias(c) for c in ("n", "s", "q")]
    hosts = stage(paths.groupBy(F.col("_host").alias("_h")).agg(*sums).withColumn("prior", F.lit(overall)), "host-sums")
    host_weight = prior_weight(hosts)
    means = hosts.select("_h", (F.col("s") / F.col("n")).alias("prior"), F.col("s").alias("hs"), F.col("n").alias("hn"))
    sites = stage(paths.join(small(means), F.col("_host").eqNullSafe(F.col("_h"))).select("_h", F.col("_path").alias("_p"), "s", "q", "n", "hs", "hn", "prior"), "sites")
    path_weight = prior_weight(sites)
    j = scored.join(small(sites.drop("q", "prior")), F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_p")))
    j = j.withColumn("host_posterior", _shrunk(F.col("hs") - y, F.col("hn") - 1, F.lit(overall), host_weight))
    j = j.withColumn("path_posterior", _shrunk(F.col("s") - y, F.col("n") - 1, F.col("host_posterior"), path_weight))
    odds = _logit(F.col("evidence")) + _logit(F.col("path_posterior")) - _logit(F.lit(overall))
    return j.withColumn("quality_score", 1 / (1 + F.exp(-odds))).select("doc_id", "evidence", "host_posterior", "path_posterior", "quality_score", (F.col("quality_score") >= threshold).alias("kept"))


def score(docs: DataFrame, labels: DataFrame, *, host_col: str = "source", path_col: str = "lang", threshold: float = 0.5, max_rows: int = MAX_TRAINING_ROWS) -> DataFrame:
    """One row for each row of ``docs``: doc_id, evidence, host_posterior, path_posterior, quality_score, kept.

    Labels count where a document has one and all say the same; without labels of both kinds
    the evidence is constant. A null host or path is a site of its own. Null and empty texts are
    scored on zeros. Repeated rows are scored alike and each counts for its site; a null
    doc_id is scored but has no label. Empty tables give no rows; extra columns do not matter.
    A task holds one text and about 45 bytes for each of its bytes.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("_host"), F.col(path_col).cast("string").alias("_path"), F.col("text").cast("string").alias("text"))
    said = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("_a"), F.max("quality").alias("_b"))
    truth = stage(said.where("_a = _b and _a in (0, 1)").select("doc_id", F.col("_a").cast("double").alias("label")), "truth")
    model = fit(rows.select("doc_id", "text"), truth, max_rows=max_rows)
    scored = evidence(rows, model, keep=("doc_id", "_host", "_path"))
    # Labels grow with the collection: they are merged, not broadcast.
    scored = stage(scored.join(truth.withColumnRenamed("label", "_known").hint("merge"), "doc_id", "left"), "evidence")
    return with_sites(scored, threshold=threshold)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the documents' sources and paths their languages: the given tables know no other site."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels)
