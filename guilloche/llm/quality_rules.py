"""Quality rules with risk-controlled thresholds.

Every rule compares one feature with a cutoff of its stratum. Candidate cutoffs lie on fixed
grids. A labelled holdout of good documents tells how many of them each cutoff rejects; an
exact binomial test decides whether the true share of falsely rejected good documents is
below the allowed one, at a level divided by the number of tests (Bonferroni), so that all
chosen cutoffs hold at once with the stated confidence. A document goes if any rule fires, so
the rules of a stratum share what is allowed: each takes its upper bound from it, those that
catch most bad documents first. A safe cutoff is raised as far as it rejects the same bad
documents of the holdout, and a rule that catches none goes unused.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stage
from .hashing import blocks, windows, words

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[list(b"#*$%&|<>")] = True
#: Rules: a document is rejected where the feature, from 0 to ``GRID``, is above the cutoff.
FEATURES = ("symbol_pct", "dup_line_pct", "long_word_pct")
GRID = 100
_STATS = "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


def _measure(texts: list[str | None]) -> np.ndarray:
    """The ``_STATS`` of each text; a null text has no words and no lines."""
    out = np.zeros((len(texts), 6), np.int64)
    raw = [None if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    h, at = words(raw)
    five = windows(h, 5)
    for i, t in enumerate(raw):
        a, b = at[i], at[i + 1]
        out[i, 0] = b - a
        if not t:
            continue
        data = np.frombuffer(t, np.uint8)
        out[i, 1] = int(((data & 0xC0) != 0x80).sum()) - sum(map(t.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
        out[i, 2] = int(_SYMBOLS[data].sum())
        lines = [x for x in t.split(b"\n") if x.strip()]
        out[i, 3], out[i, 4] = len(lines), len(lines) - len(set(lines))
        if b - a > 5:
            _, back, n = np.unique(five[a : b - 4], return_inverse=True, return_counts=True)
            twice = np.flatnonzero(n[back] > 1)
            if len(twice):
                cover = np.zeros(b - a + 1, np.int64)
                np.add.at(cover, twice, 1)
                np.add.at(cover, twice + 5, -1)
                out[i, 5] = int((np.cumsum(cover)[:-1] > 0).sum())
    return out


def text_statistics(docs: DataFrame, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and, for each whole text: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    kept = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("string").alias("_text"))

    def measure(batches):
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            stats = np.concatenate([_measure(run) for run in blocks(texts)]) if texts else np.zeros((0, 6), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.array(stats[:, k]) for k in range(6)], [*keep, *(x.split()[0] for x in _STATS.split(", "))])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(measure, f"{fields}, {_STATS}")


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n draws with chance p; n = 0 gives 1."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def upper_bound(k: int, n: int, level: float) -> float:
    """The share above which seeing at most ``k`` of ``n`` has a chance of ``level`` or less (exact, rounded up)."""
    low, high = 0.0, 1.0
    for _ in range(40):
        p = (low + high) / 2
        low, high = (low, p) if binomial_at_most(k, n, p) <= level else (p, high)
    return high


def error_level(strata: int, confidence: float) -> float:
    """Chance of error of a single test, of one for each cutoff of each rule of each stratum (Bonferroni)."""
    return (1 - confidence) / max(1, strata * len(FEATURES) * GRID)


def lowest_safe(values: list[int], allowed: float, level: float) -> int | None:
    """Lowest cutoff that is safe: were the true share above it ``allowed``, so few good documents there would have a chance of ``level`` at most.

    ``values``: good holdout documents by value of the feature, from 0 to ``GRID``.
    """
    n, above, chosen = sum(values), 0, None
    for cutoff in range(GRID - 1, -1, -1):
        above += values[cutoff + 1]
        if allowed <= 0 or above >= allowed * n or binomial_at_most(above, n, allowed) > level:
            break
        chosen = cutoff
    return chosen


def next_rule(good: dict[str, list[int]], bad: dict[str, list[int]], unused: list[str], left: float, level: float) -> tuple[str, int, float] | None:
    """(feature, cutoff, share that it may reject) of the safe rule that catches most bad documents; None if none catches any.

    ``good`` and ``bad``: a stratum's holdout documents by feature and value, the bad ones
    without those that its other rules reject. The cutoff is the highest that rejects the same bad documents as
    the lowest safe one. The share is an upper bound that holds, with those of all other
    cutoffs, at the stated confidence. Of equal rules the first in order of name counts.
    """
    best = None
    for feature in sorted(unused):
        cutoff = lowest_safe(good[feature], left, level)
        if cutoff is None or not (caught := sum(bad[feature][cutoff + 1 :])):
            continue
        while not bad[feature][cutoff + 1]:
            cutoff += 1
        if best is None or caught > best[0]:
            best = (caught, feature, cutoff)
    if best is None:
        return None
    _, feature, cutoff = best
    values = good[feature]
    return feature, cutoff, upper_bound(sum(values[cutoff + 1 :]), sum(values), level)


def _rejected() -> Column:
    """Whether a feature is above the cutoff of its stratum, where it has one."""
    any_ = F.lit(False)
    for f in FEATURES:
        any_ = any_ | F.coalesce(F.col(f) > F.col(f"_cut_{f}"), F.lit(False))
    return any_


def choose_cutoffs(holdout: DataFrame, *, allowed: float, confidence: float) -> DataFrame:
    """One row for each stratum with good documents: ``_of`` (the stratum), ``_left`` and a cutoff ``_cut_<feature>``, null for a rule that is not used.

    ``holdout``: _stratum, _q (1 good, 0 bad) and the features. Each round gives each stratum
    one rule more and counts anew which bad documents are left. A stratum's counts, at most
    one row for each feature and value, are what a task holds.
    """
    cuts = ", ".join(f"_cut_{f} int" for f in FEATURES)
    state = holdout.where("_q = 1").select(F.col("_stratum").alias("_of")).distinct().withColumns({"_left": F.lit(allowed).cast("double")} | {f"_cut_{f}": F.lit(None).cast("int") for f in FEATURES})
    state = stage(state, "cutoffs")
    level = error_level(state.count(), confidence)
    kept = [c for c in state.columns]

    def step(rows):
        out = rows[kept].iloc[:1].copy()
        good, bad = ({f: [0] * (GRID + 1) for f in FEATURES} for _ in range(2))
        for f, v, g, b in zip(rows["feature"], rows["value"], rows["good"], rows["bad"]):
            good[f][v], bad[f][v] = int(g), int(b)
        unused = [f for f in FEATURES if out[f"_cut_{f}"].isna().iloc[0]]
        if rule := next_rule(good, bad, unused, float(out["_left"].iloc[0]), level):
            out[f"_cut_{rule[0]}"] = rule[1]
            out["_left"] -= rule[2]
        return out

    for _ in FEATURES:
        open_ = holdout.join(small(state), F.col("_stratum").eqNullSafe(F.col("_of"))).where((F.col("_q") == 1) | ~_rejected())
        long = open_.select(*kept, "_q", F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("feature", "value"))
        counts = long.groupBy(*kept, "feature", "value").agg(F.count_if(F.col("_q") == 1).alias("good"), F.count_if(F.col("_q") == 0).alias("bad"))
        state = stage(counts.groupBy("_of").applyInPandas(step, f"_of string, _left double, {cuts}"), "cutoffs")
    return state


def _features(stats: DataFrame) -> DataFrame:
    pct = lambda part, of: F.least(F.lit(GRID), F.coalesce(F.floor(F.lit(GRID) * part / F.when(of > 0, of)), F.lit(0))).cast("int")
    c = F.col
    return stats.withColumns({"symbol_pct": pct(c("n_symbols"), c("n_words")), "dup_line_pct": pct(c("n_dup_lines"), c("n_lines")), "long_word_pct": pct(F.greatest(c("word_chars") - 5 * c("n_words"), F.lit(0)), 20 * c("n_words"))})


def judge(docs: DataFrame, labels: DataFrame, *, stratum_col: str = "lang", allowed: float = 0.05, confidence: float = 0.95, min_words: int = 10, max_repeat_pct: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs`` with its doc_id, ``keep`` columns, statistics, ``base_failed`` and ``kept``.

    Base rules: under ``min_words`` words, or more than ``max_repeat_pct`` per cent of them in
    repeated windows. Of the rest a document is kept unless a feature is above the cutoff of
    its stratum; the rules of a stratum together reject at most ``allowed`` of its good
    documents, with ``confidence`` for all strata at once. Good holdout documents are the
    labelled ones of quality 1 that pass the base rules; a document labelled more than once
    counts as good only if all labels say so, and as bad if any label says 0. Of several rows
    with a labelled id one is in the holdout, that with the smallest stratum and features. A
    null stratum is a stratum of its own; strata without labels, and empty labels, have no
    cutoffs and keep what passes the base rules. Null texts fail. Repeated rows are judged
    alike; a null doc_id is judged but never a holdout row. Empty tables give no rows; extra
    columns do not matter. A task holds one text, and about 40 bytes for each of its bytes.
    """
    rows = docs.select("doc_id", *keep, F.col(stratum_col).cast("string").alias("_stratum"), "text")
    stats = text_statistics(rows, keep=("doc_id", *keep, "_stratum"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    stats = stage(_features(stats).withColumn("base_failed", failed), "text-statistics")
    said = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q")).where("_q in (0, 1)")
    one = stats.where(~F.col("base_failed")).join(said, "doc_id").groupBy("doc_id", "_q").agg(F.min(F.struct("_stratum", *FEATURES)).alias("r"))
    cutoffs = choose_cutoffs(stage(one.select("r.*", "_q"), "holdout"), allowed=allowed, confidence=confidence)
    judged = stats.join(small(cutoffs), F.col("_stratum").eqNullSafe(F.col("_of")), "left").withColumn("kept", ~F.col("base_failed") & ~_rejected())
    return judged.drop("_stratum", "n_lines", *cutoffs.columns)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FEATURES)
