"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations alone.

Items are cut into windows; all shingles of a window must occur for the window to occur, so
one shingle is the necessary prefix: the one rarest in the corpus. Documents meet windows on
that shingle; length and position bounds drop what cannot hold the window; the words of
the remaining places are compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, stage

#: Words of a shingle; a window of fewer words is a shingle itself.
SHINGLE = 3
WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text with A-Z lower-cased; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, WORD), lambda w: w != "")


def _shingle(w: Column, at: Column, n: int) -> Column:
    return F.xxhash64(F.lit(n), *[F.get(w, at + j) for j in range(n)])


def _occurrences(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """Every shingle of every document: the document's columns, position and shingle hash."""
    at = docs.select("*", F.posexplode("_w").alias("_at", "_word"))
    hashes = [F.when(F.col("_at") + n <= F.size("_w"), _shingle(F.col("_w"), F.col("_at"), n)) for n in sizes]
    if len(hashes) == 1:
        return at.withColumn("_s", hashes[0]).where("_s is not null")
    return at.withColumn("_s", F.explode(F.array(*hashes))).where("_s is not null")


def benchmark_windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows: their words ``_win`` and the ids of the items that contain them."""
    w = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_w") - window, F.lit(0)))
    cut = w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("_w"), i + 1, window))).alias("_win"))
    return cut.groupBy("_win").agg(F.collect_set("item_id").alias("_items"))


def contamination(docs: DataFrame, items: DataFrame, *, window: int = 10, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row for each row of ``docs``: id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or all of a shorter one; a document's
    word within any occurrence of a window is hit. Null and empty texts have no words and no
    hits, items without words no windows; items with equal windows are all counted; a null
    item id has windows that hit but is not among the items. Rows that repeat a doc_id are one
    document each. No items: nothing is hit. Extra columns do not matter. A text of any length
    is read as a whole; what is shuffled of it are positions and hashes and, if a window may
    occur in it, its words once.
    """
    # Windows are numbered: what is broadcast holds words and numbers, not the items, which may be all of them.
    wins = stage(benchmark_windows(items, window).withColumns({"_len": F.size("_win"), "_wid": F.monotonically_increasing_id()}), "windows")
    sizes = [r[0] for r in wins.select(F.least(F.col("_len"), F.lit(SHINGLE)).alias("n")).distinct().orderBy("n").collect()]  # at most SHINGLE rows
    # Rows of equal id and text share a key, and what is found in either of them.
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.concat_ws(":", F.col(id_col).cast("string"), F.xxhash64(text_col).cast("string")).alias("_row"), F.col(text_col).alias("text"))
    texts = keyed.select("doc_id", "_row", words_of(F.col("text")).alias("_w"))
    totals = texts.select("doc_id", "_row", F.size("_w").cast("long").alias("n_words"))
    none = {"n_hit": F.lit(0).cast("long"), "_found": F.array().cast("array<string>")}
    if not sizes:
        return _digest(totals.withColumns(none))
    inner = F.transform(F.sequence(F.lit(0), F.col("_len") - F.least(F.col("_len"), F.lit(SHINGLE))), lambda i: F.struct(i.alias("_off"), _of_window(i).alias("_s")))
    grams = wins.select("_win", "_len", "_wid", F.explode(inner).alias("_g")).select("_win", "_len", "_wid", "_g._off", "_g._s")
    # How often the benchmark's shingles occur in the corpus: the order of rarity.
    seen = _occurrences(texts.select("_w"), sizes).select("_s").join(small(grams.select("_s").distinct()), "_s", "left_semi")
    rarity = stage(seen.groupBy("_s").agg(F.count("*").alias("_n")), "rarity")
    rank = Window.partitionBy("_wid").orderBy(F.col("_n"), F.col("_off"))
    # A window with a shingle that never occurs cannot occur.
    ranked = grams.join(small(rarity), "_s", "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_k", F.row_number().over(rank))
    prefix = stage(ranked.where("_k = 1 and _n > 0").select("_s", "_off", "_len", "_wid"), "prefixes")
    # Positions and hashes alone meet the prefixes; the words of the places that are left come from their documents, once each.
    places = _occurrences(texts, sizes).select("_row", "_at", "_s", F.size("_w").alias("_nw")).join(small(prefix), "_s").withColumn("_at", F.col("_at") - F.col("_off"))
    places = stage(places.where((F.col("_at") >= 0) & (F.col("_at") + F.col("_len") <= F.col("_nw"))).select("_row", "_at", "_len", "_wid"), "places")
    of_row = places.groupBy("_row").agg(F.collect_list(F.struct("_at", "_len", "_wid")).alias("_p"))
    holders = keyed.join(small(of_row), "_row").select("_row", words_of(F.col("text")).alias("_w"), "_p").select("_row", "_w", F.explode("_p").alias("_p"))
    read = holders.select("_row", F.col("_p._at").alias("_at"), (F.col("_p._at") + F.col("_p._len")).alias("_end"), "_p._wid", F.slice(F.col("_w"), F.col("_p._at") + 1, F.col("_p._len")).alias("_got"))
    found = read.join(small(wins.select("_wid", "_win")), "_wid").where(F.col("_got") == F.col("_win")).select("_row", "_at", "_end", "_wid")
    found = stage(found, "occurrences")
    reach = Window.partitionBy("_row").orderBy("_at", "_end").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("_end") - F.greatest(F.col("_at"), F.coalesce(F.max("_end").over(reach), F.lit(0))))
    spans = found.groupBy("_row", "_at", "_end").agg(F.lit(0)).select("_row", "_at", "_end").withColumn("_fresh", fresh)
    hit = spans.groupBy("_row").agg(F.sum("_fresh").cast("long").alias("n_hit"))
    named = found.select("_row", "_wid").distinct().join(wins.select("_wid", F.explode("_items").alias("_item")), "_wid")
    which = named.select("_row", "_item").distinct().groupBy("_row").agg(F.collect_list("_item").alias("_found"))
    joined = totals.join(hit, "_row", "left").join(which, "_row", "left")
    return _digest(joined.withColumns({k: F.coalesce(F.col(k), v) for k, v in none.items()}))


def _of_window(i: Column) -> Column:
    """Hash of the shingle at ``i`` of the column ``_win``, equal to the one of the same words in a document."""
    hashed = _shingle(F.col("_win"), i, SHINGLE)
    for n in range(SHINGLE - 1, 0, -1):
        hashed = F.when(F.col("_len") == n, _shingle(F.col("_win"), i, n)).otherwise(hashed)
    return hashed


def _digest(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "n_words", "n_hit", F.size("_found").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("_found"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items, window=10)


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i + 1 : i + least(10, len(w))] AS win, least(10, len(w)) AS n FROM iw, unnest(generate_series(0, greatest(len(w) - 10, 0))) t(i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, i, n, w[i + 1 : i + n] AS win FROM dw, lens, unnest(generate_series(0, len(w) - n)) t(i)),
hit AS (SELECT p.doc_id, p.i, p.n, x.item_id FROM pos p JOIN win x USING (win, n)),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, unnest(generate_series(0, n - 1)) t(j) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""
