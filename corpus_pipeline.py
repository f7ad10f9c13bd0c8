"""Corpus pipeline: five stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and
read again as the next stage's ``docs``. All stages but the last return the columns of
``documents``. A doc_id may be null or stand for several texts; rows have numbers of their own
within a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guilloche.llm import decontaminate, line_dedup, near_dup, packing, quality_rules
from guilloche.llm.common import stage, table
from guilloche.llm.tokenize import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number ``_row`` of each row, which stays as it is: neither null nor repeated, unlike a doc_id."""
    return stage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "rows")


def _only(rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """The rows whose number is in ``numbers``."""
    return rows.join(numbers.select("_row").hint("merge"), "_row", "left_semi").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a risk-controlled threshold reject go; each row is judged by its own text.

    A null text goes, an empty one as well. Rows without doc_id, rows that repeat one and equal
    rows are each judged. A null language is a stratum of its own. An empty table gives none.
    """
    rows = _numbered(docs)
    return _only(rows, quality_rules.judge(rows, table(spark, sf_dir, "labels"), keep=("_row",)).where("kept"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of lines that an earlier document has go; a document of which no word is left goes as well.

    Documents are in order of doc_id, those without one after all others, those of equal id in
    order of their text's hash. Rows of equal id and text lose the same lines. Null and empty
    texts stay. ``n_chars`` follows a changed text. An empty table gives none.
    """
    cut = line_dedup.deduplicate(docs.select(*COLUMNS, F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("_order")), min_words=10, id_col="_order")
    changed = F.col("n_removed") > 0
    left = cut.where(~changed | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id, one without id only if none has one.

    Of rows that repeat id and text one stays as well, also where the text has no words; rows
    of one id with different texts are different documents. Of equal ids in a group the text
    with the smallest hash stays. An empty table gives none.
    """
    rows = _numbered(docs)
    groups = near_dup.components(rows, shingle=5, percent=80, id_col="_row").select(F.col("doc_id").alias("_row"), "component_id", "n_shingles")
    keyed = rows.select("_row", "doc_id", F.xxhash64("text").alias("_text")).join(groups.hint("merge"), "_row")
    # A text without words is in no group: only its own repeats are copies of it.
    words = F.col("n_shingles") > 0
    group = [F.when(words, F.col("component_id")), F.when(~words, F.col("doc_id")), F.when(~words, F.col("_text"))]
    first = keyed.groupBy(*[c.alias(f"_g{i}") for i, c in enumerate(group)]).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_text", "_row")).alias("f"))
    return _only(rows, first.select("f._row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go; each row is judged by its own text.

    Null and empty texts hold none and stay, as do all rows without benchmark items. Rows
    without doc_id, rows that repeat one and equal rows are each judged. An empty table gives none.
    """
    rows = _numbered(docs)
    return _only(rows, decontaminate.contamination(rows, table(spark, sf_dir, "benchmark"), id_col="_row").where("not contaminated").select(F.col("doc_id").alias("_row")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in the training sequences.

    Null and empty texts are the end id alone. Rows that repeat a doc_id are each packed; a
    null doc_id stays null. An empty table gives none.
    """
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), size=2048, end_id=1)


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("near_dup", near_duplicates), ("decontamination", decontamination), ("packing", pack)]

#: Tokenizer ids and the risk-controlled cutoffs have no SQL form; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the whole ``documents`` table."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
