"""Evaluation over a labelled corpus of notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import running

GRADE_ORDER = ("clean", "phone", "edge_case", "fake")


def select_notes(manifest: DataFrame, *, grade=None, has_serial=None, side=None, fake_type=None) -> DataFrame:
    """Manifest rows that meet all conditions that are given."""
    out = manifest
    for name, value in (("grade", grade), ("side", side), ("fake_type", fake_type)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if has_serial is not None:
        out = out.where(F.col("serial").isNotNull() if has_serial else F.col("serial").isNull())
    return out


def missing_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Manifest rows whose path is not among the files."""
    return manifest.join(files.select("path").distinct(), "path", "left_anti")


def grade_tally(manifest: DataFrame, grades=GRADE_ORDER) -> DataFrame:
    """Notes of each grade, grades without notes included."""
    dim = manifest.sparkSession.createDataFrame([(g,) for g in grades], "grade string")
    return F.broadcast(dim).join(manifest.groupBy("grade").agg(F.count("*").alias("n")), "grade", "left").select("grade", F.coalesce("n", F.lit(0)).alias("n"))


def known_serials(manifest: DataFrame) -> DataFrame:
    """Phone photos whose serial number is known."""
    return select_notes(manifest, grade="phone", has_serial=True).select("path", "denom", "serial")


def expected_actual(truth: DataFrame, read: DataFrame) -> DataFrame:
    """Whether denomination and serial came out as expected; without a known serial any is right."""
    j = truth.select("note_id", F.col("denom").alias("denom_expected"), F.col("serial").alias("serial_expected")).join(read.select("note_id", F.col("denom").alias("denom_read"), F.col("serial").alias("serial_read")), "note_id", "left")
    mark = lambda ok: F.when(ok, "OK ").otherwise("BAD")
    return j.withColumns({"denom_mark": mark(F.col("denom_expected").eqNullSafe(F.col("denom_read"))), "serial_mark": mark(F.col("serial_expected").isNull() | F.col("serial_expected").eqNullSafe(F.col("serial_read")))})


def miss_count(pairs: DataFrame, expected: Column, actual: Column, *, tolerance_divisor: int) -> DataFrame:
    """Misses against max(1, n / divisor) allowed ones."""
    return pairs.agg(F.count("*").alias("n"), F.count_if(~expected.eqNullSafe(actual)).alias("misses")).select("n", "misses", F.greatest(F.lit(1), F.floor(F.col("n") / tolerance_divisor)).cast("long").alias("allowed")).withColumn("passed", F.col("misses") <= F.col("allowed"))


def spurious_serials(serials: DataFrame, manifest: DataFrame) -> DataFrame:
    """Serials that were read on notes that hold none: structural fakes."""
    return serials.where(F.col("serial").isNotNull()).join(select_notes(manifest, fake_type="structural"), "note_id", "left_semi")


def confusion(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Verdict counts for each label."""
    return verdicts.join(labels.select("note_id", "label"), "note_id").groupBy("label").pivot("verdict", ["REAL", "SUSPICIOUS", "FAKE"]).count().select("label", *[F.coalesce(v, F.lit(0)).alias(v.lower()) for v in ("REAL", "SUSPICIOUS", "FAKE")])


def separators(checks: DataFrame, labels: DataFrame) -> DataFrame:
    """How well each check tells the labels apart: real PASS plus fake FAIL, over all notes."""
    c = checks.join(labels.select("note_id", "label"), "note_id")
    count = lambda label, status: F.count_if((F.col("label") == label) & (F.col("status") == status)).alias(f"{label}_{status.lower()}")
    return c.groupBy("check_name").agg(count("real", "PASS"), count("real", "FAIL"), count("fake", "PASS"), count("fake", "FAIL"), F.count_if(F.col("label") == "real").alias("n_real"), F.count_if(F.col("label") == "fake").alias("n_fake")).withColumn("separator", F.col("real_pass") + F.col("fake_fail"))


def signal_distribution(signals: DataFrame, key: str, *, value: str = "signal") -> DataFrame:
    """Lowest, upper median (the element at n / 2 of the sorted values) and highest value of each group.

    Distinct values are counted first, and added up by ranges, so that no task holds a group.
    """
    counts = signals.groupBy(key, value).agg(F.count("*").alias("c"))
    run = running(counts, [key], [F.col(value)], {"upto": F.col("c")})
    ends = counts.groupBy(F.col(key).alias("_key")).agg(F.sum("c").alias("n"), F.min(value).alias("lowest"), F.max(value).alias("highest"))
    middle = run.join(ends, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("upto") > F.floor(F.col("n") / 2))
    return middle.groupBy(key, "n", "lowest", "highest").agg(F.min(value).alias("upper_median")).select(key, "n", "lowest", "upper_median", "highest")


def bucket_of(grade: str = "grade", fake_type: str = "fake_type") -> Column:
    """The grade; of fakes with the subtype."""
    return F.when(F.col(grade) == "fake", F.concat(F.lit("fake/"), F.coalesce(fake_type, F.lit("unknown")))).otherwise(F.col(grade))


def found_rate(signals: DataFrame, key: str, found: Column, *, value: str = "signal") -> DataFrame:
    """Share of samples with a finding, and mean value, of each bucket."""
    return signals.groupBy(key).agg(F.count("*").alias("n"), F.round(F.avg(found.cast("int")), 6).alias("found_rate"), F.round(F.avg(value), 6).alias("mean_value"))


def misclassified(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Real notes found SUSPICIOUS and fakes found REAL."""
    j = verdicts.select("note_id", "verdict").join(labels.select("note_id", "label"), "note_id")
    return j.where("label = 'real' and verdict = 'SUSPICIOUS'").withColumn("kind", F.lit("real_suspicious")).unionByName(j.where("label = 'fake' and verdict = 'REAL'").withColumn("kind", F.lit("fake_real")))


def grade_sorted(manifest: DataFrame) -> DataFrame:
    """Manifest rows by grade, unknown grades last, then path."""
    rank = F.lit(9)
    for k, g in reversed(list(enumerate(GRADE_ORDER))):
        rank = F.when(F.col("grade") == g, k).otherwise(rank)
    return manifest.withColumn("grade_rank", rank).orderBy("grade_rank", "path")


def token_dump(tokens: DataFrame, *, k: int = 3, min_conf: int = 30) -> DataFrame:
    """The k surest tokens of each note above a floor, and all of them as one text."""
    w = Window.partitionBy("note_id").orderBy(F.desc("conf"), "seq")
    top = tokens.where(F.col("conf") >= min_conf).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " | ").alias("tokens"), F.count("*").alias("n"))


def line_markers(tokens: DataFrame) -> DataFrame:
    """A note's tokens as one line, and whether it has letters, digits or both."""
    line = tokens.groupBy("note_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("line"))
    letters, digits = F.col("line").rlike("[A-Za-z]"), F.col("line").rlike("[0-9]")
    return line.withColumn("marker", F.when(letters & digits, "both").when(letters, "letters").when(digits, "digits").otherwise("none"))
