"""Queries and oracle SQL of whole screenings, check rows and image files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guilloche.operators import checks as C
from guilloche.operators import pixels as P
from guilloche.operators import verdict as V
from guilloche.schemas import CHECKS, DIMENSIONS_MM, LEADING_FIX, PALETTE, dimensions, leading_fix, palette, values_sql
from guilloche.sources import images as I
from guilloche.staging import new_path, stage
from guilloche.streaming.parts import LISTS, PART, rocksdb_state, screen_parts
from guilloche.streaming.screen import arriving, screen_stream

from . import pixel_queries as X
from . import shape_queries as Y
from . import token_queries as T
from .fixtures import load, oracle
from .screening import Inputs, all_checks, report, screen, screen_gathered


def _inputs(spark, d) -> Inputs:
    pixels = load(spark, d, "fx_pixels")
    notes = stage(pixels.select("note_id").distinct(), "notes")
    return Inputs(pixels, *[load(spark, d, f"fx_{t}", of=notes) for t in ("tokens", "blobs", "contours", "faces")], known=notes)


def _unread(spark, d) -> Inputs:
    """Notes whose outlines are looked for in their own pixels; the fixture's contours belong to larger frames."""
    return replace(_inputs(spark, d), contours=None)


def c11(spark, d):
    return all_checks(_unread(spark, d))


def _unlocated(spark, d) -> Inputs:
    """The small frames of the fixture hold no outline: its contours belong to larger ones."""
    given = _inputs(spark, d)
    given.contours = given.contours.where("img_w * img_h < 10000")
    return given


def v7(spark, d):
    return screen(_unread(spark, d), load(spark, d, "fx_scores"))


def png(w: int, h: int, values: list[int] | bytes) -> bytes:
    """An 8-bit RGB image, row by row, as a PNG file."""
    lines = b"".join(b"\0" + bytes(values[3 * w * y : 3 * w * (y + 1)]) for y in range(h))
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines)) + part(b"IEND", b"")


def write_images(pixels: DataFrame, path: str, where: str, *, cut: int | None = None) -> None:
    """Write each image of a pixel table as a file ``<path>/<where>.png``, or its first ``cut`` bytes; ``where`` is a column.

    A file for each image, named alike at every attempt; an image is one row here.
    """
    flat = I.packed(pixels, where, order="rgb").select(where, "w", "h", "data")

    def write(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, w, h, v in zip(*(batch.column(k).to_pylist() for k in range(4))):
                store.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{base}/{name}.png") as out:
                    out.write(png(w, h, v)[:cut])
            yield pa.RecordBatch.from_arrays([batch.column(0)], [where])

    flat.mapInArrow(write, f"{where} string").write.format("noop").mode("overwrite").save()


def _tree(spark: SparkSession, d: str) -> str:
    """An image tree of all notes of the pixel fixture: label/denomination/note.png."""
    place = F.concat(F.when(F.col("note_id") % 4 == 3, "fake").otherwise("real"), F.lit("/"), F.element_at(F.array(*[F.lit(k) for k in DIMENSIONS_MM]), (F.col("note_id") % 7 + 1).cast("int")), F.lit("/"), F.col("note_id"))
    path = new_path(spark, "images")
    write_images(load(spark, d, "fx_pixels").withColumn("place", place), path, "place")
    return path


def _named(images: DataFrame) -> DataFrame:
    return images.withColumn("note_id", F.regexp_extract("path", r"([0-9]+)\.png$", 1).cast("long"))


def s1(spark, d):
    return _named(I.scan_images(spark, _tree(spark, d))).select("note_id", "label", "denom", F.col("image.width").alias("w"), F.col("image.height").alias("h"))


def s2(spark, d):
    """Every fourth file is cut off within its header and lands in quarantine."""
    path = _tree(spark, d)
    px = load(spark, d, "fx_pixels")
    write_images(px.where("note_id % 4 = 0").withColumn("place", F.concat(F.lit("real/10/broken"), F.col("note_id"))), path, "place", cut=20)
    good, bad = I.split_uploads(spark, path)
    files = good.select("path", F.lit("ok").alias("state")).unionByName(bad.select("path", F.lit("unreadable").alias("state")))
    return files.select(F.regexp_extract("path", r"([a-z]*[0-9]+)\.png$", 1).alias("file"), "state")


def s4(spark, d):
    return I.to_pixels(_named(I.scan_images(spark, _tree(spark, d)))).select("note_id", "y", "x", "w", "h", "b", "g", "r")


def s5(spark, d):
    return I.to_pixels(_named(I.scan_images(spark, _tree(spark, d))), stride=4).groupBy("note_id").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in "bgr"])


def s3(spark, d):
    """Manifests, each a JSON map with a comment, written and read back."""
    notes = load(spark, d, "fx_notes").select("path", F.struct("denom", "side", "serial", F.lit("scan").alias("source"), "grade", "fake_type", F.lit(None).cast("string").alias("notes")).alias("r"))
    path = new_path(spark, "manifest")
    parts = notes.groupBy(F.pmod(F.xxhash64("path"), F.lit(64)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("path", "r"))).alias("m"))
    text = parts.select("part", F.concat(F.lit('{"_about": {"notes": "fixture"}, '), F.substring(F.to_json("m", {"ignoreNullFields": "false"}), 2, 1 << 30)).alias("value"))
    text.write.partitionBy("part").text(path)  # one file for each map
    return I.read_manifest(spark, path).select("path", "denom", "side", "serial", "source", "grade", "fake_type")


def _report(spark, d):
    checks, scores = load(spark, d, "fx_checks"), load(spark, d, "fx_scores")
    labels = load(spark, d, "fx_notes").select("note_id", "label", F.col("path").alias("file"))
    signals = load(spark, d, "fx_palette_stats").select("note_id", "med_hue", "med_sat")
    return report(checks, V.verdicts(checks, scores), labels, signals)


def s6(spark, d):
    """The report as written: one line of JSON a note."""
    path = new_path(spark, "report")
    I.write_report(_report(spark, d), path)
    lines = spark.read.text(path)
    field = lambda p: F.get_json_object("value", p)
    return lines.select(field("$.file").alias("file"), field("$.final_verdict").alias("final_verdict"), field("$.forensic_analysis.hologram_detection.status").alias("palette"), field("$.diagnostic.med_hue").cast("double").alias("med_hue"))


def s7(spark, d):
    path = new_path(spark, "report")
    I.write_report(_report(spark, d), path)
    r = I.read_report(spark, path)
    status = F.col("forensic_analysis")["proportion_analysis"]["status"]
    return r.select("label", "file", "model_raw", "model_verdict", "forensic_pass", "forensic_total", F.round("combined_score", 6).alias("combined_score"), "final_verdict", F.size("forensic_analysis").alias("n_checks"), status.alias("proportion"), F.col("diagnostic")["med_sat"].alias("med_sat"))


def s10(spark, d):
    """Notes of the collection with the fixed values of their denomination."""
    heads = leading_fix(spark).groupBy("head").agg(F.count("*").alias("ways"))
    n = load(spark, d, "fx_notes").select("note_id", "denom", F.substring("denom", 1, 1).alias("head"))
    j = n.join(F.broadcast(dimensions(spark)), "denom", "left").join(F.broadcast(palette(spark)), "denom", "left").join(F.broadcast(heads), "head", "left")
    return j.select("note_id", "denom", "width_mm", "height_mm", F.round("expected_aspect", 6).alias("expected_aspect"), "hue_lo", "hue_hi", "sat_lo", "sat_hi", F.coalesce("ways", F.lit(0)).alias("ways"))


def s8_images(spark, d):
    """Image files that arrive in a folder: each is unpacked and its structural verdict written as it comes."""
    path = _tree(spark, d)
    out, state = new_path(spark, "stream"), new_path(spark, "stream-state")
    many = load(spark, d, "supplier").count()  # an image each; no more batches for more of them
    source = arriving(spark, path, spark.read.format("image").load(path).schema, format="image", files_per_batch=max(40, many // 8), recursive=True)

    def judge(rows: DataFrame) -> DataFrame:
        hist = P.hsv_histogram(I.to_pixels(_named(I.with_labels(rows.where("image.nChannels > 0")))))
        return C.palette_integrity(hist).unionByName(C.uv_features(hist)).select("note_id", "check_name", "status")

    query = screen_stream(spark, source, judge, out, state)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(out).select("note_id", "check_name", "status")


def note_parts(given: Inputs, scores: DataFrame, *, due: int | None = None) -> DataFrame:
    """Every part of every note that has an image, as ``streaming.parts`` takes them; ``made`` and ``due`` deal them out.

    With ``due`` only the arrivals of that value are made. ``given.known`` may be these notes.
    """
    notes = stage(given.pixels.select("note_id").distinct(), "notes") if given.known is None else given.known.select("note_id")
    none = lambda kind: F.lit(None).cast(kind)
    when = lambda kind: F.pmod(F.xxhash64("note_id", F.lit(kind)), F.lit(3)).cast("int")
    # Before parts are made: a condition on their kind would come after that, and their rows of all notes before.
    of = lambda table, kind: table if due is None else table.where(when(kind) == due)
    out = I.packed(of(given.pixels, "image"), order="bgr").select("note_id", F.lit("image").alias("kind"), "w", "h", "data", none("string").alias("body"))
    for kind, table in zip(LISTS, (given.tokens, given.blobs, given.contours, given.faces)):
        body = F.to_json(F.collect_list(F.struct(*[c for c in table.columns if c != "note_id"]))).alias("body")
        lists = table.join(of(notes, kind), "note_id", "left_semi").groupBy("note_id").agg(body)
        out = out.unionByName(of(notes, kind).join(lists, "note_id", "left").select("note_id", F.lit(kind).alias("kind"), F.coalesce("body", F.lit("[]")).alias("body")), allowMissingColumns=True)
    out = out.unionByName(of(notes, "score").join(scores, "note_id").select("note_id", F.lit("score").alias("kind"), F.col("raw").cast("string").alias("body")), allowMissingColumns=True)
    return out.withColumn("due", F.pmod(F.xxhash64("note_id", "kind"), F.lit(3)).cast("int"))


def write_parts(parts: DataFrame, path: str, due: int) -> None:
    """A folder with the arrivals of one value of ``due``, made ``due`` minutes after the first ones."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + 60 * F.col("due"))
    rows = parts.select("note_id", "kind", at.alias("at"), "w", "h", "data", "body", "due")
    rows.where(F.col("due") == due).drop("due").write.option("compression", "zstd").parquet(f"{path}/due={due}")


def s8_parts(spark, d):
    """Parts of notes that arrive in three batches in shuffled order, some of them twice: each note gets its record once, when its last part is there."""
    path, out, state = new_path(spark, "parts"), new_path(spark, "stream"), new_path(spark, "stream-state")
    given, scores = _unlocated(spark, d), load(spark, d, "fx_scores")
    third = replace(given, **{k: getattr(given, k).where("note_id % 3 = 0") for k in ("pixels", "known")})
    with rocksdb_state(spark):
        for due in range(3):  # the stream goes on from its checkpoint with what has arrived since
            parts = note_parts(given, scores, due=due)
            if due == 2:
                parts = parts.unionByName(note_parts(third, scores).withColumn("due", F.lit(2)))
            write_parts(parts, path, due)
            source = spark.readStream.schema(PART).option("recursiveFileLookup", True).parquet(path)
            query = screen_parts(source, screen_gathered, out, state)
            query.awaitTermination()
            if query.exception():
                raise query.exception()
    return spark.read.parquet(out).drop("batch")


QUERIES = {
    "c6_serial_row": T.t13, "c7_denomination_row": T.d6, "c8_typography_row": Y.y9, "c11_assembled_checks": c11, "v7_screened_notes": v7,
    "s1_scan_images": s1, "s2_uploads": s2, "s3_manifest": s3, "s4_channels": s4, "s5_pixel_rows": s5, "s6_report_sink": s6, "s7_report_scan": s7, "s8_stream_images": s8_images, "s8_stream_parts": s8_parts, "s10_dimensions": s10,
}

_DENOM = "CASE note_id % 7 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(DIMENSIONS_MM)) + " END"
_IMAGES = "(SELECT DISTINCT note_id FROM fx_pixels)"
#: Palette statistics from the pixels themselves, in place of the fixture's.
_STATS = "fx_palette_stats AS (SELECT note_id, median(h) FILTER (s > 25) AS med_hue, median(s) FILTER (s > 25) AS med_sat, count(*) FILTER (s > 25) AS coloured_px, count(*) AS total_px FROM hsv GROUP BY note_id)"
_ROWS = ("c1_structural_sanity", "c2_uv_features", "c3_watermark", "c4_security_thread", "c5_palette_integrity")


def _assembled() -> str:
    """The ten checks of the pixel fixture's notes, each by its own oracle; those of tokens, blobs and faces for these notes alone."""
    read = oracle(",\n".join([X._PX, _STATS, T._scored(1).lstrip()]) + "SELECT note_id, check_name, status, value FROM dc", "fx_pixels", "fx_tokens").replace("fx_palette_stats AS MATERIALIZED", "unused AS MATERIALIZED")
    aspect = oracle(X._PX + f"SELECT note_id, CASE WHEN border_std < 25 AND interior_std > 15 THEN 140::DOUBLE / 64 END AS aspect FROM a8", "fx_pixels")
    dims = values_sql((k, w / h) for k, (w, h) in DIMENSIONS_MM.items())
    proportion = f"SELECT note_id, 'proportion_analysis' AS check_name, CASE WHEN expected IS NULL OR aspect IS NULL THEN 'INFO' WHEN abs(aspect - expected) / expected * 100 <= 15 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({read}) r LEFT JOIN ({aspect}) a USING (note_id) LEFT JOIN ({dims}) dim(denom, expected) ON dim.denom = r.value"
    parts = [X.ORACLE_SQL[k] for k in _ROWS] + [X.ORACLE_SQL["c10_portrait"], T.ORACLE_SQL["t13_serial_check"], Y.ORACLE_SQL["y9_typography_check"], read, proportion]
    rows = " UNION ALL ".join(f"SELECT note_id, check_name, status FROM ({p}) p{i}" for i, p in enumerate(parts))
    names = ", ".join(f"('{c}')" for c in CHECKS)
    notes = oracle("SELECT DISTINCT note_id FROM fx_pixels", "fx_pixels")
    return f"""SELECT n.note_id, c.check_name, coalesce(r.status, 'INFO') AS status FROM ({notes}) n CROSS JOIN (VALUES {names}) c(check_name) LEFT JOIN ({rows}) r ON r.note_id = n.note_id AND r.check_name = c.check_name
UNION ALL SELECT note_id, 'modular_ai_pipeline', 'PASS' FROM ({notes}) m"""


_SCREENED = """
f AS (SELECT note_id, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status = 'PASS') AS p, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status IN ('PASS', 'FAIL')) AS t,
  bool_or(check_name = 'structural_sanity' AND status = 'FAIL') AS sf, bool_or(check_name = 'hologram_detection' AND status = 'FAIL') AS pf, bool_or(check_name = 'proportion_analysis' AND status = 'FAIL') AS rf FROM fx_checks GROUP BY note_id),
c AS (SELECT f.*, raw, p / greatest(t, 1) AS s, 0.4::DOUBLE * raw + 0.6::DOUBLE * (p / greatest(t, 1)) AS c FROM f JOIN fx_scores USING (note_id))
SELECT note_id, CASE WHEN sf THEN 'FAKE' WHEN c >= 0.65::DOUBLE AND p >= 5 AND NOT pf AND NOT rf THEN 'REAL' WHEN c < 0.35::DOUBLE OR (raw < 0.35::DOUBLE AND s < 0.35::DOUBLE) THEN 'FAKE' ELSE 'SUSPICIOUS' END AS prediction,
 round_even(greatest(c, 1 - c) * 100, 2) AS confidence_value, printf('%.2f%%', round_even(greatest(c, 1 - c) * 100, 2)) AS confidence, round_even(s * 100, 2) AS forensic_score_pct, p AS forensic_pass, t AS forensic_total, round(c, 6) AS combined_score FROM c
"""

ORACLE_SQL = {
    "c6_serial_row": T.ORACLE_SQL["t13_serial_check"],
    "c7_denomination_row": T.ORACLE_SQL["d6_classify"],
    "c8_typography_row": Y.ORACLE_SQL["y9_typography_check"],
    "c11_assembled_checks": _assembled(),
    "v7_screened_notes": oracle(f"fx_checks AS ({_assembled()}),{_SCREENED}", "fx_scores"),
    "s1_scan_images": oracle(f"SELECT note_id, CASE WHEN note_id % 4 = 3 THEN 'fake' ELSE 'real' END AS label, {_DENOM} AS denom, 140 AS w, 64 AS h FROM {_IMAGES}", "fx_pixels"),
    "s2_uploads": oracle(f"SELECT CAST(note_id AS VARCHAR) AS file, 'ok' AS state FROM {_IMAGES} UNION ALL SELECT 'broken' || note_id, 'unreadable' FROM {_IMAGES} WHERE note_id % 4 = 0", "fx_pixels"),
    "s3_manifest": oracle("SELECT path, denom, side, serial, 'scan' AS source, grade, fake_type FROM fx_notes", "fx_notes"),
    "s4_channels": oracle("SELECT note_id, y, x, w, h, b, g, r FROM fx_pixels", "fx_pixels"),
    "s5_pixel_rows": oracle("SELECT note_id, count(*) AS n, CAST(sum(b) AS BIGINT) AS b, CAST(sum(g) AS BIGINT) AS g, CAST(sum(r) AS BIGINT) AS r FROM fx_pixels WHERE x % 4 = 0 AND y % 4 = 0 GROUP BY note_id", "fx_pixels"),
    "s8_stream_images": " UNION ALL ".join(f"SELECT note_id, check_name, status FROM ({X.ORACLE_SQL[k]}) q" for k in ("c2_uv_features", "c5_palette_integrity")),
    "s10_dimensions": oracle(
        f"dim(denom, width_mm, height_mm) AS ({values_sql((k, *v) for k, v in DIMENSIONS_MM.items())}), pal(denom, hue_lo, hue_hi, sat_lo, sat_hi) AS ({values_sql((k, *v) for k, v in PALETTE.items())}), fix(head, ways) AS ({values_sql((k, len(v)) for k, v in LEADING_FIX.items())})"
        " SELECT note_id, denom, width_mm, height_mm, round(width_mm / height_mm, 6) AS expected_aspect, hue_lo, hue_hi, sat_lo, sat_hi, coalesce(ways, 0) AS ways FROM fx_notes LEFT JOIN dim USING (denom) LEFT JOIN pal USING (denom) LEFT JOIN fix ON head = substr(denom, 1, 1)",
        "fx_notes",
    ),
}
ORACLE_SQL["s8_stream_parts"] = ORACLE_SQL["v7_screened_notes"]
_JUDGED = """
f AS (SELECT note_id, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status = 'PASS') AS p, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status IN ('PASS', 'FAIL')) AS t, count(*) AS n_checks,
  bool_or(check_name = 'structural_sanity' AND status = 'FAIL') AS sf, bool_or(check_name = 'hologram_detection' AND status = 'FAIL') AS pf, bool_or(check_name = 'proportion_analysis' AND status = 'FAIL') AS rf,
  max(status) FILTER (check_name = 'hologram_detection') AS palette, max(status) FILTER (check_name = 'proportion_analysis') AS proportion FROM fx_checks GROUP BY note_id),
c AS (SELECT f.*, raw, p / greatest(t, 1) AS s, 0.4::DOUBLE * raw + 0.6::DOUBLE * (p / greatest(t, 1)) AS c FROM f JOIN fx_scores USING (note_id)),
v AS (SELECT c.*, CASE WHEN sf THEN 'FAKE' WHEN c >= 0.65::DOUBLE AND p >= 5 AND NOT pf AND NOT rf THEN 'REAL' WHEN c < 0.35::DOUBLE OR (raw < 0.35::DOUBLE AND s < 0.35::DOUBLE) THEN 'FAKE' ELSE 'SUSPICIOUS' END AS verdict, n.label, n.path, med_hue, med_sat FROM c JOIN fx_notes n USING (note_id) JOIN fx_palette_stats USING (note_id))
"""
ORACLE_SQL["s6_report_sink"] = oracle(_JUDGED + "SELECT path AS file, verdict AS final_verdict, palette, med_hue FROM v", "fx_checks", "fx_scores", "fx_palette_stats")
ORACLE_SQL["s7_report_scan"] = oracle(
    _JUDGED + "SELECT label, path AS file, raw AS model_raw, CASE WHEN raw >= 0.5 THEN 'REAL' ELSE 'FAKE' END AS model_verdict, CAST(p AS INT) AS forensic_pass, CAST(t AS INT) AS forensic_total, round(c, 6) AS combined_score, verdict AS final_verdict, CAST(n_checks AS INT) AS n_checks, proportion, med_sat FROM v",
    "fx_checks", "fx_scores", "fx_palette_stats",
)
