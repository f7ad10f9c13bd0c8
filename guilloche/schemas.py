"""Constants and small dimension tables of the screening operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Note sizes in millimetres and colour boxes (hue 0-179, saturation 0-255) by denomination.
DIMENSIONS_MM = {"10": (123, 63), "20": (129, 63), "50": (135, 66), "100": (142, 66), "200": (146, 66), "500": (150, 66), "2000": (166, 66)}
PALETTE = {"10": (5, 22, 30, 200), "20": (35, 65, 60, 255), "50": (85, 105, 40, 255), "100": (115, 145, 30, 200), "200": (15, 40, 90, 255), "500": (15, 55, 0, 80), "2000": (155, 179, 50, 255)}
# Denominations, what a misread first digit stands for, and characters that readers confuse.
KNOWN_DENOMINATIONS = ("10", "20", "50", "100", "200", "500", "2000")
LEADING_FIX = {"9": ("5", "2", "1"), "8": ("5",), "4": ("1",), "6": ("5",)}
DIGIT_FROM, DIGIT_TO = "OIJSB", "01158"
LETTER_FROM, LETTER_TO = "0158", "OISB"
# The checks of a note, in report order.
CHECKS = (
    "structural_sanity",
    "uv_light_detection",
    "watermark_detection",
    "ocr_serial_number",
    "gandhi_face_analysis",
    "security_thread_detection",
    "serial_typography_analysis",
    "hologram_detection",
    "denomination_classification",
    "proportion_analysis",
)
CONSTANT_CHECK = "modular_ai_pipeline"


def dimensions(spark: SparkSession) -> DataFrame:
    """denom, width_mm, height_mm, expected_aspect."""
    return spark.createDataFrame([(d, w, h, w / h) for d, (w, h) in DIMENSIONS_MM.items()], "denom string, width_mm int, height_mm int, expected_aspect double")


def palette(spark: SparkSession) -> DataFrame:
    """denom, hue_lo, hue_hi, sat_lo, sat_hi."""
    return spark.createDataFrame([(d, *box) for d, box in PALETTE.items()], "denom string, hue_lo int, hue_hi int, sat_lo int, sat_hi int")


def leading_fix(spark: SparkSession) -> DataFrame:
    """head, replacement, nth."""
    return spark.createDataFrame([(h, r, k) for h, rs in LEADING_FIX.items() for k, r in enumerate(rs)], "head string, replacement string, nth int")


def values_sql(rows) -> str:
    """Rows as the body of a SQL VALUES list, for oracle queries."""
    quote = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return "VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)
