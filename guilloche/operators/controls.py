"""Negative controls: images that must never pass, made from pixel tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guilloche.functions.portable import digits, scatter

from . import pixels as P
from . import stencil as S

_KEYS = ("note_id", "y", "x", "w", "h")


def _with(pixels: DataFrame, b, g, r) -> DataFrame:
    return pixels.select(*_KEYS, b.cast("int").alias("b"), g.cast("int").alias("g"), r.cast("int").alias("r"))


def blank(pixels: DataFrame, level: int) -> DataFrame:
    return _with(pixels, *[F.lit(level)] * 3)


def noise(pixels: DataFrame, seed: int = 0) -> DataFrame:
    """Noise that depends on the place and the seed alone."""
    s = pixels.withColumn("_s", scatter("note_id", "y", "x", seed=seed))
    return _with(s, *[digits(F.col("_s"), 2 * k, 2) for k in range(3)])


def heavy_blur(pixels: DataFrame, *, size: int = 51) -> DataFrame:
    """Gaussian blur of all channels; the image size is carried along, so nothing is joined."""
    return S.blur_channels(pixels, size=size).select(*_KEYS, "b", "g", "r")


def low_resolution(pixels: DataFrame, *, width: int = 80) -> DataFrame:
    """Means over the blocks of a narrow copy, stretched back."""
    nh = F.greatest(F.floor(F.col("h") * width / F.col("w")), F.lit(1))
    keyed = pixels.withColumns({"_bx": F.floor(F.col("x") * width / F.col("w")), "_by": F.floor(F.col("y") * nh / F.col("h"))})
    means = keyed.groupBy("note_id", "_by", "_bx").agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(c) for c in "bgr"])
    return keyed.drop("b", "g", "r").join(means, ["note_id", "_by", "_bx"]).select(*_KEYS, "b", "g", "r")


def half_crop(pixels: DataFrame) -> DataFrame:
    lower = F.col("y") >= F.expr("h div 2")
    return _with(pixels, *[F.when(lower, 0).otherwise(F.col(c)) for c in "bgr"])


def invert(pixels: DataFrame) -> DataFrame:
    return _with(pixels, *[255 - F.col(c) for c in "bgr"])


def desaturate(pixels: DataFrame) -> DataFrame:
    g = P.to_gray(pixels)
    return _with(g, *[F.col("gray")] * 3)


def hue_shift(pixels: DataFrame, *, by: int = 60) -> DataFrame:
    """Hue turned by ``by`` half degrees; back to channels by the sextant of the hue.

    Sextant and levels are generated, so that each is worked out once a pixel.
    """
    t = P.to_hsv(pixels).withColumn("h", (F.col("h") + by) % 180)
    part = F.col("h") / 30 - F.floor(F.col("h") / 30)
    v, s = F.col("v"), F.col("s") / 255
    whole = lambda c: F.floor(F.round(c, 6) + 0.5).cast("int")
    made = F.struct(F.floor(F.col("h") / 30), whole(v * (1 - s)), whole(v * (1 - s * part)), whole(v * (1 - s * (1 - part))))
    t = t.select("*", F.inline(F.array(made)).alias("_sector", "_p", "_q", "_u"))
    sector, p, q, u = (F.col(c) for c in ("_sector", "_p", "_q", "_u"))
    pick = lambda *six: F.when(sector == 0, six[0]).when(sector == 1, six[1]).when(sector == 2, six[2]).when(sector == 3, six[3]).when(sector == 4, six[4]).otherwise(six[5])
    t = t.withColumns({"b": pick(p, p, u, v, v, q), "g": pick(u, v, v, q, p, p), "r": pick(v, q, p, p, u, v)})
    return t.select("note_id", "y", "x", "w", F.col("img_h").alias("h"), "b", "g", "r")


def stretch(pixels: DataFrame, *, factor: float = 1.3) -> DataFrame:
    """Wider image; each target column takes the nearest source column. Every pixel finds the columns that take it, so nothing is joined."""
    nw = F.floor(F.col("w") * factor).cast("int")
    around = F.sequence(F.floor(F.col("x") * F.lit(factor)).cast("int"), F.ceil((F.col("x") + 1) * F.lit(factor)).cast("int"))
    t = pixels.withColumn("nw", nw).withColumn("tx", F.explode(around)).where((F.floor(F.col("tx") / F.lit(factor)) == F.col("x")) & (F.col("tx") < F.col("nw")))
    return t.select("note_id", "y", F.col("tx").alias("x"), F.col("nw").alias("w"), "h", "b", "g", "r")


def motion_blur(pixels: DataFrame) -> DataFrame:
    return S.motion_blur(pixels).select(*_KEYS, "b", "g", "r")
