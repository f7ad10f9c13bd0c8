"""Pixel projections and aggregates.

A pixel table has note_id, y, x, the image size w and h, and the channels b, g, r. Colour
statistics work on the histogram of hue, saturation and value, which is small beside the
pixels; nothing needs the pixels of a note in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Named regions as fractions of height (y0, y1) and width (x0, x1).
REGIONS = {
    "watermark": (0.15, 0.85, 0.0, 0.25),
    "thread": (0.0, 1.0, 0.30, 0.70),
    "thread_narrow": (0.0, 1.0, 0.35, 0.65),
    "hologram": (0.55, 0.95, 0.05, 0.30),
    "ocr_top": (0.0, 0.5, 0.0, 1.0),
    "ocr_bottom": (0.5, 1.0, 0.0, 1.0),
    "denom_top_left": (0.0, 0.30, 0.0, 0.30),
    "denom_top_right": (0.0, 0.30, 0.65, 1.0),
    "denom_bottom_left": (0.65, 1.0, 0.0, 0.30),
    "denom_bottom_right": (0.65, 1.0, 0.55, 1.0),
    "serial": (0.55, 0.97, 0.45, 1.0),
    "serial_top_left": (0.12, 0.32, 0.03, 0.32),
    "serial_bottom_right": (0.78, 1.0, 0.55, 1.0),
}


def gray_of(b: Column, g: Column, r: Column) -> Column:
    return F.floor(0.299 * r + 0.587 * g + 0.114 * b + 0.5).cast("int")


def to_gray(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("gray", gray_of(F.col("b"), F.col("g"), F.col("r")))


def to_hsv(pixels: DataFrame) -> DataFrame:
    """Add h (0-179, half degrees), s and v (0-255).

    They are generated, so that a condition on them is not pushed down, and them with it, to
    where each mention would work them out again.
    """
    b, g, r = F.col("b"), F.col("g"), F.col("r")
    v = F.greatest(b, g, r)
    d = v - F.least(b, g, r)
    hue = F.when(d == 0, 0.0).when(v == r, 30.0 * (g - b) / d).when(v == g, 60.0 + 30.0 * (b - r) / d).otherwise(120.0 + 30.0 * (r - g) / d)
    whole = F.floor(F.when(hue < 0, hue + 180.0).otherwise(hue) + 0.5) % 180
    made = F.struct(whole.cast("int"), F.when(v == 0, 0).otherwise(F.floor(255.0 * d / v + 0.5)).cast("int"), v)
    return pixels.withColumnRenamed("h", "img_h").select("*", F.inline(F.array(made)).alias("h", "s", "v"))


def in_region(name: str, h: str = "h", w: str = "w") -> Column:
    """Whether a pixel lies in a named region; the bounds are cut to whole pixels."""
    y0, y1, x0, x1 = REGIONS[name]
    return (F.col("y") >= F.floor(F.col(h) * y0)) & (F.col("y") < F.floor(F.col(h) * y1)) & (F.col("x") >= F.floor(F.col(w) * x0)) & (F.col("x") < F.floor(F.col(w) * x1))


def crop(pixels: DataFrame, name: str) -> DataFrame:
    """A region's pixels in coordinates of their own."""
    y0, y1, x0, x1 = REGIONS[name]
    size = lambda c, a, b: (F.floor(F.col(c) * b) - F.floor(F.col(c) * a)).cast("int")
    return pixels.where(in_region(name)).withColumns({"y": (F.col("y") - F.floor(F.col("h") * y0)).cast("int"), "x": (F.col("x") - F.floor(F.col("w") * x0)).cast("int"), "h": size("h", y0, y1), "w": size("w", x0, x1)})


def region_pixels(pixels: DataFrame, names=tuple(REGIONS)) -> DataFrame:
    """Every region's pixels: a range join with the small table of regions."""
    dim = pixels.sparkSession.createDataFrame([(n, *map(float, REGIONS[n])) for n in names], "region string, y0 double, y1 double, x0 double, x1 double")
    inside = (F.col("y") >= F.floor(F.col("h") * F.col("y0"))) & (F.col("y") < F.floor(F.col("h") * F.col("y1"))) & (F.col("x") >= F.floor(F.col("w") * F.col("x0"))) & (F.col("x") < F.floor(F.col("w") * F.col("x1")))
    return pixels.join(F.broadcast(dim), inside)


def in_range(hsv: DataFrame, *, s: int = 120, v: int = 120) -> DataFrame:
    return hsv.withColumn("mask", (F.col("s") >= s) & (F.col("v") >= v))


def to_landscape(pixels: DataFrame) -> DataFrame:
    """Images that are taller than wide, turned clockwise."""
    tall = F.col("h") > F.col("w")
    turn = lambda a, b: F.when(tall, a).otherwise(b)
    return pixels.select("note_id", turn(F.col("x"), F.col("y")).alias("y"), turn(F.col("h") - 1 - F.col("y"), F.col("x")).alias("x"), turn(F.col("h"), F.col("w")).alias("w"), turn(F.col("w"), F.col("h")).alias("h"), "b", "g", "r")


def border_count(*, least: int = 3, share: int = 50) -> Column:
    """In how many border bands a pixel lies: two in a corner, none inside."""
    width = F.greatest(F.lit(least), F.floor(F.least("h", "w") / share))
    edge = lambda c: c.cast("int")
    return edge(F.col("y") < width) + edge(F.col("y") >= F.col("h") - width) + edge(F.col("x") < width) + edge(F.col("x") >= F.col("w") - width)


def quadrant() -> Column:
    return F.when(F.col("y") < F.expr("h div 2"), F.when(F.col("x") < F.expr("w div 2"), 0).otherwise(1)).otherwise(F.when(F.col("x") < F.expr("w div 2"), 2).otherwise(3))


def block_means(pixels: DataFrame, *, grid: int = 16) -> DataFrame:
    """Image on a fixed grid, channels from 0 to 1: the mean of each block."""
    by, bx = F.expr(f"y * {grid} div h").cast("int").alias("gy"), F.expr(f"x * {grid} div w").cast("int").alias("gx")
    return pixels.groupBy("note_id", by, bx).agg(*[(F.avg(c) / 255).alias(c) for c in "bgr"])


def hsv_histogram(pixels: DataFrame) -> DataFrame:
    """note_id, h, s, v, n: the one pass over the pixels that all colour statistics share."""
    return to_hsv(pixels).groupBy("note_id", "h", "s", "v").agg(F.count("*").alias("n"))


def hsv_pixels(pixels: DataFrame) -> DataFrame:
    """The pixels as a histogram of ones, for sums that ask for no colour: they need no row a colour."""
    return to_hsv(pixels).select("note_id", "h", "s", "v", F.lit(1).alias("n"))


def _share(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")


def saturated_ratio(hist: DataFrame, *, s: int = 120, v: int = 120) -> DataFrame:
    return hist.groupBy("note_id").agg(_share((F.col("s") >= s) & (F.col("v") >= v)).alias("uv_ratio"))


def mean_saturation(hist: DataFrame) -> DataFrame:
    return hist.groupBy("note_id").agg((F.sum(F.col("s") * F.col("n")) / F.sum("n")).alias("mean_sat"))


def hue_histogram(hist: DataFrame, *, s: int = 60) -> DataFrame:
    """Share of each hue among the coloured pixels of a note."""
    hue = hist.where(F.col("s") > s).groupBy("note_id", "h").agg(F.sum("n").alias("n"))
    return hue.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("note_id")))


def hue_entropy(hist: DataFrame, *, min_coloured: int = 0) -> DataFrame:
    """Entropy of the hues in bits and the coloured pixels; 0 with fewer of them than asked for."""
    e = hue_histogram(hist).groupBy("note_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum("n").alias("coloured"))
    return e.withColumn("entropy", F.when(F.col("coloured") < min_coloured, 0.0).otherwise(F.col("entropy")))


def masked_medians(hist: DataFrame, *, s: int = 25) -> DataFrame:
    """Median hue and saturation of the pixels that are not pale."""
    return hist.where(F.col("s") > s).groupBy("note_id").agg(F.percentile("h", 0.5, F.col("n")).alias("med_hue"), F.percentile("s", 0.5, F.col("n")).alias("med_sat"), F.sum("n").alias("coloured_px"))


def coloured_share(hist: DataFrame, *, s: int = 25) -> DataFrame:
    return hist.groupBy("note_id").agg(_share(F.col("s") > s).alias("coloured_share"))


def brightness_std(pixels: DataFrame) -> DataFrame:
    return to_gray(pixels).groupBy("note_id").agg(F.stddev_pop("gray").alias("brightness_std"))


def dark_quadrants(pixels: DataFrame, *, below: float = 25) -> DataFrame:
    q = to_gray(pixels).groupBy("note_id", quadrant().alias("q")).agg(F.avg("gray").alias("m"))
    return q.groupBy("note_id").agg(F.count_if(F.col("m") < below).alias("dark_quadrants"))


def border_interior_std(pixels: DataFrame) -> DataFrame:
    """Spread of all channels in the border bands (corners count twice) and inside; null where a side is empty.

    One pass of sums: exact integers, no row is copied.
    """
    k = border_count()
    total, square = F.col("b") + F.col("g") + F.col("r"), F.col("b") * F.col("b") + F.col("g") * F.col("g") + F.col("r") * F.col("r")
    inside = F.when(k == 0, 1).otherwise(0)
    sums = pixels.groupBy("note_id").agg(*[F.sum(weight * what).cast("double").alias(f"{a}{b}") for a, weight in (("o", k), ("i", inside)) for b, what in (("n", F.lit(3)), ("s", total), ("q", square))])
    std = lambda a: F.when(F.col(f"{a}n") > 0, F.sqrt(F.greatest(F.lit(0.0), F.col(f"{a}q") / F.col(f"{a}n") - F.pow(F.col(f"{a}s") / F.col(f"{a}n"), 2))))
    return sums.select("note_id", std("o").alias("border_std"), std("i").alias("interior_std"))


def borders_uniform(pixels: DataFrame, *, border: float = 25, interior: float = 15) -> DataFrame:
    """Whether a note fills an isolated scan: even borders around something (false without an interior)."""
    s = border_interior_std(pixels)
    return s.select("note_id", F.coalesce((F.col("border_std") < border) & (F.col("interior_std") > interior), F.lit(False)).alias("uniform"))


def otsu(values: DataFrame, value: str) -> DataFrame:
    """note_id, threshold: the level of a 256-bin histogram with the largest variance between both sides, the first of equals."""
    hist = values.groupBy("note_id", F.col(value).alias("level")).agg(F.count("*").alias("n"))
    upto, all_ = Window.partitionBy("note_id").orderBy("level").rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("note_id")
    c = hist.withColumns({"w0": F.sum("n").over(upto), "s0": F.sum(F.col("n") * F.col("level")).over(upto), "w": F.sum("n").over(all_), "s": F.sum(F.col("n") * F.col("level")).over(all_)})
    w1 = F.col("w") - F.col("w0")
    between = F.when(w1 > 0, F.col("w0").cast("double") * w1 * F.pow(F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1, 2)).otherwise(F.lit(0.0))
    best = c.groupBy("note_id").agg(F.max(F.struct(F.round(between, 3).alias("v"), (-F.col("level")).alias("l"))).alias("b"))
    return best.select("note_id", F.when(F.col("b.v") > 0, -F.col("b.l")).otherwise(0).cast("int").alias("threshold"))


def patch_score(pixels: DataFrame) -> DataFrame:
    """Spread of hue and saturation in the hologram patch."""
    hsv = to_hsv(crop(pixels, "hologram"))
    return hsv.groupBy("note_id").agg((0.6 * F.stddev_pop("h") + 0.4 * F.stddev_pop("s")).alias("patch_score"))
