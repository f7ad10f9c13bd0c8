"""Stencils and morphology on tiles with a halo, and components of masks.

What looks at neighbouring pixels gets whole tiles, dealt out in one exchange; masks leave them
as runs down the columns, and only the labels of a mask's runs need the runs of one image in
a task.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import pixels as P
from . import tiles as T


def along_row():
    return Window.partitionBy("note_id", "y").orderBy("x")


def down_column():
    return Window.partitionBy("note_id", "x").orderBy("y")


def down_run():
    return Window.partitionBy("note_id", "x").orderBy("y0")


def gaussian_kernel(size: int) -> list[float]:
    """Normalised weights; the width follows from the size."""
    sigma = 0.3 * ((size - 1) / 2 - 1) + 0.8
    k = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(k) for x in k]


@functools.cache
def _band(size: int, n: int) -> np.ndarray:
    """The kernel as a matrix: n + size - 1 values to n weighted means."""
    band = np.zeros((n + size - 1, n))
    for i, k in enumerate(gaussian_kernel(size)):
        band[np.arange(n) + i, np.arange(n)] = k
    return band


def _blurred(pixels: DataFrame, names: tuple[str, ...], size: int) -> DataFrame:
    """Both passes are products with a band matrix; places are rounded, so that the order of a sum does not count."""
    half = size // 2

    def taps(t: T.Tile) -> dict[str, np.ndarray]:
        along, down = _band(size, t.cols), _band(size, t.rows).T
        return {n: np.floor(np.round(down @ (t.values[n] @ along), 6) + 0.5) for n in names}

    return T.per_pixel(pixels, names, (half, half), taps, names)


def blur(values: DataFrame, value: str, *, size: int = 21) -> DataFrame:
    """Gaussian blur (note_id, y, x, value), mirrored at the borders without repeating them; whole numbers.

    Two separable passes over each tile. ``values`` have the image size h and w.
    """
    return _blurred(values, (value,), size).select("note_id", "y", "x", value)


def blur_channels(pixels: DataFrame, *, size: int = 21) -> DataFrame:
    """The same blur of all channels of a pixel table at once."""
    return _blurred(pixels, ("b", "g", "r"), size)


def _gradient(v: np.ndarray, axis: int) -> np.ndarray:
    """Difference along an axis, smoothed 1-2-1 across it; one row and column less on each side."""
    v = v if axis else v.T
    d = v[:, 2:] - v[:, :-2]
    g = d[:-2] + 2 * d[1:-1] + d[2:]
    return g if axis else g.T


def sobel_x(values: DataFrame, value: str) -> DataFrame:
    """Horizontal gradient ``gx``: difference along the row, smoothed 1-2-1 down the column."""
    return T.per_pixel(values, (value,), (1, 1), lambda t: {"gx": _gradient(t.values[value], 1)}, ("gx",))


def sobel_y(values: DataFrame, value: str) -> DataFrame:
    return T.per_pixel(values, (value,), (1, 1), lambda t: {"gy": _gradient(t.values[value], 0)}, ("gy",))


def _strength(v: np.ndarray) -> np.ndarray:
    return np.minimum(np.abs(_gradient(v, 1)), 255)


def edge_strength(values: DataFrame, value: str) -> DataFrame:
    """``sobel``: the absolute horizontal gradient up to 255."""
    return T.per_pixel(values, (value,), (1, 1), lambda t: {"sobel": _strength(t.values[value])}, ("sobel",))


def strength_runs(values: DataFrame, value: str) -> DataFrame:
    """Runs down the columns where the gradient exceeds the image's own Otsu threshold: note_id, x, y0, y1, h.

    Pixels are dealt to tiles once, and the tiles' gradients once to the thresholds.
    """
    tiles = T.cut(values, (value,), (1, 1))

    def strong(t: T.Tile) -> dict:
        flat = _strength(t.values[value]).astype(np.int32).ravel()
        one = {"y0": [t.y0], "x0": [t.x0], "rows": [t.rows], "h": [t.h]}
        return one | {"sobel": pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat))}

    grads = T.on_tiles(tiles, strong, "y0 int, x0 int, rows int, h int, sobel array<int>", (1, 1))
    cut = P.otsu(grads.select("note_id", F.explode("sobel").alias("sobel")), "sobel")
    kind = dict(values.dtypes)["note_id"]

    def runs(batches):
        for b in batches:
            y0, x0, rows, h, cut = (b.column(k).to_numpy() for k in range(1, 6))
            for i in range(b.num_rows):
                mask = (b.column(6)[i].values.to_numpy() > cut[i]).reshape(rows[i], -1)
                x, a, z = T.column_runs(mask, T.Tile(int(y0[i]), int(x0[i]), *mask.shape, int(h[i]), 0, 0, 0, {}))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(x), i))), *[pa.array(np.asarray(v, np.int32)) for v in (x, a, z, np.full(len(x), h[i]))]], ["note_id", "x", "y0", "y1", "h"])

    whole = grads.join(cut, "note_id").select("note_id", "y0", "x0", "rows", "h", "threshold", "sobel")
    return whole.mapInArrow(runs, f"note_id {kind}, x int, y0 int, y1 int, h int")


def _sized(mask: DataFrame) -> DataFrame:
    """A mask whose width does not matter need not have it: tiles then are as wide as any."""
    return mask if "w" in mask.columns else mask.withColumn("w", ((F.floor(F.col("x") / T.SIDE) + 1) * T.SIDE).cast("int"))


def filter_down(mask: DataFrame, c: str, *steps: tuple[str, int]) -> DataFrame:
    """Greatest and least of vertical frames, one step (``max`` or ``min``, rows) after the other, over tiles that reach as far as all of them.

    Pixels that a mask does not have are not set.
    """
    reach = (sum(k for _, k in steps), 0)
    return T.per_pixel(_sized(mask), (c,), reach, lambda t: {c: T.filtered_down(t.values[c], t.inside, steps)[reach[0] : reach[0] + t.rows]}, (c,))


def closing(k: int) -> tuple[tuple[str, int], ...]:
    """Steps of a closing over k rows: gaps in a column are bridged."""
    return ("max", k), ("min", k)


def opening(k: int) -> tuple[tuple[str, int], ...]:
    """Steps of an opening over k rows: only long runs stay."""
    return ("min", k), ("max", k)


def close_down(mask: DataFrame, c: str, k: int) -> DataFrame:
    return filter_down(mask, c, *closing(k))


def open_down(mask: DataFrame, c: str, k: int) -> DataFrame:
    return filter_down(mask, c, *opening(k))


def column_runs(mask: DataFrame, c: str) -> DataFrame:
    """Runs of set pixels down each column: note_id, x, y0, y1 and the image height h."""

    def runs(t: T.Tile) -> dict[str, np.ndarray]:
        x, y0, y1 = T.column_runs(t.values[c] > 0, t)
        return {"x": x, "y0": y0, "y1": y1, "h": np.full(len(x), t.h)}

    return _dilated(T.on_tiles(T.cut(_sized(mask), (c,), (0, 0)), runs, "x int, y0 int, y1 int, h int", (0, 0)), F.lit(1))


def _dilated(runs: DataFrame, k: Column) -> DataFrame:
    """Each run grown by a frame of k rows, cut at the image; runs that then touch are one."""
    before = F.floor(k / 2).cast("int")
    grown = runs.select("note_id", "x", "h", F.greatest(F.col("y0") - (k - 1 - before), F.lit(0)).alias("y0"), F.least(F.col("y1") + before, F.col("h") - 1).alias("y1"))
    w = Window.partitionBy("note_id", "x").orderBy("y0", "y1")
    reach = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = grown.withColumn("_new", F.when(F.col("y0") > reach + 1, 1).otherwise(0)).withColumn("_i", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("note_id", "x", "_i").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("h").alias("h")).drop("_i")


def _eroded(runs: DataFrame, k: Column) -> DataFrame:
    """Each run shrunk by a frame of k rows, but not where it meets the border."""
    before = F.floor(k / 2).cast("int")
    top = F.when(F.col("y0") == 0, 0).otherwise(F.col("y0") + before)
    bottom = F.when(F.col("y1") == F.col("h") - 1, F.col("y1")).otherwise(F.col("y1") - (k - 1 - before))
    return runs.select("note_id", "x", "h", top.alias("y0"), bottom.alias("y1")).where("y0 <= y1")


def close_runs(runs: DataFrame, k: Column) -> DataFrame:
    """``close_down`` on runs, over a number of rows that may differ between images."""
    return _eroded(_dilated(runs, k), k)


def open_runs(runs: DataFrame, k: Column) -> DataFrame:
    """``open_down`` on runs, over a number of rows that may differ between images."""
    return _dilated(_eroded(runs, k), k)


def run_labels(x: np.ndarray, y0: np.ndarray, y1: np.ndarray, *, reach: int = 1) -> np.ndarray:
    """For runs in order of (x, y0) the index of the first run of each one's eight-connected component; four-connected with a ``reach`` of 0.

    Neighbours are found by binary search, labels by hooking and pointer jumping: a few
    vectorised rounds, whatever the shape.
    """
    wide = int(y1.max()) + 3 if len(x) else 1
    low = np.searchsorted(x * wide + y1, (x + 1) * wide + y0 - reach, "left")
    high = np.searchsorted(x * wide + y0, (x + 1) * wide + y1 + reach, "right")
    many = np.maximum(high - low, 0)
    a = np.repeat(np.arange(len(x)), many)
    b = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(low, many)
    label = np.arange(len(x))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            return label
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]


def label_runs(runs: DataFrame, strong: str | None = None) -> DataFrame:
    """Runs with label_x and label_y, the first run of their component, and the image size h and w; with ``strong`` only components in which that column is set somewhere.

    Runs of a column that meet are one. A task holds the runs of an image, which are fewer than
    its pixels.
    """
    columns = ["note_id", "x", "y0", "y1", *[c for c in ("h", "w") if c in runs.columns]]

    def label(rows: pa.Table) -> pa.Table:
        x, y0, y1 = (rows.column(c).to_numpy().astype(np.int64) for c in ("x", "y0", "y1"))
        order = np.lexsort((y0, x))
        x, y0, y1 = x[order], y0[order], y1[order]
        first = np.flatnonzero(np.append(True, (x[1:] != x[:-1]) | (y0[1:] != y1[:-1] + 1)))
        x, y0, y1 = x[first], y0[first], np.maximum.reduceat(y1, first)
        of = run_labels(x, y0, y1)
        label_x, label_y, kept = x[of], y0[of], slice(None)
        if strong:
            some = np.maximum.reduceat(rows.column(strong).to_numpy()[order], first) > 0
            kept = np.bincount(of, some, len(of))[of] > 0
        size = rows.slice(0, 1)
        found = {"x": x, "y0": y0, "y1": y1, **{c: np.full(len(x), size.column(c)[0].as_py()) for c in columns[4:]}, "label_x": label_x, "label_y": label_y}
        found = {c: pa.array(v[kept].astype(np.int32)) for c, v in found.items()}
        note = rows.column("note_id").combine_chunks().take(pa.array(np.zeros(len(found["x"]), np.int64)))
        return pa.table({"note_id": note} | found)

    kind = dict(runs.dtypes)["note_id"]
    some = runs.select(*columns, *([strong] if strong else []))
    sizes = "".join(f", {c} int" for c in columns[4:])
    return some.groupBy("note_id").applyInArrow(label, f"note_id {kind}, x int, y0 int, y1 int{sizes}, label_x int, label_y int")


def run_components(runs: DataFrame) -> DataFrame:
    """Eight-connected components of runs: note_id, label_x, label_y, x0, y0, w, h, area."""
    g = label_runs(runs.drop("h", "w")).groupBy("note_id", "label_x", "label_y")
    length = F.col("y1") - F.col("y0") + 1
    sizes = {"x0": F.min("x"), "top": F.min("y0"), "w": F.max("x") - F.min("x") + 1, "h": F.max("y1") - F.min("y0") + 1, "area": F.sum(length)}
    return g.agg(*[v.alias(k) for k, v in sizes.items()]).withColumnRenamed("top", "y0")


def components(mask: DataFrame, c: str) -> DataFrame:
    """Eight-connected components of set pixels: note_id, label_x, label_y, x0, y0, w, h, area."""
    return run_components(column_runs(mask, c))


def _thin(t: T.Tile, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Weak and strong edges of a tile: the gradient by absolute sum, where it is the largest across one of four directions."""
    v = t.values["gray"]
    gx, gy = _gradient(v, 1), _gradient(v, 0)
    m = np.where(t.inside[1:-1, 1:-1], np.abs(gx) + np.abs(gy), 0)
    near = lambda dy, dx: m[1 + dy : 1 + dy + t.rows, 1 + dx : 1 + dx + t.cols]
    here, gx, gy = near(0, 0), gx[1:-1, 1:-1], gy[1:-1, 1:-1]
    ax, ay = np.abs(gx), np.abs(gy)
    flat = (here > near(0, -1)) & (here >= near(0, 1))
    steep = (here > near(-1, 0)) & (here >= near(1, 0))
    slant = np.where(gx * gy >= 0, (here > near(-1, -1)) & (here > near(1, 1)), (here > near(-1, 1)) & (here > near(1, -1)))
    peak = np.where(ay < 0.4142 * ax, flat, np.where(ay > 2.4142 * ax, steep, slant))
    return peak & (here > low), here > high


def edge_runs(gray: DataFrame, *, low: int = 80, high: int = 200) -> DataFrame:
    """Runs of edge pixels down the columns (note_id, x, y0, y1, h, w and labels): thin edges of strong gradient, and weak ones connected to them.

    A weak edge stays if its component, of any length, has a strong pixel. Pixels are dealt to
    tiles once and runs to images once.
    """

    def runs(t: T.Tile) -> dict[str, np.ndarray]:
        weak, strong = _thin(t, low, high)
        x, y0, y1, s = T.column_runs(weak, t, strong.astype(int))
        return {"x": x, "y0": y0, "y1": y1, "h": np.full(len(x), t.h), "w": np.full(len(x), t.w), "strong": s}

    found = T.on_tiles(T.cut(gray, ("gray",), (2, 2)), runs, "x int, y0 int, y1 int, h int, w int, strong int", (2, 2))
    return label_runs(found, "strong")


def edges(gray: DataFrame, *, low: int = 80, high: int = 200) -> DataFrame:
    """The pixels of ``edge_runs``: note_id, y, x, w, h, edge = 1."""
    return edge_runs(gray, low=low, high=high).select("note_id", F.explode(F.sequence("y0", "y1")).alias("y"), "x", "w", "h", F.lit(1).alias("edge"))


def edge_ratio(runs: DataFrame, notes: DataFrame) -> DataFrame:
    """Share of the pixels of edge runs in each note (note_id, w, h); 0 without any."""
    n = runs.groupBy("note_id").agg(F.sum(F.col("y1") - F.col("y0") + 1).alias("_n"))
    return notes.join(n, "note_id", "left").select("note_id", (F.coalesce("_n", F.lit(0)) / (F.col("w") * F.col("h"))).alias("edge_ratio"))


def motion_blur(pixels: DataFrame, *, taps: int = 9) -> DataFrame:
    """Mean along the row; fewer taps at the border."""
    frame = along_row().rowsBetween(-(taps // 2), taps // 2)
    return pixels.withColumns({c: F.floor(F.avg(c).over(frame) + 0.5).cast("int") for c in "bgr"})


def line_runs(runs: DataFrame, *, share: float = 0.4, gap: int = 15) -> DataFrame:
    """``vertical_lines`` of runs down the columns, of the image height h: no row is made for a pixel."""
    before = F.max("y1").over(down_run().rowsBetween(Window.unboundedPreceding, -1))
    s = runs.withColumn("_new", F.when(F.col("y0") - before > gap, 1).otherwise(0))
    s = s.withColumn("island", F.sum("_new").over(down_run().rowsBetween(Window.unboundedPreceding, 0)))
    seg = s.groupBy("note_id", "x", "island").agg(F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.first("h").alias("_h"))
    return seg.where(F.col("y1") - F.col("y0") + 1 >= share * F.col("_h")).select("note_id", "x", "y0", "y1")


def vertical_lines(mask: DataFrame, c: str, height: str, *, share: float = 0.4, gap: int = 15) -> DataFrame:
    """Vertical segments of a mask: islands of set pixels in a column with gaps up to ``gap``, ``share`` of the height or longer."""
    s = mask.where(F.col(c) > 0).withColumn("_new", F.when(F.col("y") - F.lag("y").over(down_column()) > gap, 1).otherwise(0))
    s = s.withColumn("island", F.sum("_new").over(down_column().rowsBetween(Window.unboundedPreceding, 0)))
    seg = s.groupBy("note_id", "x", "island").agg(F.min("y").alias("y0"), F.max("y").alias("y1"), F.first(height).alias("_h"))
    return seg.where(F.col("y1") - F.col("y0") + 1 >= share * F.col("_h")).select("note_id", "x", "y0", "y1")
