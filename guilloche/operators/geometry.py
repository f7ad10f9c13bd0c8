"""Note outline and proportions.

Contours have note_id, contour_id, n_vertices, the image size, four corners x0..y3 and maybe
the area of their border; ``outline.outlines`` finds them in pixels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guilloche.schemas import dimensions

from . import tiles as T

#: Rows and columns of a block of targets.
BLOCK = 64


def with_area(contours: DataFrame) -> DataFrame:
    """Add ``area``, unless the contours bring that of their whole border: the shoelace area of the four corners."""
    if "area" in contours.columns:
        return contours
    x, y = [F.col(f"x{k}") for k in range(4)], [F.col(f"y{k}") for k in range(4)]
    twice = sum((x[k] * y[(k + 1) % 4] - x[(k + 1) % 4] * y[k] for k in range(1, 4)), x[0] * y[1] - x[1] * y[0])
    return contours.withColumn("area", F.abs(twice) / 2)


def gate(contours: DataFrame, *, top: int = 6, low: float = 0.15, high: float = 0.97, min_image: int = 10_000) -> DataFrame:
    """Of the ``top`` largest contours of a note those of four corners and plausible area, with their rank."""
    rank = F.row_number().over(Window.partitionBy("note_id").orderBy(F.desc("area"), "contour_id"))
    image = F.col("img_w") * F.col("img_h")
    ranked = with_area(contours).where(image >= min_image).withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.where((F.col("area") >= low * image) & (F.col("area") <= high * image) & (F.col("n_vertices") == 4))


def ordered(quads: DataFrame) -> DataFrame:
    """Corners by place: top left and bottom right by x + y, top right and bottom left by x - y; the first wins ties."""
    points = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y")) for k in range(4)])
    p = quads.select("*", F.explode(points).alias("p"))
    keys = [c for c in quads.columns if c[0] not in "xy" or not c[1:].isdigit()]
    pick = lambda by: F.min_by(F.struct("p.x", "p.y"), F.struct(by, F.col("p.k")))
    s, d = F.col("p.x") + F.col("p.y"), F.col("p.x") - F.col("p.y")
    g = p.groupBy(*keys).agg(pick(s).alias("tl"), pick(-d).alias("tr"), pick(-s).alias("br"), pick(d).alias("bl"))
    return g.select(*keys, *[F.col(f"{c}.{a}").alias(f"{c}_{a}") for c in ("tl", "tr", "br", "bl") for a in "xy"])


def _edge(a: str, b: str) -> Column:
    return F.sqrt(F.pow(F.col(f"{a}_x") - F.col(f"{b}_x"), 2) + F.pow(F.col(f"{a}_y") - F.col(f"{b}_y"), 2))


def measured(quads: DataFrame, *, low: float = 1.6, high: float = 3.2) -> DataFrame:
    """Average sides and aspect of ordered quads; those of an aspect that no note has go."""
    sides = quads.withColumns({"avg_w": (_edge("tr", "tl") + _edge("br", "bl")) / 2, "avg_h": (_edge("bl", "tl") + _edge("br", "tr")) / 2})
    longer, shorter = F.greatest("avg_w", "avg_h"), F.least("avg_w", "avg_h")
    return sides.where(shorter >= 1).withColumn("aspect", longer / shorter).where(F.col("aspect").between(low, high))


def first_quad(contours: DataFrame) -> DataFrame:
    """The plausible quad of the largest area of each note."""
    m = measured(ordered(gate(contours)))
    return m.withColumn("_k", F.row_number().over(Window.partitionBy("note_id").orderBy("rank"))).where("_k = 1").drop("_k")


def blocks(tw: int, th: int, place: Callable, t: T.Tile) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Target columns and rows of the blocks that may lie in a tile: a block lies between the places of its corners, if all are in front."""
    i0, j0 = (v.ravel() for v in np.meshgrid(np.arange(0, tw, BLOCK), np.arange(0, th, BLOCK)))
    i1, j1 = np.minimum(i0 + BLOCK, tw), np.minimum(j0 + BLOCK, th)
    x, y, front = place(np.stack([i0, i1 - 1, i0, i1 - 1]), np.stack([j0, j0, j1 - 1, j1 - 1]))
    near = lambda v, a, n: (v.max(axis=0) >= a - 2) & (v.min(axis=0) <= a + n + 2)
    for k in np.flatnonzero(~front.all(axis=0) | (near(x, t.x0, t.cols) & near(y, t.y0, t.rows))):
        yield tuple(v.ravel() for v in np.meshgrid(np.arange(i0[k], i1[k]), np.arange(j0[k], j1[k])))


def _gathered(pixels: DataFrame, maps: DataFrame, names: tuple[str, ...], place: Callable, *, blend: bool) -> DataFrame:
    """Target pixels of the notes that have a map (note_id, tw, th and ``names``), each made in the tile that holds its source.

    ``place`` gives the source places of target columns and rows, and which of them are in front;
    with ``blend`` the four pixels around a place are weighted, else the nearest one counts.
    Pixels are dealt to tiles once, and no row is made for a target before it has its value.
    """
    reach = 1 if blend else 0

    def warp(t: T.Tile, tw: int, th: int, *values: float) -> dict[str, np.ndarray]:
        at = lambda i, j: place(dict(zip(names, values)), tw, th, i, j)
        found = [[np.empty(0, int)] * 5]
        for i, j in blocks(tw, th, at, t):
            x, y, front = at(i, j)
            with np.errstate(invalid="ignore"):
                own = front & (x >= -1) & (x < t.w) & (y >= -1) & (y < t.h)
            i, j, x, y = i[own], j[own], x[own], y[own]
            bx, by = np.floor(x).astype(int), np.floor(y).astype(int)
            cx, cy = np.clip(bx, 0, t.w - 1) - t.x0, np.clip(by, 0, t.h - 1) - t.y0
            own = (cx >= 0) & (cx < t.cols) & (cy >= 0) & (cy < t.rows)
            i, j, x, y, bx, by = (v[own] for v in (i, j, x, y, bx, by))
            weight, sums = np.zeros(len(i)), np.zeros((3, len(i)))
            for a in range(reach + 1):
                for b in range(reach + 1):
                    nx, ny = bx + a, by + b
                    k = (x - bx if a else 1 - (x - bx)) * (y - by if b else 1 - (y - by)) if blend else np.ones(len(i))
                    k = np.where((nx >= 0) & (nx < t.w) & (ny >= 0) & (ny < t.h), k, 0.0)
                    here = np.clip(ny - t.y0 + reach, 0, t.rows + 2 * reach - 1), np.clip(nx - t.x0 + reach, 0, t.cols + 2 * reach - 1)
                    k = k * t.values["_there"][here]
                    weight += k
                    sums += k * np.stack([t.values[c][here] for c in "bgr"])
            has = weight > 0
            found.append([i[has], j[has], *np.floor(np.round(sums[:, has] / weight[has], 6) + 0.5)])
        i, j, b, g, r = (np.concatenate(v) for v in zip(*found))
        return {"y": j, "x": i, "w": np.full(len(i), tw), "h": np.full(len(i), th), "b": b, "g": g, "r": r}

    of_maps = pixels.join(maps.select("note_id"), "note_id", "left_semi").withColumn("_there", F.lit(1))
    tiles = T.cut(of_maps, ("b", "g", "r", "_there"), (reach, reach)).join(maps, "note_id")
    return T.on_tiles(tiles, warp, "y int, x int, w int, h int, b int, g int, r int", (reach, reach), more=("tw", "th", *names))


def rectify(pixels: DataFrame, quads: DataFrame, *, min_w: int = 200, min_h: int = 80) -> DataFrame:
    """Pixels in the quad's own landscape frame; notes without a quad, or with too small a one, unchanged.

    Affine from three corners, exact for parallelograms: each target pixel takes the nearest
    source pixel.
    """
    q = quads.select("note_id", "tl_x", "tl_y", "tr_x", "tr_y", "bl_x", "bl_y", "br_x", "br_y", "avg_w", "avg_h", F.greatest("avg_w", "avg_h").cast("int").alias("tw"), (F.greatest("avg_w", "avg_h") / (F.greatest("avg_w", "avg_h") / F.least("avg_w", "avg_h"))).cast("int").alias("th")).where((F.col("tw") >= min_w) & (F.col("th") >= min_h))
    tall = F.col("avg_h") > F.col("avg_w")
    corner = lambda a, b: [F.when(tall, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).cast("double") for c in "xy"]
    (ox, oy), (rx, ry), (dx, dy) = corner("bl", "tl"), corner("tl", "tr"), corner("br", "bl")
    maps = q.select("note_id", "tw", "th", ox.alias("ox"), oy.alias("oy"), ((rx - ox) / (F.col("tw") - 1)).alias("ux"), ((ry - oy) / (F.col("tw") - 1)).alias("uy"), ((dx - ox) / (F.col("th") - 1)).alias("vx"), ((dy - oy) / (F.col("th") - 1)).alias("vy"))

    def place(m, tw, th, i, j):
        x, y = (np.floor(m[f"o{c}"] + i * m[f"u{c}"] + j * m[f"v{c}"] + 0.5) for c in "xy")
        return x, y, (x >= 0) & (y >= 0)

    warped = _gathered(pixels, maps.dropna(), ("ox", "oy", "ux", "uy", "vx", "vy"), place, blend=False)
    same = pixels.join(q.select("note_id"), "note_id", "left_anti").select("note_id", "y", "x", "w", "h", "b", "g", "r")
    return warped.unionByName(same)


def _projective(q: DataFrame) -> DataFrame:
    """Add the map from the unit square to a quad ``x0, y0 ... x3, y3`` (in order around it), in closed form: coefficients ax to cx, ay to cy, and g, h of the common denominator."""
    d = {f"d{k}{c}": F.col(f"{c}{k}") - F.col(f"{c}2") for k, c in (("1", "x"), ("1", "y"))} | {f"d3{c}": F.col(f"{c}3") - F.col(f"{c}2") for c in "xy"}
    d |= {f"s{c}": F.col(f"{c}0") - F.col(f"{c}1") + F.col(f"{c}2") - F.col(f"{c}3") for c in "xy"}  # 0 of a parallelogram
    q = q.withColumns(d).withColumn("_n", F.col("d1x") * F.col("d3y") - F.col("d3x") * F.col("d1y")).where("_n != 0")
    q = q.withColumns({"pg": (F.col("sx") * F.col("d3y") - F.col("d3x") * F.col("sy")) / F.col("_n"), "ph": (F.col("d1x") * F.col("sy") - F.col("sx") * F.col("d1y")) / F.col("_n")})
    return q.withColumns({k: v for c in "xy" for k, v in ((f"a{c}", F.col(f"{c}1") - F.col(f"{c}0") + F.col("pg") * F.col(f"{c}1")), (f"b{c}", F.col(f"{c}3") - F.col(f"{c}0") + F.col("ph") * F.col(f"{c}3")), (f"c{c}", F.col(f"{c}0")))})


def rectify_perspective(pixels: DataFrame, quads: DataFrame, *, min_w: int = 200, min_h: int = 80) -> DataFrame:
    """``rectify`` for any convex quad: a projective map, and the four source pixels around each place weighted by their distance.

    Neighbours outside the frame do not count, and a target pixel without any is left out, as
    it is for a quad whose corners lie on a line.
    """
    q = quads.withColumns({"tw": F.greatest("avg_w", "avg_h").cast("int"), "th": F.least("avg_w", "avg_h").cast("int")}).where((F.col("tw") >= min_w) & (F.col("th") >= min_h))
    tall = F.col("avg_h") > F.col("avg_w")
    around = (("bl", "tl"), ("tl", "tr"), ("tr", "br"), ("br", "bl"))
    q = q.select("note_id", "tw", "th", *[F.when(tall, F.col(f"{a}_{c}")).otherwise(F.col(f"{b}_{c}")).cast("double").alias(f"{c}{k}") for k, (a, b) in enumerate(around) for c in "xy"])
    same = pixels.join(q.select("note_id"), "note_id", "left_anti").select("note_id", "y", "x", "w", "h", "b", "g", "r")
    names = (*[f"{k}{c}" for c in "xy" for k in "abc"], "pg", "ph")

    def place(m, tw, th, i, j):
        u, v = i / float(max(tw - 1, 1)), j / float(max(th - 1, 1))
        z = m["pg"] * u + m["ph"] * v + 1
        with np.errstate(divide="ignore", invalid="ignore"):
            x, y = (np.round((m[f"a{c}"] * u + m[f"b{c}"] * v + m[f"c{c}"]) / z, 6) for c in "xy")
        return x, y, z > 0

    maps = _projective(q).select("note_id", "tw", "th", *names).dropna()
    return _gathered(pixels, maps, names, place, blend=True).unionByName(same)


def aspects(frames: DataFrame, quads: DataFrame) -> DataFrame:
    """Aspect of each note: of its quad, else of its frame if the borders are uniform and both sides 50 or more.

    ``frames``: note_id, img_w, img_h, uniform.
    """
    j = frames.join(quads.select("note_id", F.col("aspect").alias("quad_aspect")), "note_id", "left")
    frame = F.col("uniform") & (F.least("img_w", "img_h") >= 50)
    return j.select("note_id", F.coalesce("quad_aspect", F.when(frame, F.greatest("img_w", "img_h") / F.greatest(F.least("img_w", "img_h"), F.lit(1)))).alias("aspect"), F.when(F.col("quad_aspect").isNotNull(), "quad").when(frame, "frame").alias("measurement"))


def proportions(notes: DataFrame, measured_aspects: DataFrame, *, tolerance: float = 15.0) -> DataFrame:
    """Proportion check of notes (note_id, denom): deviation from the denomination's size."""
    dim = F.broadcast(dimensions(notes.sparkSession).select("denom", "expected_aspect"))
    j = notes.select("note_id", "denom").join(measured_aspects, "note_id", "left").join(dim, "denom", "left")
    deviation = F.abs(F.col("aspect") - F.col("expected_aspect")) / F.col("expected_aspect") * 100
    known = F.col("expected_aspect").isNotNull() & F.col("aspect").isNotNull()
    only = lambda c: F.when(known, c)
    return j.select("note_id", F.lit("proportion_analysis").alias("check_name"), F.when(~known, "INFO").when(deviation <= tolerance, "PASS").otherwise("FAIL").alias("status"), only(F.bround("aspect", 3)).alias("actual_aspect"), only(F.bround("expected_aspect", 3)).alias("expected_aspect"), only(F.bround(deviation, 1)).alias("deviation_pct"), only(F.col("measurement")).alias("measurement"))


def deviation_band(checks: DataFrame) -> DataFrame:
    """Colour of a deviation: up to 5 per cent green, up to 15 yellow, else red; grey if there is none."""
    d = F.col("deviation_pct")
    return checks.withColumn("band", F.when(d.isNull(), "gray").when(d <= 5, "green").when(d <= 15, "yellow").otherwise("red"))
