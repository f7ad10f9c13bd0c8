"""Stencils on tiles against the whole image at once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from guilloche.operators import checks, pixels, stencil, tiles

H, W = 301, 270


@pytest.fixture(scope="module")
def image():
    """Lines and blots that cross the borders of tiles, and noise."""
    r = np.random.default_rng(8)
    v = r.integers(0, 40, (H, W))
    v[:, 120:131] += 150
    v[20:280, 60] += 200
    v[100:160, 90:200] += 90
    for k in range(200):
        v[40 + k, 50 + k] = 255
    return np.minimum(v, 255)


@pytest.fixture(scope="module")
def table(spark, image):
    """Two images: the one above and one of 5 rows and a single column; a clashing column besides."""
    rows = [(1, y, x, H, W, int(image[y, x]), 7) for y in range(H) for x in range(W)] + [(2, y, 0, 5, 1, 40 * y, 7) for y in range(5)]
    return spark.createDataFrame(rows, "note_id int, y int, x int, h int, w int, gray int, ty int").repartition(5).cache()


def whole(v, ry, rx):
    h, w = v.shape
    y, x = tiles.mirrored(np.arange(-ry, h + ry), h), tiles.mirrored(np.arange(-rx, w + rx), w)
    return tiles.Tile(0, 0, h, w, h, w, ry, rx, {"gray": v[np.ix_(y, x)]})


def dense(df, c, note=1, shape=(H, W)):
    out = np.full(shape, -1)
    for r in df.where(F.col("note_id") == note).select("y", "x", c).collect():
        assert out[r.y, r.x] == -1
        out[r.y, r.x] = r[c]
    return out


def test_gradients_and_blur_know_no_tiles(table, image):
    padded = np.pad(image, 1, mode="reflect")
    d = padded[:, 2:] - padded[:, :-2]
    gx = d[:-2] + 2 * d[1:-1] + d[2:]
    assert (dense(stencil.sobel_x(table, "gray"), "gx") == gx).all()
    e = padded[2:] - padded[:-2]
    assert (dense(stencil.sobel_y(table, "gray"), "gy") == e[:, :-2] + 2 * e[:, 1:-1] + e[:, 2:]).all()
    kernel = np.array(stencil.gaussian_kernel(21))
    wide = np.pad(image, 10, mode="reflect").astype(float)
    along = sum(k * wide[:, i : i + W] for i, k in enumerate(kernel))
    blurred = np.floor(np.round(sum(k * along[i : i + H] for i, k in enumerate(kernel)), 6) + 0.5)
    got = stencil.blur(table, "gray")
    assert (dense(got, "gray") == blurred).all()
    line = np.pad(np.arange(5) * 40.0, (4, 4), mode="reflect")  # as far as one reflection goes
    narrow = dense(stencil.blur(table.where("note_id = 2"), "gray", size=9), "gray", 2, (5, 1))
    assert (narrow[:, 0] == np.floor(np.round([line[i : i + 9] @ stencil.gaussian_kernel(9) for i in range(5)], 6) + 0.5)).all()


def test_edges_are_those_of_the_whole_image(table, image):
    weak, strong = stencil._thin(whole(image, 2, 2), 80, 200)
    x, y0, y1, s = tiles.column_runs(weak, whole(image, 0, 0), strong.astype(int))
    label = stencil.run_labels(x, y0, y1)
    kept = np.isin(label, label[s > 0])
    assert 0 < kept.sum() < len(kept) and ((y0 < 128) & (y1 >= 128) & kept).any()
    got = stencil.edge_runs(table, low=80, high=200).where("note_id = 1").select("x", "y0", "y1", "label_x", "label_y").collect()
    assert sorted(map(tuple, got)) == sorted(zip(*(v[kept].tolist() for v in (x, y0, y1, x[label], y0[label]))))


def test_frames_down_columns_reach_across_tiles(table, image):
    mask = table.where("note_id = 1").withColumn("m", (F.col("gray") > 60).cast("int"))
    got = dense(stencil.filter_down(mask, "m", *stencil.closing(15), *stencil.opening(20)), "m")
    want = (image > 60).astype(int)
    for pick, k in ((max, 15), (min, 15), (min, 20), (max, 20)):
        want = np.array([[pick(want[max(0, y - k // 2) : y + k - k // 2, x]) for x in range(W)] for y in range(H)])
    assert (got == want).all()
    runs = {(r.x, r.y0, r.y1) for r in stencil.column_runs(mask, "m").collect()}
    x, a, b = tiles.column_runs(image > 60, whole(image, 0, 0))
    assert runs == set(zip(x.tolist(), a.tolist(), b.tolist()))
    assert stencil.column_runs(mask.limit(0), "m").count() == 0


def test_tiles_of_any_side_and_their_bounds(table, image):
    count = lambda side, reach: tiles.on_tiles(tiles.cut(table, ("gray",), reach, side=side), lambda t: {"n": [t.values["gray"].sum()], "rows": [t.rows]}, "n int, rows int", reach, side=side).where("note_id = 1")
    for side in (16, 100, 512):
        rows = count(side, (0, 0)).collect()
        assert len(rows) == -(-H // side) * -(-W // side) and sum(r.n for r in rows) == image.sum() and max(r.rows for r in rows) <= side
    with pytest.raises(ValueError):
        tiles.cut(table, ("gray",), (17, 0), side=16)
    assert tiles.cut(table.limit(0), ("gray",), (1, 1)).count() == 0


def test_pixels_are_dealt_out_once(spark, table, data):
    """Exchanges of pixels, tiles and runs in the plans of the structural and thread checks; those of a few numbers for each note come on top."""
    shot = table.withColumns({c: F.col("gray") for c in "bgr"}).select("note_id", "y", "x", "h", "w", "b", "g", "r")
    gray = pixels.to_gray(shot)

    def exchanges(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and "Reused" not in line]

    assert len(exchanges(stencil.edge_runs(gray))) == 2
    assert len(exchanges(stencil.edge_strength(gray, "gray"))) == len(exchanges(stencil.blur(gray, "gray"))) == 1
    assert checks.structural_signals(shot).count() == 2
    assert [r.n for r in checks.thread_components(shot).groupBy("note_id").agg(F.count("*").alias("n")).collect()]
