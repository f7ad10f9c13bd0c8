"""Rectification of quads that are no parallelograms."""

import numpy as np

from guilloche.operators import geometry

W, H = 120, 50


def test_any_quad_comes_out_flat_within_a_grey_level(spark):
    """A pattern drawn into a quad of a frame, by a map of its own, and read back."""
    pattern = lambda u, v: 40 + 100 * u + 60 * v + 30 * np.sin(3 * u + 2 * v)
    quads = {1: [(12, 9), (150, 20), (141, 92), (25, 80)], 2: [(10, 10), (129, 10), (129, 59), (10, 59)], 3: [(90, 8), (95, 130), (30, 125), (22, 12)]}
    rows, outlines = [], []
    for note, quad in quads.items():
        unit, a, b = [(0, 0), (1, 0), (1, 1), (0, 1)], [], []
        for (u, v), (x, y) in zip(unit, quad):  # from the frame to the unit square, as eight equations
            a += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            b += [u, v]
        m = np.append(np.linalg.solve(np.array(a, float), b), 1).reshape(3, 3)
        y, x = np.mgrid[0:140, 0:160]
        p = np.einsum("ij,jyx->iyx", m, np.stack([x, y, np.ones_like(x)]))
        gray = np.floor(pattern(p[0] / p[2], p[1] / p[2]) + 0.5)
        rows += [(note, int(j), int(i), 160, 140, *[int(gray[j, i])] * 3) for j in range(140) for i in range(160)]
        side = (float(H), float(W)) if note == 3 else (float(W), float(H))
        tl, tr, br, bl = (quad[1:] + quad[:1]) if note == 3 else quad  # a tall note: its lower left is the target's origin
        outlines.append((note, *map(float, (*tl, *tr, *br, *bl)), *side))
    outlines.append((4, *[5.0] * 8, float(W), float(H)))  # no quad at all
    rows += [(n, 0, 0, 1, 1, 9, 9, 9) for n in (4, 5)]
    pixels = spark.createDataFrame(rows, "note_id int, y int, x int, w int, h int, b int, g int, r int")
    names = ", ".join(f"{c}_{a} double" for c in ("tl", "tr", "br", "bl") for a in "xy")
    found = geometry.rectify_perspective(pixels, spark.createDataFrame(outlines, f"note_id int, {names}, avg_w double, avg_h double"), min_w=50, min_h=40).collect()
    assert [tuple(r) for r in found if r.note_id > 3] == [(5, 0, 0, 1, 1, 9, 9, 9)]
    for note in quads:
        got = {(r.y, r.x): r for r in found if r.note_id == note}
        assert len(got) == W * H and {(r.w, r.h) for r in got.values()} == {(W, H)}
        j, i = np.mgrid[0:H, 0:W]
        want = pattern(i / (W - 1), j / (H - 1))
        assert max(abs(r.g - want[k]) for k, r in got.items()) <= 1.01 and all(r.b == r.g == r.r for r in got.values())
