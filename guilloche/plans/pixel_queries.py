"""Queries and oracle SQL of pixels, stencils, checks and negative controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from guilloche.operators import checks as C
from guilloche.operators import controls as N
from guilloche.operators import denomination as D
from guilloche.operators import geometry as G
from guilloche.operators import outline as O
from guilloche.operators import pixels as P
from guilloche.operators import stencil as S
from guilloche.schemas import CHECKS, DIMENSIONS_MM, values_sql

from . import shape_queries as SQ
from . import token_queries as TQ
from .fixtures import load, oracle

_QUAD = {"tl_x": 10, "tl_y": 5, "tr_x": 129, "tr_y": 5, "br_x": 131, "br_y": 58, "bl_x": 12, "bl_y": 58}


def _px(spark, d):
    return load(spark, d, "fx_pixels")


def _hist(spark, d):
    return P.hsv_histogram(_px(spark, d))


def _hsv(spark, d):
    return P.hsv_pixels(_px(spark, d))


def _rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _images(spark, d):
    return _px(spark, d).select("note_id", F.col("w").alias("img_w"), F.col("h").alias("img_h")).distinct()


def _gray_panel(spark, d):
    return P.to_gray(P.crop(_px(spark, d), "watermark"))


def _sobel(spark, d):
    return S.edge_strength(P.to_gray(P.crop(_px(spark, d), "thread")), "gray")


def _mask(spark, d):
    s = _sobel(spark, d)
    return s.join(P.otsu(s, "sobel"), "note_id").withColumn("m", (F.col("sobel") > F.col("threshold")).cast("int")).select("note_id", "y", "x", "h", "w", "m")


def _edges(spark, d):
    return S.edges(P.to_gray(_px(spark, d)))


def _lines(spark, d):
    return S.line_runs(S.edge_runs(P.to_gray(P.crop(_px(spark, d), "thread_narrow")), low=60, high=180))


def p1(s, d):
    return P.to_gray(_px(s, d)).select("note_id", "y", "x", "gray")


def p2(s, d):
    return P.to_hsv(_px(s, d)).select("note_id", "y", "x", "h", "s", "v")


def p3(s, d):
    return P.region_pixels(_px(s, d)).groupBy("note_id", "region").agg(F.count("*").alias("n"), F.sum("g").alias("g"))


def p4(s, d):
    return P.in_range(P.to_hsv(_px(s, d))).where("mask").select("note_id", "y", "x")


def p5(s, d):
    return P.to_landscape(_px(s, d).select("note_id", F.col("x").alias("y"), F.col("y").alias("x"), F.col("h").alias("w"), F.col("w").alias("h"), "b", "g", "r"))


def p6(s, d):
    return _px(s, d).select("note_id", P.border_count().alias("bands")).groupBy("note_id", "bands").agg(F.count("*").alias("n"))


def p7(s, d):
    return _px(s, d).groupBy("note_id", P.quadrant().alias("q")).agg(F.count("*").alias("n"), F.sum("r").alias("r"))


def p8(s, d):
    return _rounded(P.block_means(_px(s, d)), "b", "g", "r")


def a0(s, d):
    return _hist(s, d)


def a1(s, d):
    return _rounded(P.saturated_ratio(_hsv(s, d)), "uv_ratio")


def a2(s, d):
    return _rounded(P.mean_saturation(_hsv(s, d)), "mean_sat")


def a3(s, d):
    return _rounded(P.hue_histogram(_hist(s, d)), "p")


def a4(s, d):
    return _rounded(P.hue_entropy(_hist(s, d), min_coloured=200), "entropy")


def a5(s, d):
    return P.masked_medians(_hist(s, d))


def a6(s, d):
    return _rounded(P.brightness_std(_px(s, d)), "brightness_std")


def a7(s, d):
    return P.dark_quadrants(_px(s, d))


def a8(s, d):
    return _rounded(P.border_interior_std(_px(s, d)), "border_std", "interior_std", digits=4)


def a9(s, d):
    return _rounded(C.watermark_variance(_px(s, d)), "variance", digits=4)


def a10(s, d):
    return _rounded(S.edge_ratio(S.edge_runs(P.to_gray(_px(s, d))), _px(s, d).select("note_id", "w", "h").distinct()), "edge_ratio")


def a11(s, d):
    return P.otsu(_sobel(s, d), "sobel")


def a12(s, d):
    return _rounded(P.coloured_share(_hsv(s, d)), "coloured_share")


def a13(s, d):
    return _rounded(P.patch_score(_px(s, d)), "patch_score", digits=4)


def w1(s, d):
    return S.blur(_gray_panel(s, d), "gray")


def y0(s, d):
    """What is dark for its surroundings in the watermark panel, as digits are looked for in a strip."""
    return O.local_threshold(_gray_panel(s, d)).select("note_id", "y", "x", "dark")


def w2(s, d):
    return _sobel(s, d).select("note_id", "y", "x", "sobel")


def w3(s, d):
    return S.close_down(_mask(s, d), "m", 15).select("note_id", "y", "x", "m")


def w4(s, d):
    return S.filter_down(_mask(s, d), "m", *S.closing(15), *S.opening(20)).select("note_id", "y", "x", "m")


def w5(s, d):
    return C.thread_components(_px(s, d)).drop("img_h")


def w6(s, d):
    return _edges(s, d).select("note_id", "y", "x")


def w7(s, d):
    return S.motion_blur(_px(s, d)).select("note_id", "y", "x", "b", "g", "r")


def w8(s, d):
    return _lines(s, d)


def c1(s, d):
    return C.structural_sanity(C.structural_signals(_px(s, d)))


def c2(s, d):
    return C.uv_features(_hsv(s, d))


def c3(s, d):
    return C.watermark(_images(s, d), C.watermark_variance(_px(s, d)))


def c4(s, d):
    return C.security_thread(_images(s, d), C.threads(C.thread_components(_px(s, d))))


def c5(s, d):
    return C.palette_integrity(_hist(s, d))


def c9(s, d):
    """Proportions of notes whose denomination was read: the read value decides the expected size."""
    notes = load(s, d, "fx_notes")
    read = D.classify(notes, load(s, d, "fx_tokens"), load(s, d, "fx_palette_stats")).select("note_id", F.col("value").alias("denom"))
    return G.proportions(read, G.first_quad(load(s, d, "fx_contours")).select("note_id", "aspect", F.lit("quad").alias("measurement")))


def c10(s, d):
    return C.portrait(load(s, d, "fx_notes"), load(s, d, "fx_faces"))


def c11_wide(s, d):
    return C.wide(load(s, d, "fx_checks"))


def g5_perspective(s, d):
    """Quads that are no parallelograms, another one for each note."""
    n = F.pmod("note_id", F.lit(7))
    corners = {"tl_x": 10 + n, "tl_y": 5, "tr_x": 129, "tr_y": 4 + n, "br_x": 131 - n, "br_y": 60, "bl_x": 12, "bl_y": 58 - n}
    q = _images(s, d).select("note_id", *[(v if not isinstance(v, int) else F.lit(v)).cast("double").alias(k) for k, v in corners.items()], F.lit(119.0).alias("avg_w"), F.lit(53.0).alias("avg_h"))
    return G.rectify_perspective(_px(s, d), q, min_w=100, min_h=40)


def g5(s, d):
    q = _images(s, d).select("note_id", *[F.lit(float(v)).alias(k) for k, v in _QUAD.items()], F.lit(119.0).alias("avg_w"), F.lit(53.0).alias("avg_h"))
    return G.rectify(_px(s, d), q, min_w=100, min_h=40)


def g6(s, d):
    return P.borders_uniform(_px(s, d))


def e15(s, d):
    px = _px(s, d)
    lines = _lines(s, d).groupBy("note_id").agg(F.count("*").alias("lines"))
    j = C.watermark_variance(px).join(P.saturated_ratio(P.hsv_pixels(px)), "note_id").join(P.patch_score(px), "note_id").join(lines, "note_id", "left").withColumn("lines", F.coalesce("lines", F.lit(0)))
    return _rounded(_rounded(j, "variance", "patch_score", digits=4), "uv_ratio")


def n1(s, d):
    return N.blank(_px(s, d), 0).unionByName(N.blank(_px(s, d), 255)).groupBy("note_id", "b").agg(F.count("*").alias("n"))


def n2(s, d):
    return N.noise(_px(s, d))


def n3(s, d):
    return N.heavy_blur(_px(s, d), size=51)


def n4(s, d):
    return N.low_resolution(_px(s, d), width=20)


def n5(s, d):
    return N.half_crop(_px(s, d))


def n6(s, d):
    return N.invert(_px(s, d))


def n7(s, d):
    return N.desaturate(_px(s, d))


def n8(s, d):
    return N.hue_shift(_px(s, d))


def n9(s, d):
    return N.stretch(_px(s, d))


def n10(s, d):
    return N.motion_blur(_px(s, d))


QUERIES = {
    "p1_gray": p1, "p2_hsv": p2, "p3_regions": p3, "p4_in_range": p4, "p5_landscape": p5, "p6_border_bands": p6, "p7_quadrants": p7, "p8_block_means": p8,
    "a0_hsv_histogram": a0, "a1_saturated_ratio": a1, "a2_mean_saturation": a2, "a3_hue_histogram": a3, "a4_hue_entropy": a4, "a5_masked_medians": a5, "a6_brightness_std": a6, "a7_dark_quadrants": a7, "a8_border_interior_std": a8,
    "a9_watermark_variance": a9, "a10_edge_ratio": a10, "a11_otsu": a11, "a12_coloured_share": a12, "a13_patch_score": a13,
    "y0_local_threshold": y0,
    "w1_gaussian_blur": w1, "w2_sobel": w2, "w3_vertical_close": w3, "w4_vertical_open": w4, "w5_components": w5, "w6_edges": w6, "w7_motion_blur": w7, "w8_vertical_lines": w8,
    "c1_structural_sanity": c1, "c2_uv_features": c2, "c3_watermark": c3, "c4_security_thread": c4, "c5_palette_integrity": c5, "c9_read_proportions": c9, "c10_portrait": c10, "c11_wide_checks": c11_wide,
    "g5_rectify": g5, "g5_perspective": g5_perspective, "g6_borders_uniform": g6, "e15_raw_signals": e15,
    "n1_blank": n1, "n2_noise": n2, "n3_heavy_blur": n3, "n4_low_resolution": n4, "n5_half_crop": n5, "n6_invert": n6, "n7_desaturate": n7, "n8_hue_shift": n8, "n9_stretch": n9, "n10_motion_blur": n10,
}


def _region(name: str) -> str:
    y0, y1, x0, x1 = P.REGIONS[name]
    return f"y >= floor(64 * {y0}::DOUBLE) AND y < floor(64 * {y1}::DOUBLE) AND x >= floor(140 * {x0}::DOUBLE) AND x < floor(140 * {x1}::DOUBLE)"


def _reflect(i: str, n: int) -> str:
    m = f"(abs({i}) % {2 * (n - 1)})"
    return f"(CASE WHEN {m} < {n} THEN {m} ELSE {2 * (n - 1)} - {m} END)"


_GRAY = "CAST(floor(0.299::DOUBLE * r + 0.587::DOUBLE * g + 0.114::DOUBLE * b + 0.5) AS INT)"
_HUE_OF = "CAST(floor(CASE WHEN hue < 0 THEN hue + 180 ELSE hue END + 0.5) AS INT) % 180"
_SAT_OF = "CAST(CASE WHEN v = 0 THEN 0 ELSE floor(255::DOUBLE * d / v + 0.5) END AS INT)"
_PX = f"""
gr AS (SELECT *, {_GRAY} AS gray FROM fx_pixels),
hd AS (SELECT note_id, y, x, w, h AS ih, b, g, r, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM fx_pixels),
hh AS (SELECT *, CASE WHEN d = 0 THEN 0::DOUBLE WHEN v = r THEN 30::DOUBLE * (g - b) / d WHEN v = g THEN 60::DOUBLE + 30::DOUBLE * (b - r) / d ELSE 120::DOUBLE + 30::DOUBLE * (r - g) / d END AS hue FROM hd),
hsv AS (SELECT note_id, y, x, {_HUE_OF} AS h, {_SAT_OF} AS s, v FROM hh),
hist AS (SELECT note_id, h, s, v, count(*) AS n FROM hsv GROUP BY ALL),
a1 AS (SELECT note_id, count(*) FILTER (s >= 120 AND v >= 120) / count(*) AS uv_ratio FROM hsv GROUP BY note_id),
a3 AS (SELECT note_id, h, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY note_id) AS p FROM hsv WHERE s > 60 GROUP BY note_id, h),
a4 AS (SELECT note_id, CAST(sum(n) AS BIGINT) AS coloured, -sum(p * log2(p)) AS entropy FROM a3 GROUP BY note_id),
bd AS (SELECT *, (y < 3)::INT + (y >= 61)::INT + (x < 3)::INT + (x >= 137)::INT AS k FROM fx_pixels),
ch AS (SELECT note_id, k, unnest([b, g, r]) AS c FROM bd),
a8 AS (SELECT note_id, sqrt(greatest(0, sum(c * c * k) / sum(k) - pow(sum(c * k) / sum(k), 2))) AS border_std, stddev_pop(c) FILTER (k = 0) AS interior_std FROM ch GROUP BY note_id),
wp AS (SELECT note_id, y - 9 AS y, x, gray FROM gr WHERE {_region('watermark')}),
kn(d, c) AS ({values_sql((i - 10, repr(w) + '::DOUBLE') for i, w in enumerate(S.gaussian_kernel(21))).replace("'", '')}),
b1 AS (SELECT p.note_id, p.y, t.x, sum(kn.c * p.gray) AS f FROM (SELECT DISTINCT x FROM wp) t, kn JOIN wp p ON true WHERE p.x = {_reflect('t.x + kn.d', 35)} GROUP BY p.note_id, p.y, t.x),
b2 AS (SELECT p.note_id, t.y, p.x, CAST(floor(round(sum(kn.c * p.f), 6) + 0.5) AS INT) AS gray FROM (SELECT DISTINCT y FROM wp) t, kn JOIN b1 p ON true WHERE p.y = {_reflect('t.y + kn.d', 45)} GROUP BY p.note_id, t.y, p.x),
a9 AS (SELECT note_id, var_pop(gray) AS variance FROM b2 GROUP BY note_id),
a13 AS (SELECT note_id, 0.6 * stddev_pop(h) + 0.4 * stddev_pop(s) AS patch_score FROM hsv WHERE {_region('hologram')} GROUP BY note_id)
"""


def _windows() -> str:
    return "WINDOW al AS (PARTITION BY note_id, y ORDER BY x), dn AS (PARTITION BY note_id, x ORDER BY y)"


_THREAD = f"""
ts AS (SELECT note_id, y, x - 42 AS x, gray FROM gr WHERE {_region('thread')}),
t1 AS (SELECT *, coalesce(lead(gray) OVER al, lag(gray) OVER al, 0) - coalesce(lag(gray) OVER al, lead(gray) OVER al, 0) AS d FROM ts {_windows()}),
t2 AS (SELECT note_id, y, x, least(abs(coalesce(lag(d) OVER dn, lead(d) OVER dn, 0) + 2 * d + coalesce(lead(d) OVER dn, lag(d) OVER dn, 0)), 255) AS sobel FROM t1 {_windows()}),
o1 AS (SELECT note_id, sobel AS l, count(*) AS n FROM t2 GROUP BY ALL),
o2 AS (SELECT note_id, l, CAST(sum(n) OVER u AS DOUBLE) AS w0, CAST(sum(n * l) OVER u AS DOUBLE) AS s0, CAST(sum(n) OVER p AS DOUBLE) AS w, CAST(sum(n * l) OVER p AS DOUBLE) AS s FROM o1 WINDOW u AS (PARTITION BY note_id ORDER BY l ROWS UNBOUNDED PRECEDING), p AS (PARTITION BY note_id)),
o3 AS (SELECT note_id, l, round(CASE WHEN w > w0 THEN w0 * (w - w0) * pow(s0 / w0 - (s - s0) / (w - w0), 2) ELSE 0 END, 3) AS q FROM o2),
a11 AS (SELECT note_id, CAST(CASE WHEN max(q) > 0 THEN arg_max(l, (q, -l)) ELSE 0 END AS INT) AS threshold FROM o3 GROUP BY note_id),
m0 AS (SELECT note_id, y, x, CAST(sobel > threshold AS INT) AS m FROM t2 JOIN a11 USING (note_id)),
m1 AS (SELECT note_id, y, x, max(m) OVER (PARTITION BY note_id, x ORDER BY y ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM m0),
m2 AS (SELECT note_id, y, x, min(m) OVER (PARTITION BY note_id, x ORDER BY y ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING) AS m FROM m1),
m3 AS (SELECT note_id, y, x, min(m) OVER (PARTITION BY note_id, x ORDER BY y ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS m FROM m2),
m4 AS (SELECT note_id, y, x, max(m) OVER (PARTITION BY note_id, x ORDER BY y ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS m FROM m3),
r0 AS (SELECT note_id, x, y - row_number() OVER (PARTITION BY note_id, x ORDER BY y) AS i, y FROM m4 WHERE m > 0),
r1 AS (SELECT note_id, x, min(y) AS y0, max(y) AS y1, min(y) + 1000 * x AS id FROM r0 GROUP BY note_id, x, i),
rl AS (SELECT a.note_id, a.id AS p, b.id AS q FROM r1 a JOIN r1 b ON a.note_id = b.note_id AND a.x + 1 = b.x AND a.y0 <= b.y1 + 1 AND b.y0 <= a.y1 + 1),
rb AS (SELECT note_id, p, q FROM rl UNION SELECT note_id, q, p FROM rl),
rw AS (SELECT note_id, id AS p, id AS q FROM r1 UNION SELECT rw.note_id, rw.p, rb.q FROM rw JOIN rb ON rb.note_id = rw.note_id AND rb.p = rw.q),
rc AS (SELECT note_id, p AS id, min(q) AS label FROM rw GROUP BY note_id, p),
w5 AS (SELECT note_id, CAST(label // 1000 AS INT) AS label_x, CAST(label % 1000 AS INT) AS label_y, min(x) AS x0, min(y0) AS y0, max(x) - min(x) + 1 AS w, max(y1) - min(y0) + 1 AS h, CAST(sum(y1 - y0 + 1) AS BIGINT) AS area FROM r1 JOIN rc USING (note_id, id) GROUP BY note_id, label),
th AS (SELECT note_id, count(*) AS n, max((h, -label_x, w)) AS t, round(max(area / (w * h)), 6) AS density FROM w5 WHERE h >= 16 AND w <= 15 AND area >= w * h * 0.3 GROUP BY note_id)
"""


def _canny(source: str, low: int, high: int, tag: str) -> str:
    return f"""
{tag}a AS (SELECT *, coalesce(lead(gray) OVER al, lag(gray) OVER al, 0) - coalesce(lag(gray) OVER al, lead(gray) OVER al, 0) AS dx, coalesce(lead(gray) OVER dn, lag(gray) OVER dn, 0) - coalesce(lag(gray) OVER dn, lead(gray) OVER dn, 0) AS dy FROM {source} {_windows()}),
{tag}b AS (SELECT note_id, y, x, coalesce(lag(dx) OVER dn, lead(dx) OVER dn, 0) + 2 * dx + coalesce(lead(dx) OVER dn, lag(dx) OVER dn, 0) AS gx, coalesce(lag(dy) OVER al, lead(dy) OVER al, 0) + 2 * dy + coalesce(lead(dy) OVER al, lag(dy) OVER al, 0) AS gy FROM {tag}a {_windows()}),
{tag}c AS (SELECT *, abs(gx) + abs(gy) AS m FROM {tag}b),
{tag}d AS (SELECT *, coalesce(lag(m) OVER al, 0) AS l, coalesce(lead(m) OVER al, 0) AS r FROM {tag}c {_windows()}),
{tag}e AS (SELECT *, coalesce(lag(m) OVER dn, 0) AS u, coalesce(lead(m) OVER dn, 0) AS d, coalesce(lag(l) OVER dn, 0) AS ul, coalesce(lag(r) OVER dn, 0) AS ur, coalesce(lead(l) OVER dn, 0) AS dl, coalesce(lead(r) OVER dn, 0) AS dr FROM {tag}d {_windows()}),
{tag}f AS (SELECT note_id, y, x, m, CASE WHEN abs(gy) < 0.4142::DOUBLE * abs(gx) THEN m > l AND m >= r WHEN abs(gy) > 2.4142::DOUBLE * abs(gx) THEN m > u AND m >= d WHEN gx * gy >= 0 THEN m > ul AND m > dr ELSE m > ur AND m > dl END AS peak FROM {tag}e),
{tag}g AS (SELECT note_id, y, x, (peak AND m > {low})::INT AS weak, (peak AND m > {high})::INT AS edge FROM {tag}f),
{tag}r AS (SELECT note_id, y, x FROM {tag}g WHERE edge = 1 UNION SELECT w.note_id, w.y, w.x FROM {tag}r r, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx), {tag}g w WHERE w.weak = 1 AND w.note_id = r.note_id AND w.y = r.y + a.dy AND w.x = r.x + b.dx),
{tag} AS (SELECT g.note_id, g.y, g.x, CAST(r.note_id IS NOT NULL AS INT) AS edge FROM {tag}g g LEFT JOIN {tag}r r ON r.note_id = g.note_id AND r.y = g.y AND r.x = g.x)
"""


_EDGES = _canny("gr", 80, 200, "ed")
_LINES = f"nr AS (SELECT note_id, y, x - 49 AS x, gray FROM gr WHERE {_region('thread_narrow')}),\n" + _canny("nr", 60, 180, "nb") + """,
l1 AS (SELECT note_id, x, y, CASE WHEN y - lag(y) OVER (PARTITION BY note_id, x ORDER BY y) > 15 THEN 1 ELSE 0 END AS new FROM nb WHERE edge > 0),
l2 AS (SELECT *, sum(new) OVER (PARTITION BY note_id, x ORDER BY y ROWS UNBOUNDED PRECEDING) AS island FROM l1),
w8 AS (SELECT note_id, x, min(y) AS y0, max(y) AS y1 FROM l2 GROUP BY note_id, x, island HAVING max(y) - min(y) + 1 >= 0.4 * 64)
"""
_IMAGES = "(SELECT DISTINCT note_id FROM fx_pixels)"


def _q(select: str, *more: str) -> str:
    return oracle(",\n".join([_PX, *more]) + select, "fx_pixels")


def _map(b: str, g: str, r: str) -> str:
    return f"SELECT note_id, y, x, w, h, {b} AS b, {g} AS g, {r} AS r FROM gr"


_MB = ", ".join(f"CAST(floor(avg({c}) OVER (PARTITION BY note_id, y ORDER BY x ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) + 0.5) AS INT) AS {c}" for c in "bgr")
_C1 = """s1 AS (SELECT g.note_id, stddev_pop(gray) AS std, avg(edge) AS er FROM gr g JOIN ed USING (note_id, y, x) GROUP BY g.note_id),
q1 AS (SELECT note_id, count(*) FILTER (m < 25) AS dq FROM (SELECT note_id, y < 32 AS a, x < 70 AS b, avg(gray) AS m FROM gr GROUP BY ALL) GROUP BY note_id)"""
_HUE = f"""hs AS (SELECT note_id, y, x, w, ih, ({_HUE_OF} + 60) % 180 AS h, {_SAT_OF} / 255 AS s, v FROM hh),
hp AS (SELECT *, floor(h / 30) AS k, h / 30 - floor(h / 30) AS f FROM hs),
hq AS (SELECT *, CAST(floor(round(v * (1 - s), 6) + 0.5) AS INT) AS p, CAST(floor(round(v * (1 - s * f), 6) + 0.5) AS INT) AS q, CAST(floor(round(v * (1 - s * (1 - f)), 6) + 0.5) AS INT) AS t FROM hp)"""

_PERSPECTIVE = f"""SELECT t.note_id, CAST(j AS INT) AS y, CAST(i AS INT) AS x, 119 AS w, 53 AS h, {", ".join(f"CAST(floor(round(sum(k * {c}) / sum(k), 6) + 0.5) AS INT) AS {c}" for c in "bgr")} FROM (
 SELECT note_id, i, j, floor(sx) + a AS px, floor(sy) + c AS py, (CASE a WHEN 1 THEN sx - floor(sx) ELSE 1 - (sx - floor(sx)) END) * (CASE c WHEN 1 THEN sy - floor(sy) ELSE 1 - (sy - floor(sy)) END) AS k FROM (
  SELECT note_id, i, j, round(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / (g * u + h * v + 1), 6) AS sx, round(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / (g * u + h * v + 1), 6) AS sy FROM (
   SELECT *, ((x0 - x1 + x2 - x3) * (y3 - y2) - (x3 - x2) * (y0 - y1 + y2 - y3)) / n AS g, ((x1 - x2) * (y0 - y1 + y2 - y3) - (x0 - x1 + x2 - x3) * (y1 - y2)) / n AS h FROM (
    SELECT *, (x1 - x2) * (y3 - y2) - (x3 - x2) * (y1 - y2) AS n FROM (
     SELECT note_id, CAST(10 + note_id % 7 AS DOUBLE) AS x0, 5::DOUBLE AS y0, 129::DOUBLE AS x1, CAST(4 + note_id % 7 AS DOUBLE) AS y1, CAST(131 - note_id % 7 AS DOUBLE) AS x2, 60::DOUBLE AS y2, 12::DOUBLE AS x3, CAST(58 - note_id % 7 AS DOUBLE) AS y3 FROM {_IMAGES}) q0) q1) q2,
   (SELECT range AS i, range / 118::DOUBLE AS u FROM range(119)) ci, (SELECT range AS j, range / 52::DOUBLE AS v FROM range(53)) cj) q3, (SELECT unnest([0, 1]) AS a) na, (SELECT unnest([0, 1]) AS c) nc) t
JOIN fx_pixels p ON p.note_id = t.note_id AND p.x = px AND p.y = py WHERE k > 0 GROUP BY t.note_id, i, j"""

#: The blur of the watermark panel over 25 pixels.
_LOCAL = f"""k25(d, c) AS ({values_sql((i - 12, repr(w) + '::DOUBLE') for i, w in enumerate(S.gaussian_kernel(25))).replace("'", '')}),
l1 AS (SELECT p.note_id, p.y, t.x, sum(k25.c * p.gray) AS f FROM (SELECT DISTINCT x FROM wp) t, k25 JOIN wp p ON true WHERE p.x = {_reflect('t.x + k25.d', 35)} GROUP BY p.note_id, p.y, t.x),
l2 AS (SELECT p.note_id, t.y, p.x, CAST(floor(round(sum(k25.c * p.f), 6) + 0.5) AS INT) AS gray FROM (SELECT DISTINCT y FROM wp) t, k25 JOIN l1 p ON true WHERE p.y = {_reflect('t.y + k25.d', 45)} GROUP BY p.note_id, t.y, p.x)"""

ORACLE_SQL = {
    "p1_gray": _q("SELECT note_id, y, x, gray FROM gr"),
    "p2_hsv": _q("SELECT * FROM hsv"),
    "p3_regions": _q(" UNION ALL ".join(f"SELECT note_id, '{n}' AS region, count(*) AS n, CAST(sum(g) AS BIGINT) AS g FROM fx_pixels WHERE {_region(n)} GROUP BY note_id" for n in P.REGIONS)),
    "p4_in_range": _q("SELECT note_id, y, x FROM hsv WHERE s >= 120 AND v >= 120"),
    "p5_landscape": _q("SELECT note_id, x0 AS y, 139 - y0 AS x, w, h, b, g, r FROM (SELECT note_id, x AS y0, y AS x0, 140 AS w, 64 AS h, b, g, r FROM fx_pixels)"),
    "p6_border_bands": _q("SELECT note_id, k AS bands, count(*) AS n FROM bd GROUP BY note_id, k"),
    "p7_quadrants": _q("SELECT note_id, CASE WHEN y < 32 THEN CASE WHEN x < 70 THEN 0 ELSE 1 END WHEN x < 70 THEN 2 ELSE 3 END AS q, count(*) AS n, CAST(sum(r) AS BIGINT) AS r FROM fx_pixels GROUP BY ALL"),
    "p8_block_means": _q("SELECT note_id, CAST(y * 16 // h AS INT) AS gy, CAST(x * 16 // w AS INT) AS gx, round(avg(b) / 255, 6) AS b, round(avg(g) / 255, 6) AS g, round(avg(r) / 255, 6) AS r FROM fx_pixels GROUP BY ALL"),
    "a0_hsv_histogram": _q("SELECT * FROM hist"),
    "a1_saturated_ratio": _q("SELECT note_id, round(uv_ratio, 6) AS uv_ratio FROM a1"),
    "a2_mean_saturation": _q("SELECT note_id, round(avg(s), 6) AS mean_sat FROM hsv GROUP BY note_id"),
    "a3_hue_histogram": _q("SELECT note_id, h, n, round(p, 6) AS p FROM a3"),
    "a4_hue_entropy": _q("SELECT note_id, round(CASE WHEN coloured < 200 THEN 0 ELSE entropy END, 6) AS entropy, coloured FROM a4"),
    "a5_masked_medians": _q("SELECT note_id, CAST(median(h) AS DOUBLE) AS med_hue, CAST(median(s) AS DOUBLE) AS med_sat, count(*) AS coloured_px FROM hsv WHERE s > 25 GROUP BY note_id"),
    "a6_brightness_std": _q("SELECT note_id, round(stddev_pop(gray), 6) AS brightness_std FROM gr GROUP BY note_id"),
    "a7_dark_quadrants": _q("SELECT note_id, count(*) FILTER (m < 25) AS dark_quadrants FROM (SELECT note_id, y < 32 AS a, x < 70 AS b, avg(gray) AS m FROM gr GROUP BY ALL) GROUP BY note_id"),
    "a8_border_interior_std": _q("SELECT note_id, round(border_std, 4) AS border_std, round(interior_std, 4) AS interior_std FROM a8"),
    "a9_watermark_variance": _q("SELECT note_id, round(variance, 4) AS variance FROM a9"),
    "a10_edge_ratio": _q("SELECT note_id, round(avg(edge), 6) AS edge_ratio FROM ed GROUP BY note_id", _EDGES),
    "a11_otsu": _q("SELECT * FROM a11", _THREAD),
    "a12_coloured_share": _q("SELECT note_id, round(count(*) FILTER (s > 25) / count(*), 6) AS coloured_share FROM hsv GROUP BY note_id"),
    "a13_patch_score": _q("SELECT note_id, round(patch_score, 4) AS patch_score FROM a13"),
    "w1_gaussian_blur": _q("SELECT * FROM b2"),
    "y0_local_threshold": _q("SELECT wp.note_id, wp.y, wp.x, CASE WHEN wp.gray - l2.gray <= -12 THEN 1 ELSE 0 END AS dark FROM wp JOIN l2 USING (note_id, y, x)", _LOCAL),
    "w2_sobel": _q("SELECT * FROM t2", _THREAD),
    "w3_vertical_close": _q("SELECT * FROM m2", _THREAD),
    "w4_vertical_open": _q("SELECT * FROM m4", _THREAD),
    "w5_components": _q("SELECT * FROM w5", _THREAD),
    "w6_edges": _q("SELECT note_id, y, x FROM ed WHERE edge = 1", _EDGES),
    "w7_motion_blur": _q(f"SELECT note_id, y, x, {_MB} FROM gr"),
    "w8_vertical_lines": _q("SELECT * FROM w8", _LINES),
    "c1_structural_sanity": _q("SELECT note_id, 'structural_sanity' AS check_name, CASE WHEN std < 12 OR er < 0.005 OR er > 0.30 OR dq >= 2 THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN std < 12 THEN 'uniform' WHEN er < 0.005 THEN 'no structure' WHEN er > 0.30 THEN 'noise' WHEN dq >= 2 THEN 'dark' ELSE 'ok' END AS details, CAST(NULL AS VARCHAR) AS value FROM s1 JOIN q1 USING (note_id)", _EDGES, _C1),
    "c2_uv_features": _q("SELECT note_id, 'uv_light_detection' AS check_name, CASE WHEN uv_ratio >= 0.001 THEN 'PASS' ELSE 'INFO' END AS status, CASE WHEN uv_ratio >= 0.001 THEN 'saturated marks' ELSE 'none' END AS details, CAST(round(uv_ratio, 6) AS VARCHAR) AS value FROM a1"),
    "c3_watermark": _q("SELECT note_id, 'watermark_detection' AS check_name, CASE WHEN variance BETWEEN 80 AND 2500 THEN 'PASS' ELSE 'FAIL' END AS status, 'panel variance' AS details, CAST(round(variance, 4) AS VARCHAR) AS value FROM a9"),
    "c4_security_thread": _q(f"SELECT note_id, 'security_thread_detection' AS check_name, CASE WHEN n IS NULL THEN 'FAIL' ELSE 'PASS' END AS status, CASE WHEN n IS NULL THEN 'no thread' ELSE n || ' found; tallest ' || CAST(round_even(t[1] / 64 * 100, 0) AS INT) || '%, ' || t[3] || ' px wide' END AS details, CAST(density AS VARCHAR) AS value FROM {_IMAGES} LEFT JOIN th USING (note_id)", _THREAD),
    "c5_palette_integrity": _q("SELECT note_id, 'hologram_detection' AS check_name, CASE WHEN coalesce(coloured, 0) >= 200 AND mean_sat >= 20 AND entropy >= 3.4 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN coalesce(coloured, 0) < 200 THEN 'desaturated' WHEN mean_sat >= 20 AND entropy >= 3.4 THEN 'palette ok' ELSE 'palette off' END AS details, CAST(round(entropy, 4) AS VARCHAR) AS value FROM (SELECT note_id, avg(s) AS mean_sat FROM hsv GROUP BY note_id) LEFT JOIN a4 USING (note_id)"),
    "c10_portrait": oracle("SELECT n.note_id, 'gandhi_face_analysis' AS check_name, CASE WHEN coalesce(k, 0) > 0 THEN 'PASS' ELSE 'FAIL' END AS status, coalesce(k, 0) || ' face(s)' AS details, CAST(coalesce(k, 0) AS VARCHAR) AS value FROM fx_notes n LEFT JOIN (SELECT note_id, count(*) FILTER (w >= 40 AND h >= 40) AS k FROM fx_faces GROUP BY note_id) f USING (note_id)", "fx_faces"),
    "c11_wide_checks": oracle("SELECT note_id, " + ", ".join(f"max(status) FILTER (check_name = '{c}') AS {c}" for c in (*CHECKS, "modular_ai_pipeline")) + " FROM fx_checks GROUP BY note_id", "fx_checks"),
    "g5_perspective": _q(_PERSPECTIVE),
    "g5_rectify": _q("SELECT t.note_id, CAST(j AS INT) AS y, CAST(i AS INT) AS x, 119 AS w, 52 AS h, b, g, r FROM (SELECT note_id, i, j, CAST(floor(10 + i * (119::DOUBLE / 118) + j * (2::DOUBLE / 51) + 0.5) AS INT) AS sx, CAST(floor(5 + i * (0::DOUBLE / 118) + j * (53::DOUBLE / 51) + 0.5) AS INT) AS sy FROM " + _IMAGES + ", range(119) a(i), range(52) c(j)) t JOIN fx_pixels p ON p.note_id = t.note_id AND p.x = sx AND p.y = sy"),
    "g6_borders_uniform": _q("SELECT note_id, border_std < 25 AND interior_std > 15 AS uniform FROM a8"),
    "e15_raw_signals": _q("SELECT note_id, round(variance, 4) AS variance, round(uv_ratio, 6) AS uv_ratio, round(patch_score, 4) AS patch_score, coalesce(k, 0) AS lines FROM a9 JOIN a1 USING (note_id) JOIN a13 USING (note_id) LEFT JOIN (SELECT note_id, count(*) AS k FROM w8 GROUP BY note_id) USING (note_id)", _LINES),
    "n1_blank": _q("SELECT note_id, b, count(*) AS n FROM (SELECT note_id, unnest([0, 255]) AS b FROM fx_pixels) GROUP BY ALL"),
    "n5_half_crop": _q(_map(*[f"CASE WHEN y >= h // 2 THEN 0 ELSE {c} END" for c in "bgr"])),
    "n6_invert": _q(_map(*[f"255 - {c}" for c in "bgr"])),
    "n7_desaturate": _q(_map("gray", "gray", "gray")),
    "n8_hue_shift": _q("SELECT note_id, y, x, w, ih AS h, CASE k WHEN 0 THEN p WHEN 1 THEN p WHEN 2 THEN t WHEN 3 THEN v WHEN 4 THEN v ELSE q END AS b, CASE k WHEN 0 THEN t WHEN 1 THEN v WHEN 2 THEN v WHEN 3 THEN q WHEN 4 THEN p ELSE p END AS g, CASE k WHEN 0 THEN v WHEN 1 THEN q WHEN 2 THEN p WHEN 3 THEN p WHEN 4 THEN t ELSE v END AS r FROM hq", _HUE),
    "n9_stretch": _q("SELECT note_id, y, CAST(tx AS INT) AS x, 182 AS w, h, b, g, r FROM range(182) t(tx) JOIN fx_pixels ON x = floor(tx / 1.3::DOUBLE)"),
    "n10_motion_blur": _q(f"SELECT note_id, y, x, w, h, {_MB} FROM gr"),
}
_DIMS = values_sql((k, w / h) for k, (w, h) in DIMENSIONS_MM.items())
_KNOWN = "expected IS NOT NULL AND aspect IS NOT NULL"
ORACLE_SQL["c9_read_proportions"] = f"""SELECT note_id, 'proportion_analysis' AS check_name, CASE WHEN NOT ({_KNOWN}) THEN 'INFO' WHEN abs(aspect - expected) / expected * 100 <= 15 THEN 'PASS' ELSE 'FAIL' END AS status,
 CASE WHEN {_KNOWN} THEN round_even(aspect, 3) END AS actual_aspect, CASE WHEN {_KNOWN} THEN round_even(expected::DOUBLE, 3) END AS expected_aspect, CASE WHEN {_KNOWN} THEN round_even(abs(aspect - expected) / expected * 100, 1) END AS deviation_pct, CASE WHEN {_KNOWN} THEN 'quad' END AS measurement
FROM ({oracle(TQ._scored(1) + 'SELECT note_id, value FROM dc', 'fx_tokens', 'fx_palette_stats')}) r LEFT JOIN ({oracle(SQ._G + 'SELECT note_id, aspect FROM g4', 'fx_contours')}) a USING (note_id) LEFT JOIN ({_DIMS}) dim(denom, expected) ON dim.denom = r.value"""
_BYTE = "CAST(('0x' || substr(m, {at}, 2)) AS BIGINT)::INT"
ORACLE_SQL["n2_noise"] = oracle("k AS (SELECT *, md5(concat_ws(':', note_id, y, x, 0)) AS m FROM fx_pixels) SELECT note_id, y, x, w, h, " + ", ".join(f"{_BYTE.format(at=2 * i + 1)} AS {c}" for i, c in enumerate("bgr")) + " FROM k", "fx_pixels")
_KERNEL = "k51(d, c) AS (" + values_sql((i - 25, repr(w) + "::DOUBLE") for i, w in enumerate(S.gaussian_kernel(51))).replace("'", "") + ")"
_TAP = "sum(c * p.{0}) AS {0}"
ORACLE_SQL["n3_heavy_blur"] = oracle(
    _KERNEL
    + f""",
kx AS (SELECT x.i AS x, {_reflect('x.i + d', 140)} AS sx, sum(c) AS c FROM range(140) x(i), k51 GROUP BY ALL),
ky AS (SELECT y.i AS y, {_reflect('y.i + d', 64)} AS sy, sum(c) AS c FROM range(64) y(i), k51 GROUP BY ALL),
h1 AS (SELECT p.note_id, p.y, kx.x, {', '.join(_TAP.format(c) for c in 'bgr')} FROM fx_pixels p JOIN kx ON p.x = sx GROUP BY p.note_id, p.y, kx.x),
h2 AS (SELECT p.note_id, ky.y, p.x, {', '.join(_TAP.format(c) for c in 'bgr')} FROM h1 p JOIN ky ON p.y = sy GROUP BY p.note_id, ky.y, p.x)
SELECT note_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, 140 AS w, 64 AS h, {', '.join(f'CAST(floor(round({c}, 6) + 0.5) AS INT) AS {c}' for c in 'bgr')} FROM h2""",
    "fx_pixels",
)
ORACLE_SQL["n4_low_resolution"] = oracle("k AS (SELECT *, floor(x * 20 / w) AS bx, floor(y * greatest(floor(h * 20 / w), 1) / h) AS by_ FROM fx_pixels), m AS (SELECT note_id, bx, by_, " + ", ".join(f"CAST(floor(avg({c}) + 0.5) AS INT) AS {c}" for c in "bgr") + " FROM k GROUP BY ALL) SELECT k.note_id, y, x, w, h, m.b, m.g, m.r FROM k JOIN m USING (note_id, bx, by_)", "fx_pixels")
