"""Queries and oracle SQL of typography and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from guilloche.operators import geometry as G
from guilloche.operators import outline as O
from guilloche.operators import pixels as P
from guilloche.operators import typography as Y
from guilloche.schemas import DIMENSIONS_MM, values_sql
from guilloche.staging import stage

from .fixtures import load, oracle


def _blobs(spark, d):
    return load(spark, d, "fx_blobs")


def _digits(spark, d):
    return Y.digits_of(_blobs(spark, d))


def _contours(spark, d):
    return load(spark, d, "fx_contours")


def y1(spark, d):
    return Y.geometry_filter(_blobs(spark, d)).withColumn("fill", F.round("fill", 6)).withColumn("area", F.round("area", 6))


def y2(spark, d):
    return Y.usual_heights(Y.geometry_filter(_blobs(spark, d))).select("note_id", "x", "y", "w", "h", "baseline")


def y3(spark, d):
    m = Y.merge_overlaps(Y.usual_heights(Y.geometry_filter(_blobs(spark, d))))
    return m.withColumns({"area": F.round("area", 6), "fill": F.round("fill", 6)})


def y4(spark, d):
    return Y.trailing_run(Y.merge_overlaps(Y.usual_heights(Y.geometry_filter(_blobs(spark, d))))).select("note_id", "pos", "x", "h", "n_blobs")


def y5(spark, d):
    return _digits(spark, d).select("note_id", "i", "x", "h", "baseline")


def y6(spark, d):
    return Y.fit(_digits(spark, d)).select("note_id", "n", *[F.round(c, 5).alias(c) for c in ("slope", "intercept", "r2", "norm_slope")])


def y7(spark, d):
    return Y.growth(_digits(spark, d)).select("note_id", *[F.round(c, 6).alias(c) for c in ("avg_pct", "median_pct", "growth_ratio", "total_pct")])


def y8(spark, d):
    return Y.scores(_digits(spark, d)).select("note_id", "monotonic", "smoothness", "consistency", "baseline_alignment")


def y9(spark, d):
    return Y.check(load(spark, d, "orders").selectExpr("o_orderkey AS note_id"), _blobs(spark, d))


def g1(spark, d):
    return G.gate(_contours(spark, d)).select("note_id", "contour_id", "rank", F.round("area", 6).alias("area"))


def g2(spark, d):
    return G.ordered(_contours(spark, d).select("note_id", "contour_id", *[f"{a}{k}" for k in range(4) for a in "xy"]))


def g3(spark, d):
    return G.measured(G.ordered(G.gate(_contours(spark, d)))).select("note_id", "contour_id", *[F.round(c, 6).alias(c) for c in ("avg_w", "avg_h", "aspect")])


def g4(spark, d):
    return G.first_quad(_contours(spark, d)).select("note_id", "contour_id", F.round("aspect", 6).alias("aspect"))


def _aspects(spark, d):
    frames = load(spark, d, "customer").selectExpr("c_custkey AS note_id", "CAST(40 + c_custkey % 300 AS INT) AS img_w", "CAST(40 + c_custkey % 70 AS INT) AS img_h", "c_custkey % 3 <> 0 AS uniform")
    return G.aspects(frames, G.first_quad(_contours(spark, d)))


def _proportions(spark, d):
    notes = load(spark, d, "customer").selectExpr("c_custkey AS note_id", "CASE c_custkey % 8 WHEN 0 THEN '10' WHEN 1 THEN '20' WHEN 2 THEN '50' WHEN 3 THEN '100' WHEN 4 THEN '200' WHEN 5 THEN '500' WHEN 6 THEN '2000' END AS denom")
    return G.proportions(notes, _aspects(spark, d))


def g7(spark, d):
    return _aspects(spark, d).withColumn("aspect", F.round("aspect", 6))


def g8(spark, d):
    return _proportions(spark, d)


def g9(spark, d):
    return G.deviation_band(_proportions(spark, d)).select("note_id", "deviation_pct", "band")


def _frame_quads(spark, d):
    """Quads of the drawn frames, from their pixels."""
    return stage(G.first_quad(O.outlines(load(spark, d, "fx_frames"), straighten=True)), "quads")


def g1_outlines(spark, d):
    """Whether each drawn frame has one outline of four corners, and whether all corners lie within two pixels of the drawn ones."""
    drawn, found = load(spark, d, "fx_drawn"), O.outlines(load(spark, d, "fx_frames"), straighten=True)
    j = drawn.join(found, "note_id", "left")
    off = []
    for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1)):
        u, v = a * F.col("half_w"), b * F.col("half_h")
        x, y = 80 + u * F.col("c") - v * F.col("s"), 60 + u * F.col("s") + v * F.col("c")
        off.append(F.least(*[F.hypot(F.col(f"x{k}") - x, F.col(f"y{k}") - y) for k in range(4)]))
    return j.groupBy("note_id").agg(F.count("contour_id").alias("outlines"), F.max("n_vertices").alias("corners"), F.max(F.greatest(*off) <= 2).alias("near"))


def g5_located(spark, d):
    """Size of each drawn note's crop, within two pixels, and the mean colour of its middle half; frames without a note as they are."""
    crop = G.rectify_perspective(load(spark, d, "fx_frames"), _frame_quads(spark, d), min_w=80, min_h=30)
    middle = (F.abs(2 * F.col("x") - F.col("w")) * 2 <= F.col("w")) & (F.abs(2 * F.col("y") - F.col("h")) * 2 <= F.col("h"))
    means = crop.groupBy("note_id").agg(F.first("w").alias("w"), F.first("h").alias("h"), *[F.round(F.avg(F.when(middle, F.col(c))), 6).alias(c) for c in "bgr"])
    drawn = load(spark, d, "fx_drawn")
    near = lambda c: F.abs(F.col(c) - F.when(F.col("there"), 2 * F.col(f"half_{c}")).otherwise(160 if c == "w" else 120)) <= 2
    flat = [F.when(F.col("there"), F.col(c)).alias(c) for c in "bgr"]
    return drawn.join(means, "note_id").select("note_id", near("w").alias("w_near"), near("h").alias("h_near"), *flat)


def g8_located(spark, d):
    """Proportion check of the drawn notes from their pixels: located, measured, and held against their denomination."""
    frames = load(spark, d, "fx_frames")
    sizes = frames.groupBy("note_id").agg(F.first("w").alias("img_w"), F.first("h").alias("img_h")).join(P.borders_uniform(frames), "note_id", "left")
    return G.proportions(load(spark, d, "fx_drawn"), G.aspects(sizes, _frame_quads(spark, d))).select("note_id", "check_name", "status", "expected_aspect", "measurement")


QUERIES = {
    "y1_blob_filter": y1, "y2_usual_heights": y2, "y3_merge_overlaps": y3, "y4_trailing_run": y4, "y5_aligned_digits": y5, "y6_height_fit": y6, "y7_step_growth": y7, "y8_stability_scores": y8, "y9_typography_check": y9,
    "g1_contour_gate": g1, "g2_ordered_corners": g2, "g3_quad_aspect": g3, "g4_first_quad": g4, "g7_measured_aspect": g7, "g8_proportions": g8, "g9_deviation_band": g9,
    "g1_outlines": g1_outlines, "g5_located_crop": g5_located, "g8_located_proportions": g8_located,
}

_Y = """
ya AS (SELECT *, y + h AS baseline, area / (w * h) AS fill FROM fx_blobs WHERE w > 0 AND h > 0),
y1 AS (SELECT note_id, x, y, w, h, area, baseline, fill FROM ya WHERE area >= 0.0015::DOUBLE * strip_h * strip_w AND h >= 0.20::DOUBLE * strip_h AND h <= 0.95::DOUBLE * strip_h AND w::DOUBLE / h BETWEEN 0.15::DOUBLE AND 1.6::DOUBLE AND fill >= 0.18::DOUBLE),
y2 AS (SELECT note_id, x, y, w, h, area, baseline, fill FROM (SELECT *, median(h) OVER (PARTITION BY note_id) AS m FROM y1) WHERE h >= 0.35::DOUBLE * m AND h <= 2.5::DOUBLE * m),
yo AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY x, y, w, h, area, baseline, fill) AS k FROM y2),
yr AS (SELECT note_id, k, 0 AS pos, x, y, w, h, area, baseline, fill FROM yo WHERE k = 1
 UNION ALL SELECT o.note_id, o.k, CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN r.pos ELSE r.pos + 1 END,
  CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN least(r.x, o.x) ELSE o.x END, CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN least(r.y, o.y) ELSE o.y END,
  CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN greatest(r.x + r.w, o.x + o.w) - least(r.x, o.x) ELSE o.w END, CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN greatest(r.y + r.h, o.y + o.h) - least(r.y, o.y) ELSE o.h END,
  CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN r.area + o.area ELSE o.area END, CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN greatest(r.y + r.h, o.y + o.h) ELSE o.baseline END,
  CASE WHEN o.x < r.x + r.w * 0.6::DOUBLE THEN (r.fill + o.fill) / 2 ELSE o.fill END
 FROM yr r JOIN yo o ON o.note_id = r.note_id AND o.k = r.k + 1),
y3 AS (SELECT * EXCLUDE (k) FROM yr QUALIFY row_number() OVER (PARTITION BY note_id, pos ORDER BY k DESC) = 1),
y4 AS (SELECT * EXCLUDE (back) FROM (SELECT *, count(*) OVER (PARTITION BY note_id) AS n_blobs, row_number() OVER (PARTITION BY note_id ORDER BY pos DESC) AS back FROM y3) WHERE n_blobs >= 3 AND back <= CASE WHEN n_blobs >= 9 THEN 7 WHEN n_blobs >= 7 THEN 6 ELSE n_blobs END),
y5 AS (SELECT *, row_number() OVER (PARTITION BY note_id ORDER BY pos) - 1 AS i FROM (SELECT *, median(baseline) OVER (PARTITION BY note_id) AS mb, median(h) OVER (PARTITION BY note_id) AS mh FROM y4) WHERE abs(baseline - mb) <= greatest(0.20::DOUBLE * mh, 4.0::DOUBLE)),
yz AS (SELECT note_id, count(*) AS n, CAST(sum(i) AS BIGINT) AS si, CAST(sum(h) AS BIGINT) AS sh, CAST(sum(baseline) AS BIGINT) AS sb, CAST(sum(i * h) AS BIGINT) AS sih, CAST(sum(i * i) AS BIGINT) AS sii, CAST(sum(h * h) AS BIGINT) AS shh, CAST(sum(baseline * baseline) AS BIGINT) AS sbb FROM y5 GROUP BY note_id),
yw AS (SELECT *, n * sih - si * sh AS xy, n * sii - si * si AS xx, n * shh - sh * sh AS yy, n * sbb - sb * sb AS zz FROM yz WHERE n >= 3 AND sh >= n),
y6 AS (SELECT note_id, n, xy / xx AS slope, (sh * sii - si * sih) / xx AS intercept, CASE WHEN yy = 0 THEN 0.0::DOUBLE ELSE (xy * xy) / (xx * yy) END AS r2, (xy * n) / (xx * sh) AS norm_slope, sh / n AS mean_h, CASE WHEN yy = 0 THEN 0.0::DOUBLE ELSE (xx * yy - xy * xy) / (xx * n * n) END AS left_var, sqrt(zz / (n * n)) AS std_b FROM yw),
ys AS (SELECT note_id, i, h::DOUBLE / greatest(p, 1) AS ratio, round_even((h::DOUBLE / greatest(p, 1) - 1) * 100, 2) AS pct FROM (SELECT *, lag(h) OVER (PARTITION BY note_id ORDER BY i) AS p FROM y5) WHERE p IS NOT NULL),
yg AS (SELECT note_id, avg(pct) AS avg_pct, median(pct) AS median_pct, avg(CASE WHEN ratio >= 0.985::DOUBLE THEN 1.0 ELSE 0.0 END) AS monotonic, stddev_pop(ratio) AS sr, avg(ratio) AS ar, list(pct ORDER BY i) AS steps FROM ys GROUP BY note_id),
ye AS (SELECT note_id, arg_max(h, i)::DOUBLE / greatest(arg_min(h, i), 1) AS growth_ratio, list(h ORDER BY i) AS sizes FROM y5 GROUP BY note_id),
y7 AS (SELECT *, (growth_ratio - 1) * 100 AS total_pct FROM yg JOIN ye USING (note_id)),
y8 AS (SELECT note_id, round_even(norm_slope, 4) AS norm_slope, round_even(r2, 4) AS r2, round_even(growth_ratio, 4) AS growth_ratio, round_even(total_pct, 2) AS total_pct, round_even(monotonic, 4) AS monotonic, round_even(greatest(0, 1 - sr / greatest(ar, 1e-3)), 4) AS smoothness,
 round_even(greatest(0, 1 - sqrt(left_var) / mean_h), 4) AS consistency, round_even(greatest(0, 1 - std_b / mean_h), 4) AS baseline_alignment, steps, sizes FROM y6 JOIN y7 USING (note_id)),
yc AS (SELECT n.note_id, coalesce(b.n, 0) AS blobs, coalesce(a.n, 0) AS aligned, y8.* EXCLUDE (note_id) FROM (SELECT o_orderkey AS note_id FROM orders) n LEFT JOIN (SELECT note_id, count(*) AS n FROM y3 GROUP BY note_id) b USING (note_id) LEFT JOIN (SELECT note_id, count(*) AS n FROM y5 GROUP BY note_id) a USING (note_id) LEFT JOIN y8 USING (note_id)),
yd AS (SELECT *, growth_ratio BETWEEN 1.08::DOUBLE AND 2.5::DOUBLE AND norm_slope > 0.005::DOUBLE AND r2 >= 0.45::DOUBLE AND monotonic >= 0.6::DOUBLE AS fits FROM yc),
y9 AS (SELECT *, CASE WHEN blobs < 3 THEN 'few blobs' WHEN aligned < 3 THEN 'few aligned' WHEN growth_ratio IS NULL THEN 'no fit' WHEN growth_ratio < 1.02::DOUBLE AND norm_slope <= 0.005::DOUBLE THEN 'not growing' WHEN growth_ratio > 2.5::DOUBLE THEN 'implausible' WHEN fits THEN 'growing' ELSE 'unclear' END AS details FROM yd)
"""
_G = """
ga AS (SELECT *, abs(x0 * y1 - x1 * y0 + x1 * y2 - x2 * y1 + x2 * y3 - x3 * y2 + x3 * y0 - x0 * y3) / 2 AS area FROM fx_contours),
gr AS (SELECT *, CAST(row_number() OVER (PARTITION BY note_id ORDER BY area DESC, contour_id) AS INT) AS rank FROM ga WHERE img_w * img_h >= 10000),
g1 AS (SELECT * FROM gr WHERE rank <= 6 AND area >= 0.15::DOUBLE * img_w * img_h AND area <= 0.97::DOUBLE * img_w * img_h AND n_vertices = 4),
gp AS (SELECT note_id, contour_id, k, CASE k WHEN 0 THEN x0 WHEN 1 THEN x1 WHEN 2 THEN x2 ELSE x3 END AS x, CASE k WHEN 0 THEN y0 WHEN 1 THEN y1 WHEN 2 THEN y2 ELSE y3 END AS y FROM fx_contours, (VALUES (0), (1), (2), (3)) v(k)),
g2 AS (SELECT note_id, contour_id, arg_min((x, y), (x + y, k)) AS tl, arg_min((x, y), (y - x, k)) AS tr, arg_min((x, y), (-x - y, k)) AS br, arg_min((x, y), (x - y, k)) AS bl FROM gp GROUP BY note_id, contour_id),
gq AS (SELECT note_id, contour_id, tl[1] AS tl_x, tl[2] AS tl_y, tr[1] AS tr_x, tr[2] AS tr_y, br[1] AS br_x, br[2] AS br_y, bl[1] AS bl_x, bl[2] AS bl_y FROM g2),
gs AS (SELECT gq.*, rank, (sqrt(pow(tr_x - tl_x, 2) + pow(tr_y - tl_y, 2)) + sqrt(pow(br_x - bl_x, 2) + pow(br_y - bl_y, 2))) / 2 AS avg_w, (sqrt(pow(bl_x - tl_x, 2) + pow(bl_y - tl_y, 2)) + sqrt(pow(br_x - tr_x, 2) + pow(br_y - tr_y, 2))) / 2 AS avg_h FROM gq JOIN g1 USING (note_id, contour_id)),
g3 AS (SELECT *, greatest(avg_w, avg_h) / least(avg_w, avg_h) AS aspect FROM gs WHERE least(avg_w, avg_h) >= 1 AND greatest(avg_w, avg_h) / least(avg_w, avg_h) BETWEEN 1.6::DOUBLE AND 3.2::DOUBLE),
g4 AS (SELECT * FROM g3 QUALIFY row_number() OVER (PARTITION BY note_id ORDER BY rank) = 1),
gf AS (SELECT c_custkey AS note_id, 40 + c_custkey % 300 AS img_w, 40 + c_custkey % 70 AS img_h, c_custkey % 3 <> 0 AS uniform FROM customer),
g7 AS (SELECT note_id, coalesce(aspect, CASE WHEN uniform AND least(img_w, img_h) >= 50 THEN greatest(img_w, img_h)::DOUBLE / least(img_w, img_h) END) AS aspect, CASE WHEN aspect IS NOT NULL THEN 'quad' WHEN uniform AND least(img_w, img_h) >= 50 THEN 'frame' END AS measurement FROM gf LEFT JOIN g4 USING (note_id)),
gd(denom, expected) AS (""" + values_sql((d, w / h) for d, (w, h) in DIMENSIONS_MM.items()) + """),
gn AS (SELECT c_custkey AS note_id, CASE c_custkey % 8 WHEN 0 THEN '10' WHEN 1 THEN '20' WHEN 2 THEN '50' WHEN 3 THEN '100' WHEN 4 THEN '200' WHEN 5 THEN '500' WHEN 6 THEN '2000' END AS denom FROM customer),
g8 AS (SELECT note_id, 'proportion_analysis' AS check_name, CASE WHEN expected IS NULL OR aspect IS NULL THEN 'INFO' WHEN abs(aspect - expected) / expected * 100 <= 15 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN expected IS NOT NULL AND aspect IS NOT NULL THEN round_even(aspect, 3) END AS actual_aspect, CASE WHEN expected IS NOT NULL AND aspect IS NOT NULL THEN round_even(expected::DOUBLE, 3) END AS expected_aspect,
 CASE WHEN expected IS NOT NULL AND aspect IS NOT NULL THEN round_even(abs(aspect - expected) / expected * 100, 1) END AS deviation_pct, CASE WHEN expected IS NOT NULL AND aspect IS NOT NULL THEN measurement END AS measurement FROM gn LEFT JOIN g7 USING (note_id) LEFT JOIN gd USING (denom))
"""


def _y(select: str) -> str:
    return oracle(_Y + select, "fx_blobs")


def _g(select: str) -> str:
    return oracle(_G + select, "fx_contours")


ORACLE_SQL = {
    "g1_outlines": oracle("SELECT note_id, CASE WHEN there THEN 1 ELSE 0 END AS outlines, CASE WHEN there THEN 4 END AS corners, CASE WHEN there THEN true END AS near FROM fx_drawn", "fx_drawn"),
    "g5_located_crop": oracle("SELECT note_id, true AS w_near, true AS h_near, CASE WHEN there THEN round(shade::DOUBLE, 6) END AS b, CASE WHEN there THEN 190.0::DOUBLE END AS g, CASE WHEN there THEN 210.0::DOUBLE END AS r FROM fx_drawn", "fx_drawn"),
    # A blank frame without a note is neither a quad nor a scan that a note fills.
    "g8_located_proportions": oracle(f"d(denom, wide, high) AS ({values_sql((k, *v) for k, v in DIMENSIONS_MM.items())}), a AS (SELECT note_id, there, wide::DOUBLE / high AS e, half_w / half_h AS a FROM fx_drawn JOIN d USING (denom)) SELECT note_id, 'proportion_analysis' AS check_name, CASE WHEN NOT there THEN 'INFO' WHEN abs(a - e) / e * 100 <= 15 THEN 'PASS' ELSE 'FAIL' END AS status, CASE WHEN there THEN round(e, 3) END AS expected_aspect, CASE WHEN there THEN 'quad' END AS measurement FROM a", "fx_drawn"),
    "y1_blob_filter": _y("SELECT note_id, x, y, w, h, round(area, 6) AS area, baseline, round(fill, 6) AS fill FROM y1"),
    "y2_usual_heights": _y("SELECT note_id, x, y, w, h, baseline FROM y2"),
    "y3_merge_overlaps": _y("SELECT note_id, pos, x, y, w, h, round(area, 6) AS area, baseline, round(fill, 6) AS fill FROM y3"),
    "y4_trailing_run": _y("SELECT note_id, pos, x, h, n_blobs FROM y4"),
    "y5_aligned_digits": _y("SELECT note_id, CAST(i AS INT) AS i, x, h, baseline FROM y5"),
    "y6_height_fit": _y("SELECT note_id, n, round(slope, 5) AS slope, round(intercept, 5) AS intercept, round(r2, 5) AS r2, round(norm_slope, 5) AS norm_slope FROM y6"),
    "y7_step_growth": _y("SELECT note_id, round(avg_pct, 6) AS avg_pct, round(median_pct, 6) AS median_pct, round(growth_ratio, 6) AS growth_ratio, round(total_pct, 6) AS total_pct FROM y7"),
    "y8_stability_scores": _y("SELECT note_id, monotonic, smoothness, consistency, baseline_alignment FROM y8"),
    "y9_typography_check": _y("SELECT note_id, 'serial_typography_analysis' AS check_name, CASE details WHEN 'not growing' THEN 'FAIL' WHEN 'growing' THEN 'PASS' ELSE 'INFO' END AS status, details, CASE WHEN growth_ratio IS NOT NULL THEN array_to_string(sizes, ',') END AS digit_sizes, CASE WHEN growth_ratio IS NOT NULL THEN array_to_string(list_transform(steps, lambda p: CAST(round_even(p, 0) AS INT)), ',') END AS growth_percentages, CASE WHEN growth_ratio IS NOT NULL THEN printf('%+d%%', CAST(round_even(total_pct, 0) AS INT)) END AS total_growth, CASE WHEN growth_ratio IS NOT NULL THEN fits END AS rbi_match FROM y9"),
    "g1_contour_gate": _g("SELECT note_id, contour_id, rank, round(area, 6) AS area FROM g1"),
    "g2_ordered_corners": _g("SELECT * FROM gq"),
    "g3_quad_aspect": _g("SELECT note_id, contour_id, round(avg_w, 6) AS avg_w, round(avg_h, 6) AS avg_h, round(aspect, 6) AS aspect FROM g3"),
    "g4_first_quad": _g("SELECT note_id, contour_id, round(aspect, 6) AS aspect FROM g4"),
    "g7_measured_aspect": _g("SELECT note_id, round(aspect, 6) AS aspect, measurement FROM g7"),
    "g8_proportions": _g("SELECT * FROM g8"),
    "g9_deviation_band": _g("SELECT note_id, deviation_pct, CASE WHEN deviation_pct IS NULL THEN 'gray' WHEN deviation_pct <= 5 THEN 'green' WHEN deviation_pct <= 15 THEN 'yellow' ELSE 'red' END AS band FROM g8"),
}
