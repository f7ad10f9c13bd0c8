"""Steps whose rows are many beside their input: nothing is broadcast or held in one task."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from guilloche.operators import checks, controls, geometry, stencil
from guilloche.operators import pixels as P
from guilloche.plans import pixel_queries, screening, screening_queries
from guilloche.plans.fixtures import load
from guilloche.sources import images
from guilloche.streaming.parts import GATHERED


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def pixel_table(spark, w=20, h=10, notes=3):
    return spark.range(notes).selectExpr("id AS note_id").crossJoin(spark.range(w * h).selectExpr(f"CAST(id div {w} AS INT) AS y", f"CAST(id % {w} AS INT) AS x")).selectExpr("*", f"{w} AS w", f"{h} AS h", "CAST((x * 3 + note_id) % 256 AS INT) AS b", "y AS g", "x AS r")


def quad_table(spark, notes=2):
    corners = {"tl_x": 2, "tl_y": 1, "tr_x": 17, "tr_y": 1, "br_x": 17, "br_y": 8, "bl_x": 2, "bl_y": 8}
    return spark.range(notes).selectExpr("id AS note_id", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in corners.items()], "16D AS avg_w", "8D AS avg_h")


def test_crops_make_no_row_for_a_target_before_it_has_its_value(spark):
    px, quads = pixel_table(spark), quad_table(spark)
    for crop in (geometry.rectify, geometry.rectify_perspective):
        made = crop(px, quads, min_w=10, min_h=5)
        assert "sequence(0, " not in plan(made)  # targets as rows, which a join then broadcasts
        got = {(r.note_id, r.y, r.x): (r.w, r.h, r.b, r.g, r.r) for r in made.collect()}
        for n in range(2):
            assert {k[1:]: v for k, v in got.items() if k[0] == n} == {(j, i): (16, 8, ((i + 2) * 3 + n) % 256, j + 1, i + 2) for j in range(8) for i in range(16)}
        assert sum(k[0] == 2 for k in got) == 200


def test_crop_of_an_image_of_several_tiles_and_missing_pixels(spark):
    px = pixel_table(spark, w=300, h=140, notes=1).withColumn("b", F.col("x") % 200).where("NOT (x = 100 AND y = 50)")
    corners = {"tl_x": -3, "tl_y": 2, "tr_x": 296, "tr_y": 2, "br_x": 296, "br_y": 137, "bl_x": -3, "bl_y": 137}
    quads = spark.range(1).selectExpr("id AS note_id", *[f"CAST({v} AS DOUBLE) AS {k}" for k, v in corners.items()], "300D AS avg_w", "136D AS avg_h")
    want = {(j, i): (i - 3) % 200 for j in range(136) for i in range(3, 300) if (i - 3, j + 2) != (100, 50)}
    for crop in (geometry.rectify, geometry.rectify_perspective):
        assert {(r.y, r.x): r.b for r in crop(px, quads).collect()} == want


def test_stretch_joins_nothing(spark):
    px = pixel_table(spark, w=20, h=2, notes=2)
    for factor in (1.3, 0.6, 2.0):
        made = controls.stretch(px, factor=factor)
        assert plan(made).count("Join") == plan(px).count("Join")
        got = sorted((r.note_id, r.y, r.x, r.w, r.b) for r in made.collect())
        nw = int(20 * factor)
        assert got == [(n, y, t, nw, (int(t / factor) * 3 + n) % 256) for n in range(2) for y in range(2) for t in range(nw)]


def test_conditions_on_colours_do_not_work_them_out_again(spark, data):
    for made in (P.in_range(P.to_hsv(load(spark, data, "fx_pixels"))).where("mask"), P.hue_histogram(P.hsv_histogram(load(spark, data, "fx_pixels")))):
        assert "Join Cross, rightHint" in plan(made)  # no condition in it
    some = P.to_hsv(pixel_table(spark)).where("s > 60")
    assert some.columns == ["note_id", "y", "x", "w", "img_h", "b", "g", "r", "h", "s", "v"]


def test_views_by_the_thousand_are_dealt_out_by_note(spark, data, tmp_path):
    spark.range(300).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    for view, rows in (("fx_pixels", 8960), ("fx_frames", 19200)):
        px = load(spark, str(tmp_path), view)
        assert px.rdd.getNumPartitions() >= 300 * rows / 2**19
        assert px.groupBy("note_id", "y").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_images_are_packed_and_unpacked_by_bytes(spark):
    px = pixel_table(spark, w=5, h=3, notes=2).where("NOT (note_id = 1 AND x = 2)")
    rows = {r.note_id: bytes(r.data) for r in images.packed(px, order="bgr").collect()}
    assert rows == {n: bytes(v for y in range(3) for x in range(5) for v in ((0, 0, 0) if n == x - 1 == 1 else (x * 3 + n, y, x))) for n in range(2)}
    image = lambda data, c: ("", 2, 2, c, 16, bytearray(data))
    given = [(1, image(range(16), 4)), (2, image(range(4), 1)), (3, image(range(7), 3)), (4, None)]
    table = spark.createDataFrame(given, "note_id int, image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>")
    made = images.to_pixels(table)
    assert "conv(" not in plan(made)  # text for each byte
    got = {(r.note_id, r.y, r.x): (r.b, r.g, r.r) for r in made.collect()}
    assert [got[1, 1, 1], got[2, 1, 0], got[3, 1, 0], got[3, 1, 1]] == [(12, 13, 14), (2, 2, 2), (6, None, None), (None, None, None)]
    assert len(got) == 12 and images.to_pixels(table, stride=2).count() == 3


def test_arrivals_are_not_written_by_one_task(spark, tmp_path):
    parts = spark.range(40).repartition(4).selectExpr("id AS note_id", "'score' AS kind", "0 AS w", "0 AS h", "CAST(NULL AS BINARY) AS data", "'1' AS body", "0 AS due")
    screening_queries.write_parts(parts, str(tmp_path), 0)
    assert len(list(tmp_path.glob("due=0/*.parquet"))) > 1


def test_hue_shift_works_each_level_out_once(spark):
    assert plan(controls.hue_shift(pixel_table(spark))).count("round(") <= 3


def test_runs_are_labelled_without_a_data_frame_an_image(spark):
    made = stencil.edge_runs(P.to_gray(pixel_table(spark, w=40, h=30)))
    assert "FlatMapGroupsInPandas" not in plan(made)
    runs = spark.createDataFrame([(None, 3, 0, 1, 9, 1), (None, 3, 2, 4, 9, 0), (None, 4, 5, 6, 9, 0), (None, 6, 0, 0, 9, 0), (7, 0, 0, 0, 9, 1)], "note_id int, x int, y0 int, y1 int, h int, strong int")
    want = {(None, 3, 0, 4, 9, 3, 0), (None, 4, 5, 6, 9, 3, 0), (7, 0, 0, 0, 9, 0, 0)}
    assert {tuple(r) for r in stencil.label_runs(runs, "strong").collect()} == want
    assert {tuple(r) for r in stencil.label_runs(runs).collect()} == want | {(None, 6, 0, 0, 9, 6, 0)}


def test_blur_is_a_product_with_the_kernel_as_a_band():
    v = np.random.default_rng(3).integers(0, 256, (9, 60)).astype(float)
    kernel = stencil.gaussian_kernel(51)
    assert np.allclose(v @ stencil._band(51, 10), sum(k * v[:, i : i + 10] for i, k in enumerate(kernel)), atol=1e-9, rtol=0)


def test_lines_are_made_of_runs_not_of_pixels(spark, data):
    r = np.random.default_rng(5)
    rows = [(n, x, int(y), int(y + r.integers(0, 9)), 120) for n in range(2) for x in range(4) for y in np.cumsum(r.integers(12, 24, 5))]
    runs = spark.createDataFrame(rows, "note_id int, x int, y0 int, y1 int, h int")
    mask = runs.select("note_id", "x", F.explode(F.sequence("y0", "y1")).alias("y"), "h", F.lit(1).alias("edge"))
    want = sorted(tuple(v) for v in stencil.vertical_lines(mask, "edge", "h").collect())
    assert want and sorted(tuple(v) for v in stencil.line_runs(runs).collect()) == want
    assert "sequence(y0" not in plan(pixel_queries.QUERIES["e15_raw_signals"](spark, data))


def test_shares_of_pixels_make_no_histogram(spark, data):
    px = pixel_table(spark)
    assert sorted(checks.uv_features(P.hsv_pixels(px)).collect()) == sorted(checks.uv_features(P.hsv_histogram(px)).collect())
    assert plan(pixel_queries.QUERIES["c2_uv_features"](spark, data)).count("Aggregate") == 1


def test_screening_reads_only_what_belongs_to_its_notes(spark, data, monkeypatch):
    class Seen(Exception):
        pass

    def check(notes, tokens):
        assert tokens.join(notes, "note_id", "left_anti").isEmpty() and not tokens.isEmpty()
        raise Seen

    monkeypatch.setattr(screening.T, "serial_check", check)
    monkeypatch.setattr(screening.G, "rectify_perspective", None)  # no outline, no crop
    with pytest.raises(Seen):
        screening.all_checks(screening_queries._unread(spark, data))


def test_gathered_images_stay_dealt_out_by_note(spark):
    data = {1: bytes(range(45)), 2: bytes(range(200, 237)), 3: None, 4: bytes(60), 5: b""}
    notes = spark.createDataFrame([(n, False, 5, 3, None if d is None else bytearray(d), *["[]"] * 4, "1") for n, d in data.items()], GATHERED)
    dealt = screening.dealt(notes)
    px = screening.gathered_inputs(dealt).pixels
    assert "Exchange" not in px.groupBy("note_id", "y").count()._jdf.queryExecution().executedPlan().toString()
    image = F.struct(F.lit("").alias("origin"), F.col("h").alias("height"), F.col("w").alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), "data")
    want = images.to_pixels(notes.select("note_id", image.alias("image")))
    assert px.dtypes == want.dtypes and px.count() == 60
    assert px.exceptAll(want).isEmpty() and want.exceptAll(px).isEmpty()
    assert {r.note_id: r.seen for r in dealt.collect()} == {n: n != 3 for n in data}


def test_rows_of_other_notes_go_before_a_view_numbers_them(spark, data):
    given = screening_queries._inputs(spark, data)
    made = plan(given.blobs)
    assert 0 < made.index("Window") < made.index("LeftSemi")
    assert given.blobs.exceptAll(load(spark, data, "fx_blobs").join(given.known, "note_id", "left_semi").select(*given.blobs.columns)).isEmpty()


def test_arrivals_are_made_for_their_time_alone(spark, data):
    given, scores = screening_queries._unlocated(spark, data), load(spark, data, "fx_scores")
    given = replace(given, **{k: getattr(given, k).where("note_id < 5") for k in ("pixels", "known")})
    of = lambda parts: sorted(((r.note_id, r.kind, r.w, r.data, r.body, r.due) for r in parts.withColumn("body", F.when(F.col("kind") == "score", F.col("body")).otherwise(F.length("body").cast("string"))).collect()), key=lambda r: r[:2])
    whole = of(screening_queries.note_parts(given, scores))
    assert len(whole) == 30
    for due in range(3):
        assert of(screening_queries.note_parts(given, scores, due=due)) == [r for r in whole if r[-1] == due]
