"""Image files, manifests, reports and the meaning of the checks on drawn notes."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from guilloche import staging
from guilloche.operators import checks, controls, geometry, pixels, stencil
from guilloche.operators.ranges import running
from guilloche.plans import screening
from guilloche.schemas import DIMENSIONS_MM
from guilloche.sources import images


def png(path, rows):
    """Write 8-bit RGB rows as a PNG file."""
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in rows)
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    top = tmp_path_factory.mktemp("notes")
    png(top / "real/500/a.png", [[(x, 2 * y, 250) for x in range(5)] for y in range(3)])
    (top / "fake/100").mkdir(parents=True)
    (top / "fake/100/b.png").write_bytes(b"no image")
    return top


def test_scan_and_quarantine(spark, tree):
    good, bad = images.split_uploads(spark, str(tree))
    assert [(r.label, r.denom) for r in good.collect()] == [("real", "500")]
    assert [r.path.endswith("b.png") for r in bad.collect()] == [True]
    assert images.scan_images(spark, str(tree)).count() == 1


def test_pixels_of_an_image(spark, tree):
    rows = images.to_pixels(images.scan_images(spark, str(tree))).collect()
    assert {(r.y, r.x, r.b, r.g, r.r) for r in rows} == {(y, x, 250, 2 * y, x) for x in range(5) for y in range(3)}
    assert all((r.w, r.h) == (5, 3) for r in rows)


def test_manifest_and_report(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"_about": "x", "real/a.png": {"denom": "500", "side": "obverse", "serial": None, "grade": "clean"}}))
    row = images.read_manifest(spark, str(tmp_path / "m.json")).collect()
    assert [(r.path, r.denom, r.serial, r.grade) for r in row] == [("real/a.png", "500", None, "clean")]
    report = spark.sql("SELECT 'real' label, 'a' file, 0.5D model_raw, map('x', 1.5D) diagnostic, map('c', named_struct('status', 'PASS', 'details', '', 'value', '1')) forensic_analysis")
    images.write_report(report, str(tmp_path / "r"))
    back = images.read_report(spark, str(tmp_path / "r")).first()
    assert back.diagnostic == {"x": 1.5} and back.forensic_analysis["c"].status == "PASS"


def drawn(spark, kind, w=140, h=64):
    p = spark.range(w * h).select(F.lit(1).alias("note_id"), (F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    line = F.col("x").between(69, 71)
    value = {"blank": F.lit(128), "line": F.when(line, 20).otherwise(200), "texture": (F.col("x") * 7 + F.col("y") * 13) % 256}[kind]
    return p.select("*", *[(value if kind != "texture" else (value * (k + 1)) % 256).cast("int").alias(c) for k, c in enumerate("bgr")])


def statuses(df):
    return [r.status for r in df.collect()]


def test_blank_and_noise_fail_structure(spark):
    blank = drawn(spark, "blank")
    assert statuses(checks.structural_sanity(checks.structural_signals(blank))) == ["FAIL"]
    assert statuses(checks.structural_sanity(checks.structural_signals(controls.blank(blank, 0)))) == ["FAIL"]


def test_desaturated_note_fails_the_palette(spark):
    texture = drawn(spark, "texture")
    assert statuses(checks.palette_integrity(pixels.hsv_histogram(texture))) == ["PASS"]
    assert statuses(checks.palette_integrity(pixels.hsv_histogram(controls.desaturate(texture)))) == ["FAIL"]


def test_thread_is_found(spark):
    notes = spark.createDataFrame([(1, 140, 64)], "note_id int, img_w int, img_h int")
    found = lambda kind: checks.security_thread(notes, checks.threads(checks.thread_components(drawn(spark, kind))))
    assert statuses(found("line")) == ["PASS"] and statuses(found("blank")) == ["FAIL"]


def test_canonical_sizes_pass_and_a_stretched_note_fails(spark):
    notes = spark.createDataFrame([(k, d) for k, d in enumerate(DIMENSIONS_MM)] + [(99, "500"), (98, None)], "note_id int, denom string")
    sizes = [(k, w / h, "frame") for k, (w, h) in enumerate(DIMENSIONS_MM.values())] + [(99, 1.3 * 150 / 66, "frame"), (98, 2.0, "frame")]
    got = {r.note_id: r.status for r in geometry.proportions(notes, spark.createDataFrame(sizes, "note_id int, aspect double, measurement string")).collect()}
    assert got == {**{k: "PASS" for k in range(len(DIMENSIONS_MM))}, 99: "FAIL", 98: "INFO"}


def test_staged_tables_never_go_to_one_machine_of_a_cluster():
    class Session:
        def __init__(self, master, conf):
            self.sparkContext = type("Context", (), {"master": master})
            self.conf = type("Conf", (), {"get": staticmethod(lambda k, *d: conf[k] if k in conf else d[0])})

    with pytest.raises(ValueError):
        staging.shared_dir(Session("spark://a:7077", {"spark.sql.warehouse.dir": "file:/home/a/warehouse"}))
    assert staging.shared_dir(Session("spark://a:7077", {"spark.sql.warehouse.dir": "hdfs://n/w/"})) == "hdfs://n/w/_guilloche"
    assert staging.shared_dir(Session("yarn", {"spark.checkpoint.dir": "/mnt/shared/"})) == "file:///mnt/shared"
    assert staging.shared_dir(Session("local[4]", {})).startswith("file:///")


def test_runs_close_and_open_as_frames_do(spark):
    r = random.Random(3)
    rows = [(n, y, x, 40, int(r.random() < 0.55)) for n in (1, 2) for x in range(12) for y in range(40)]
    mask = spark.createDataFrame(rows, "note_id int, y int, x int, h int, m int")
    pixels = lambda runs: {(t.note_id, t.x, y) for t in runs.collect() for y in range(t.y0, t.y1 + 1)}
    for k in (4, 5, 7):
        runs = stencil.column_runs(mask, "m")
        for by_runs, by_frames in ((stencil.close_runs, stencil.close_down), (stencil.open_runs, stencil.open_down)):
            want = {(t.note_id, t.x, t.y) for t in by_frames(mask, "m", k).where("m > 0").collect()}
            assert pixels(by_runs(runs, F.lit(k))) == want


def test_components_of_any_width_and_many_heights(spark):
    wave = [(1, 20 + (x % 7), x) for x in range(500)] + [(1, 0, x) for x in range(0, 500, 3)]
    spiral = [(2, y, x) for y in range(41) for x in range(41) if (y % 4 == 0 and x <= 40) or (y % 4 == 2 and x == (40 if y % 8 == 2 else 0)) or (y % 4 in (1, 3) and x == (40 if y % 8 < 4 else 0))]
    mask = spark.createDataFrame([(*t, 60, 1) for t in wave + spiral], "note_id int, y int, x int, h int, m int")
    got = {(t.note_id, t.label_x, t.label_y): (t.x0, t.w, t.area) for t in stencil.components(mask, "m").collect()}

    def plain(points):
        left, out = set(points), {}
        while left:
            todo, part = [left.pop()], []
            while todo:
                y, x = todo.pop()
                part.append((x, y))
                for q in [(y + a, x + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]:
                    if q in left:
                        left.remove(q)
                        todo.append(q)
            xs = [x for x, _ in part]
            out[min(part)] = (min(xs), max(xs) - min(xs) + 1, len(part))
        return out

    want = {(n, *k): v for n, points in ((1, wave), (2, spiral)) for k, v in plain({(y, x) for _, y, x in points}).items()}
    assert got == want
    tall = spark.createDataFrame([(h, y, 0, h, int(y not in (10, 11))) for h in range(60, 260) for y in range(h)], "note_id int, y int, x int, h int, m int")
    closed = stencil.open_runs(stencil.close_runs(stencil.column_runs(tall, "m"), F.greatest(F.lit(15), F.floor(F.col("h") * 0.08).cast("int"))), F.lit(20))
    assert {t.note_id for t in closed.collect()} == set(range(60, 260))


def test_weak_edges_stay_to_the_end_of_a_chain(spark):
    ramp = drawn(spark, "blank").withColumns({c: F.when(F.col("x") < 70, 0).otherwise(F.when(F.col("y") < 2, 120).otherwise(30)) for c in "bgr"})
    gray = pixels.to_gray(ramp)
    assert {t.y for t in stencil.edges(gray).where("x between 69 and 70").collect()} >= set(range(3, 63))
    assert stencil.edges(gray, high=2000).count() == 0


def test_grey_and_alpha_images(spark):
    image = lambda c, data: (1, ("file:///real/10/1.png", 1, 2, c, 0, bytearray(data)))
    schema = "note_id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>"
    for c, data, want in ((1, [7, 9], [(7, 7, 7), (9, 9, 9)]), (4, [1, 2, 3, 255, 4, 5, 6, 0], [(1, 2, 3), (4, 5, 6)])):
        rows = images.to_pixels(spark.createDataFrame([image(c, data)], schema)).orderBy("x").collect()
        assert [(r.b, r.g, r.r) for r in rows] == want


def test_running_sums_by_ranges(spark):
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "a", None]), k, r.randrange(9)) for k in r.sample(range(5000), 900)]
    got = running(spark.createDataFrame(rows, "g string, k int, v int"), ["g"], [F.desc("k")], {"s": F.col("v"), "n": F.lit(1)}).collect()
    assert len(got) == 900
    for t in got:
        before = [v for g, k, v in rows if g == t.g and k >= t.k]
        assert (t.s, t.n) == (sum(before), len(before))


def test_screening_crops_the_note_and_measures_the_frame(spark):
    """A note of 220 by 96 with a thread, inside a plain frame; a blank one is never real."""
    w, h, x0, y0, nw, nh = 260, 130, 20, 17, 220, 96
    inside = F.col("x").between(x0, x0 + nw - 1) & F.col("y").between(y0, y0 + nh - 1)
    line = F.col("x").between(x0 + 108, x0 + 111)
    p = spark.range(w * h).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("note_id"), (F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), F.lit(w).alias("w"), F.lit(h).alias("h"))
    paint = lambda k: F.when((F.col("note_id") == 2) | ~inside, 128).when(line, 10).otherwise((F.col("x") * 7 * (k + 1) + F.col("y") * 13) % 256)
    frames = p.select("*", *[paint(k).cast("int").alias(c) for k, c in enumerate("bgr")])
    corner = [float(v) for v in (x0, y0, x0 + nw, y0, x0 + nw, y0 + nh, x0, y0 + nh)]
    contours = spark.createDataFrame([(1, 0, 4, w, h, *corner)], "note_id int, contour_id int, n_vertices int, img_w int, img_h int, " + ", ".join(f"{a}{k} double" for k in range(4) for a in "xy"))
    tokens = spark.createDataFrame([(1, 0, "500", 90, 5, 5, 20), (1, 1, "5AB", 80, 10, 60, 20), (1, 2, "123456", 80, 60, 60, 20)], "note_id int, seq int, text string, conf int, x int, y int, h int")
    blobs = spark.createDataFrame([], "note_id int, x int, y int, w int, h int, area double, strip_h int, strip_w int")
    faces = spark.createDataFrame([(1, 0, 50, 50)], "note_id int, face_id int, w int, h int")
    given = screening.Inputs(frames, tokens, blobs, contours, faces)
    got = {(r.note_id, r.check_name): r.status for r in screening.all_checks(given).collect()}
    assert len(got) == 22 and got[1, "security_thread_detection"] == "PASS" and got[1, "proportion_analysis"] == "PASS" and got[1, "structural_sanity"] == "PASS"
    assert got[1, "gandhi_face_analysis"] == got[1, "ocr_serial_number"] == got[1, "denomination_classification"] == "PASS"
    assert got[2, "structural_sanity"] == "FAIL" and got[2, "proportion_analysis"] == "INFO"
    scores = spark.createDataFrame([(1, 0.99), (2, 0.99)], "note_id int, raw double")
    answer = {r.note_id: r.prediction for r in screening.screen(given, scores).collect()}
    assert answer == {1: "REAL", 2: "FAKE"}
