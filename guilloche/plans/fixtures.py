"""Deterministic fixture views over the driver tables, in SQL that Spark and DuckDB share.

The screening operators take tables of notes, OCR tokens, blobs, contours, pixels, scores and
checks. These views derive such tables from the given ones, so that they grow with them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name -> SQL, in the order in which they build on each other. {nums7}, {nums8} and the like: as many integers from 0.
VIEWS = {
    "fx_notes": """
SELECT note_id, denom, grade, side, label, concat(label,'/',note_id,'.png') AS path,
  CASE WHEN grade='fake' THEN CASE q WHEN 0 THEN 'structural' WHEN 1 THEN 'content_degraded' ELSE 'digital_stretch' END END AS fake_type,
  CASE WHEN grade='fake' OR o_custkey % 5 = 0 THEN NULL ELSE concat(prefix, CASE WHEN o_custkey % 11 = 0 THEN '*' ELSE ' ' END, digits) END AS serial,
  prefix, digits
FROM (SELECT o_orderkey AS note_id, o_custkey,
  CASE o_orderkey % 7 WHEN 0 THEN '10' WHEN 1 THEN '20' WHEN 2 THEN '50' WHEN 3 THEN '100' WHEN 4 THEN '200' WHEN 5 THEN '500' ELSE '2000' END AS denom,
  CASE o_orderkey % 4 WHEN 0 THEN 'clean' WHEN 1 THEN 'phone' WHEN 2 THEN 'edge_case' ELSE 'fake' END AS grade,
  CASE o_custkey % 3 WHEN 0 THEN 'obverse' WHEN 1 THEN 'reverse' ELSE 'specimen' END AS side,
  CASE o_orderkey % 4 WHEN 3 THEN 'fake' ELSE 'real' END AS label,
  CAST(floor(o_orderkey / 4) AS INT) % 3 AS q,
  concat(o_orderkey % 10, chr(CAST(65 + o_orderkey % 26 AS INT)), chr(CAST(65 + o_custkey % 26 AS INT))) AS prefix,
  lpad(CAST((o_custkey * 37) % 1000000 AS STRING), 6, '0') AS digits
 FROM orders) t
""",
    "fx_tokens": """
SELECT note_id, k AS seq, CAST((note_id * 31 + k * 17) % 100 AS INT) AS conf,
 CASE k WHEN 0 THEN concat(prefix, ' ', digits) WHEN 1 THEN concat(prefix, translate(digits, '0158', 'OISB')) WHEN 2 THEN prefix WHEN 3 THEN digits
  WHEN 4 THEN CASE note_id % 5 WHEN 1 THEN concat('9', denom) WHEN 2 THEN concat('9', substr(denom, 2, 9)) ELSE denom END WHEN 5 THEN 'RBI' ELSE substr(prefix, 2, 2) END AS text,
 CASE k WHEN 0 THEN 40 WHEN 3 THEN 900 WHEN 4 THEN 50 WHEN 5 THEN 300 ELSE 820 END AS x,
 CASE k WHEN 0 THEN 60 WHEN 1 THEN 560 WHEN 2 THEN 560 + CAST(note_id % 9 AS INT) WHEN 3 THEN 560 + CAST(note_id % 5 AS INT) * 8 WHEN 4 THEN 540 WHEN 5 THEN 90 ELSE 566 END AS y,
 CASE k WHEN 1 THEN 30 WHEN 3 THEN 20 + CAST(note_id % 10 AS INT) WHEN 4 THEN 60 WHEN 5 THEN 12 ELSE 20 END AS h
FROM fx_notes CROSS JOIN (SELECT CAST(i AS INT) AS k FROM {nums7}) n
WHERE note_id % 13 <> 12 AND (k <> 1 OR note_id % 3 = 0) AND (k <> 4 OR note_id % 6 <> 5) AND (k <> 6 OR note_id % 2 = 0)
""",
    "fx_blobs": """
SELECT note_id, k * 22 - CASE WHEN l_partkey % 5 = 0 THEN 16 ELSE 0 END AS x, 60 - h + CASE WHEN l_suppkey % 3 = 0 THEN CAST(l_partkey % 4 AS INT) * 5 ELSE 0 END AS y, w, h, CAST(w * h AS DOUBLE) * (0.10 + l_discount * 8) AS area, 80 AS strip_h, 300 AS strip_w FROM (
 SELECT l_orderkey AS note_id, k, l_partkey, l_suppkey, l_discount, 10 + CAST(l_quantity AS INT) % 6 AS w,
  CASE WHEN l_orderkey % 17 = 0 THEN 16 + (k - 1) * 14 WHEN l_orderkey % 2 = 0 THEN 20 + k * 2 + CAST(l_quantity AS INT) % 2 ELSE 24 + CAST(l_quantity AS INT) % 3 END AS h
 FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS INT) AS k FROM lineitem) a) b
""",
    "fx_contours": """
SELECT c_custkey AS note_id, c AS contour_id, CASE WHEN (c_custkey + c) % 4 = 3 THEN 5 ELSE 4 END AS n_vertices, 1000 AS img_w, 700 AS img_h,
  x0, y0, x0 + w AS x1, y0 + s AS y1, x0 + w + s AS x2, y0 + h + s AS y2, x0 + s AS x3, y0 + h AS y3
FROM (SELECT c_custkey, c, CAST(20 + c * 15 AS DOUBLE) AS x0, CAST(30 + c * 10 AS DOUBLE) AS y0,
   CAST(300 + (c_custkey * 13 + c * 97) % 600 AS DOUBLE) AS w, CAST(150 + (c_custkey * 7 + c * 53) % 450 AS DOUBLE) AS h, CAST((c_custkey + c) % 9 AS DOUBLE) AS s
  FROM customer CROSS JOIN (SELECT CAST(i AS INT) AS c FROM {nums8}) n) t
""",
    "fx_pixels": """
SELECT note_id, y, x, 140 AS w, 64 AS h,
 CASE v WHEN 2 THEN CASE WHEN x BETWEEN 69 AND 71 THEN 20 ELSE 180 + (x * y) % 7 END WHEN 3 THEN (x * 3 + y * 5 + p * 17) % 256 WHEN 4 THEN CASE WHEN y >= 32 THEN 0 ELSE (x * 3 + y * 5 + p * 17) % 256 END WHEN 5 THEN 128 ELSE (x * 3 + y * 5 + p * 17) % 256 END AS b,
 CASE v WHEN 2 THEN CASE WHEN x BETWEEN 69 AND 71 THEN 20 ELSE 200 + (x + y) % 5 END WHEN 3 THEN (x * 3 + y * 5 + p * 17) % 256 WHEN 4 THEN CASE WHEN y >= 32 THEN 0 ELSE (x * 7 + y * 2 + p * 29) % 256 END WHEN 5 THEN 128 ELSE (x * 7 + y * 2 + p * 29) % 256 END AS g,
 CASE v WHEN 2 THEN CASE WHEN x BETWEEN 69 AND 71 THEN 20 ELSE 210 + (x * y) % 11 END WHEN 3 THEN (x * 3 + y * 5 + p * 17) % 256 WHEN 4 THEN CASE WHEN y >= 32 THEN 0 ELSE (x * 2 + y * 11 + p * 41) % 256 END WHEN 5 THEN 128 ELSE (x * 2 + y * 11 + p * 41) % 256 END AS r
FROM (SELECT s_suppkey AS note_id, CAST(s_suppkey AS INT) AS p, CAST(s_suppkey % 6 AS INT) AS v, CAST(floor(i / 140) AS INT) AS y, CAST(i % 140 AS INT) AS x
 FROM supplier CROSS JOIN {nums8960} n) t
""",
    "fx_drawn": """
SELECT note_id, denom, there, cos(turn) AS c, sin(turn) AS s, CAST(56 AS DOUBLE) AS half_w, 56 * high / (wide * stretch) AS half_h, 150 + CAST(note_id % 50 AS INT) AS shade
FROM (SELECT s_suppkey AS note_id, s_suppkey % 4 <> 3 AS there, radians(CAST((s_suppkey * 7) % 41 - 20 AS DOUBLE)) AS turn,
  CASE s_suppkey % 7 WHEN 0 THEN '10' WHEN 1 THEN '20' WHEN 2 THEN '50' WHEN 3 THEN '100' WHEN 4 THEN '200' WHEN 5 THEN '500' ELSE '2000' END AS denom,
  CAST(CASE s_suppkey % 7 WHEN 0 THEN 123 WHEN 1 THEN 129 WHEN 2 THEN 135 WHEN 3 THEN 142 WHEN 4 THEN 146 WHEN 5 THEN 150 ELSE 166 END AS DOUBLE) AS wide,
  CAST(CASE WHEN s_suppkey % 7 < 2 THEN 63 ELSE 66 END AS DOUBLE) AS high,
  CAST(CASE WHEN s_suppkey % 7 <> 6 AND s_suppkey % 3 = 1 THEN 1.3 ELSE 1 END AS DOUBLE) AS stretch FROM supplier) t
""",
    "fx_frames": """
SELECT note_id, y, x, 160 AS w, 120 AS h,
 CASE WHEN note THEN shade ELSE 30 + (x * 3 + y * 5) % 6 END AS b, CASE WHEN note THEN 190 ELSE 34 + (x + y) % 5 END AS g, CASE WHEN note THEN 210 ELSE 36 + (x * 2 + y) % 4 END AS r
FROM (SELECT note_id, y, x, shade, there AND abs((x - 80) * c + (y - 60) * s) <= half_w AND abs((y - 60) * c - (x - 80) * s) <= half_h AS note
 FROM (SELECT d.*, CAST(floor(i / 160) AS INT) AS y, CAST(i % 160 AS INT) AS x FROM fx_drawn d CROSS JOIN {nums19200} n) p) q
""",
    "fx_scores": """
SELECT note_id, label, CAST(CASE WHEN label = 'real' THEN 250 + (note_id * 7919) % 750 ELSE (note_id * 7919) % 700 END AS DOUBLE) / CAST(1000 AS DOUBLE) AS raw FROM fx_notes
""",
    "fx_checks": """
SELECT note_id, check_name, CASE WHEN z < t THEN 'PASS' WHEN z < 9 THEN 'FAIL' ELSE 'INFO' END AS status FROM (
 SELECT note_id, check_name, (note_id * 7 + k * 13 + CAST(floor(note_id / 11) AS INT)) % 10 AS z, CASE WHEN label = 'real' THEN 8 ELSE 4 END AS t
 FROM fx_notes CROSS JOIN (SELECT 0 AS k, 'structural_sanity' AS check_name UNION ALL SELECT 1, 'uv_light_detection' UNION ALL SELECT 2, 'watermark_detection' UNION ALL SELECT 3, 'ocr_serial_number' UNION ALL SELECT 4, 'gandhi_face_analysis' UNION ALL SELECT 5, 'security_thread_detection' UNION ALL SELECT 6, 'serial_typography_analysis' UNION ALL SELECT 7, 'hologram_detection' UNION ALL SELECT 8, 'denomination_classification' UNION ALL SELECT 9, 'proportion_analysis') c) t
UNION ALL SELECT note_id, 'modular_ai_pipeline', 'PASS' FROM fx_notes
""",
    "fx_palette_stats": """
SELECT note_id, CAST((note_id * 7) % 180 AS DOUBLE) AS med_hue, CAST((note_id * 11) % 256 AS DOUBLE) AS med_sat, (note_id * 3) % 1000 AS coloured_px, 8960 AS total_px FROM fx_notes
""",
    "fx_faces": """
SELECT note_id, CAST(k AS INT) AS face_id, CAST(20 + (note_id * 3 + k * 19) % 60 AS INT) AS w, CAST(20 + (note_id * 3 + k * 19) % 60 AS INT) AS h FROM fx_notes CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) c WHERE (note_id + k) % 3 <> 0
""",
    "fx_signals": """
SELECT event_id AS sample_id, CASE WHEN user_id % 2 = 0 THEN 'real' ELSE 'fake' END AS label, CASE WHEN event_type IN ('error', 'signup') THEN concat('fake/', event_type) ELSE event_type END AS bucket, value AS signal FROM events
""",
}
BASE = {"orders", "lineitem", "customer", "part", "supplier", "events", "documents", "labels", "embeddings"}


#: What a view makes rows of by the thousand, with its key; and about how many such rows a task makes.
DEALT, ROWS = {"supplier": "s_suppkey"}, 1 << 19

#: What is the note_id of the views of a table.
NOTES = {"supplier": "s_suppkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "customer": "c_custkey"}


def _needs(name: str) -> list[str]:
    """The view and the views it builds on, in order."""
    sql = VIEWS[name]
    before = [v for v in VIEWS if v != name and f"FROM {v}" in sql]
    return [*dict.fromkeys(x for v in before for x in _needs(v)), name]


def _fill(sql: str, numbers: str) -> str:
    return re.sub(r"\{nums(\d+)\}", lambda m: numbers.format(m[1]), sql).strip()


def _dealt(table: DataFrame, key: str, times: int) -> DataFrame:
    """A table dealt out by its key, to as many tasks as the ``times`` as many rows need that a view makes of it.

    Its file, small as it is, would be one task; and what is dealt out by note need not be again.
    """
    tasks = -(-table.count() * times // ROWS)
    return table.repartition(max(tasks, table.sparkSession.sparkContext.defaultParallelism), key)


def load(spark: SparkSession, sf_dir: str, name: str, *, of: DataFrame | None = None) -> DataFrame:
    """A driver table or a fixture view as a DataFrame; with ``of`` a view's rows of these notes alone.

    Rows of other notes go before the view is made: its numbering of rows would shuffle them.
    """
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    views = _needs(name)
    for table in sorted(BASE):
        if any(re.search(rf"FROM {table}\b", VIEWS[v]) for v in views):
            rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            if of is not None:
                rows = rows.join(of.select(F.col("note_id").alias(NOTES[table])), NOTES[table], "left_semi")
            times = [int(n) for v in views for n in re.findall(r"\{nums(\d+)\}", VIEWS[v])]
            (_dealt(rows, DEALT[table], max(times)) if table in DEALT and times else rows).createOrReplaceTempView(table)
    for view in views:
        spark.sql(_fill(VIEWS[view], "(SELECT /*+ BROADCAST(numbers) */ id AS i FROM range({}) numbers)")).createOrReplaceTempView(view)
    return spark.table(name)


def oracle(body: str, *views: str) -> str:
    """DuckDB SQL of a query: the views it needs as common table expressions before its own ``body``."""
    names = list(dict.fromkeys(x for v in views for x in _needs(v)))
    ctes = [f"{n} AS MATERIALIZED (\n{_fill(VIEWS[n], '(SELECT range AS i FROM range({}))')}\n)" for n in names]
    body = body.strip()
    own = not body.upper().startswith("SELECT")
    if not ctes:
        return ("WITH RECURSIVE " if own else "") + body
    return "WITH RECURSIVE " + ",\n".join(ctes) + (",\n" if own else "\n") + body
