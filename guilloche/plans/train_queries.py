"""Queries and oracle SQL of training, scoring and streaming work."""

from __future__ import annotations

from pyspark.sql import functions as F

from guilloche.operators import train as M
from guilloche.operators import verdict as V
from guilloche.staging import new_path, stage
from guilloche.streaming.screen import arriving, screen_stream

from .fixtures import load, oracle


def _vectors(spark, d):
    from pyspark.ml.functions import array_to_vector

    e = load(spark, d, "embeddings")
    key = e.columns[0]
    vec = next(f.name for f in e.schema.fields if f.dataType.simpleString().startswith("array"))
    return e.select(F.col(key).alias("note_id"), (F.col("label") >= 5).cast("double").alias("label"), array_to_vector(F.col(vec).cast("array<double>")).alias("features"))


def _labelled(spark, d):
    return load(spark, d, "fx_scores").select("note_id", F.when(F.col("label") == "real", 1).otherwise(0).alias("label"), "raw")


def m1(spark, d):
    from pyspark.ml.functions import vector_to_array

    px = load(spark, d, "fx_pixels")
    labels = px.select("note_id", F.when(F.col("note_id") % 4 == 3, "fake").otherwise("real").alias("label")).distinct()
    vectors = M.feature_vectors(px, labels).withColumn("a", vector_to_array("features"))
    return vectors.select("note_id", "label", F.posexplode("a").alias("at", "v")).select("note_id", "label", "at", F.round("v", 6).alias("v"))


def m2(spark, d):
    return M.stratified_split(load(spark, d, "fx_scores"), "label", "note_id").select("note_id", "label", "held_out")


def m3(spark, d):
    return M.validation_split(load(spark, d, "fx_notes").select("note_id", "label", "path"), "label", "path")


def m4(spark, d):
    return M.augment(load(spark, d, "fx_pixels"), copies=1)


def _split_vectors(spark, d):
    """Vectors to fit on, and held-out ones to score."""
    rows = M.stratified_split(_vectors(spark, d), "label", "note_id")
    return rows.where("NOT held_out").drop("held_out"), rows.where("held_out").drop("held_out")


def m5(spark, d):
    """What a fitted classifier says of held-out vectors: how many it hits, by label."""
    fitted_on, rows = _split_vectors(spark, d)
    one = M.score(M.fit_classifier(fitted_on), rows)
    return one.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(F.when((F.col("raw") >= 0.5) == (F.col("label") == 1), 1.0).otherwise(0.0)), 3).alias("accuracy"))


def m6(spark, d):
    fitted_on, rows = _split_vectors(spark, d)
    return M.score(M.fit_classifier(fitted_on), rows).select("note_id", "label", F.round("raw", 6).alias("raw"))


def m6_layers(spark, d):
    fitted_on, rows = _split_vectors(spark, d)
    return M.score(M.fit_classifier(fitted_on, hidden=16, max_iter=20), rows).select("note_id", "label", F.round("raw", 6).alias("raw"))


def _image_rows(spark, d):
    """Vectors of all images, a fifth of each label for validation."""
    px = load(spark, d, "fx_pixels")
    labels = px.select("note_id", F.when(F.col("note_id") % 4 == 3, "fake").otherwise("real").alias("label")).distinct()
    held = M.validation_split(labels, "label", "note_id").select("note_id", "validation")
    return stage(M.feature_vectors(px, labels).join(held, "note_id"), "image-rows")


def _history(spark, fitted):
    return spark.createDataFrame(fitted.history, "round int, train_loss double, val_loss double, train_acc double, val_acc double")


def m5_rounds(spark, d):
    """Losses and accuracies of both sides after each round of a training on images, and which round is kept."""
    fitted = M.fit_rounds(_image_rows(spark, d), rounds=4, passes=3)
    return _history(spark, fitted).select("round", *[F.round(c, 6).alias(c) for c in ("train_loss", "val_loss", "train_acc", "val_acc")], (F.col("round") == fitted.best).alias("kept"))


def m6_held_out(spark, d):
    """Chance of each held-out image by the best round's weights."""
    rows = _image_rows(spark, d)
    return M.score_rounds(M.fit_rounds(rows, rounds=4, passes=3), rows.where("validation")).select("note_id", "label", F.round("raw", 6).alias("raw"))


def m10_rounds(spark, d):
    """The fit of each round of a real training."""
    fitted = M.fit_rounds(_image_rows(spark, d), rounds=4, passes=3)
    return M.diagnosis(_history(spark, fitted)).select("round", F.round("train_acc", 6).alias("train_acc"), F.round("val_acc", 6).alias("val_acc"), "diagnosis")


def m7(spark, d):
    return M.roc(_labelled(spark, d)).select("threshold", F.round("tpr", 6).alias("tpr"), F.round("fpr", 6).alias("fpr"))


def m8(spark, d):
    return M.auc(M.roc(_labelled(spark, d))).select(F.round("auc", 6).alias("auc"))


def _splits(spark, d):
    return M.accuracy_loss(_labelled(spark, d).withColumn("split", F.when(F.col("note_id") % 5 == 0, "val").otherwise("train")), "split")


def m9(spark, d):
    return _splits(spark, d).select("split", "n", F.round("accuracy", 6).alias("accuracy"), F.round("log_loss", 6).alias("log_loss"))


def m10(spark, d):
    a = _labelled(spark, d).groupBy((F.col("note_id") % 7).alias("model")).agg(*[F.avg(F.when(side, F.when((F.col("raw") >= cut) == (F.col("label") == 1), 1.0).otherwise(0.0))).alias(n) for n, side, cut in (("train_acc", F.col("note_id") % 5 != 0, 0.5), ("val_acc", F.col("note_id") % 5 == 0, 0.7))])
    return M.diagnosis(a).select("model", F.round("train_acc", 6).alias("train_acc"), F.round("val_acc", 6).alias("val_acc"), "diagnosis")


def s8(spark, d):
    """Verdicts without a model for checks that arrive as files, read back from the sink."""
    base = new_path(spark, "stream")
    load(spark, d, "fx_checks").repartition(4, "note_id").write.parquet(f"{base}/in")
    schema = spark.read.parquet(f"{base}/in").schema
    query = screen_stream(spark, arriving(spark, f"{base}/in", schema, files_per_batch=2), lambda rows: V.verdict_without_model(V.forensic_score(rows)).select("note_id", "verdict"), f"{base}/out", f"{base}/state")
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(f"{base}/out").select("note_id", "verdict")


QUERIES = {
    "m1_feature_vectors": m1, "m2_stratified_split": m2, "m3_validation_split": m3, "m4_augment": m4, "m5_classifier": m5, "m6_scored": m6, "m6_scored_layers": m6_layers, "m7_roc": m7, "m8_auc": m8, "m9_accuracy_loss": m9, "m10_fit_diagnosis": m10, "s8_stream_verdicts": s8,
    "m5_training_rounds": m5_rounds, "m6_held_out_scores": m6_held_out, "m10_rounds_diagnosis": m10_rounds,
}

_L = "l AS (SELECT note_id, CASE WHEN label = 'real' THEN 1 ELSE 0 END AS label, raw FROM fx_scores)"
_ROC = _L + """,
c AS (SELECT raw AS threshold, sum(label) AS p, sum(1 - label) AS n FROM l GROUP BY raw),
r AS (SELECT threshold, sum(p) OVER u / sum(p) OVER () AS tpr, sum(n) OVER u / sum(n) OVER () AS fpr FROM c WINDOW u AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))"""

_UNIT = "(('0x' || substr(m, {at}, 6))::BIGINT / 8388608.0::DOUBLE - 1)"
_TURN = "CAST(floor(round({c} + ({a}) / zoom, 6) + 0.5) AS INT)"
_AUGMENT = f"""p AS (SELECT DISTINCT note_id, w, h, md5(concat_ws(':', note_id, 1, 42)) AS m FROM fx_pixels),
q AS (SELECT note_id, w, h, radians(20 * {_UNIT.format(at=1)}) AS angle, 1 + 0.2::DOUBLE * {_UNIT.format(at=7)} AS zoom, 0.2::DOUBLE * {_UNIT.format(at=13)} * w AS sx, 0.2::DOUBLE * {_UNIT.format(at=19)} * h AS sy, {_UNIT.format(at=25)} > 0 AS flip FROM p),
g AS (SELECT q.*, CAST(x.i AS INT) AS x, CAST(y.i AS INT) AS y, (w - 1) / 2 AS cx, (h - 1) / 2 AS cy FROM q, range(140) x(i), range(64) y(i)),
d AS (SELECT *, CASE WHEN flip THEN -(x - cx) ELSE x - cx END - sx AS dx, y - cy - sy AS dy FROM g),
s AS (SELECT note_id, y, x, w, h, {_TURN.format(c='cx', a='dx * cos(angle) + dy * sin(angle)')} AS tx, {_TURN.format(c='cy', a='dy * cos(angle) - dx * sin(angle)')} AS ty FROM d)
SELECT s.note_id, 1 AS copy, s.y, s.x, s.w, s.h, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM s LEFT JOIN fx_pixels f ON f.note_id = s.note_id AND f.y = ty AND f.x = tx"""


def _training(rounds: int, passes: int, ridge: str = "0.01::DOUBLE") -> str:
    """The steps of a training as one table after the other: w<k> are the weights after step k, h the history."""
    out = ["""c AS MATERIALIZED (SELECT note_id, y * 16 // h AS gy, x * 16 // w AS gx, avg(b) / 255 AS b, avg(g) / 255 AS g, avg(r) / 255 AS r FROM fx_pixels GROUP BY ALL),
f AS MATERIALIZED (SELECT note_id, CAST((gy * 16 + gx) * 3 + k AS INT) AS pos, CASE k WHEN 0 THEN b WHEN 1 THEN g ELSE r END AS v FROM c, (VALUES (0), (1), (2)) t(k) UNION ALL SELECT DISTINCT note_id, 768, 1.0::DOUBLE FROM c),
n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY y ORDER BY note_id) <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY y)) AS held FROM (SELECT DISTINCT note_id, CASE WHEN note_id % 4 = 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS y FROM c)),
q AS MATERIALIZED (SELECT count(DISTINCT note_id) AS many, 1 / (sum(v * v) / count(DISTINCT note_id) / 4 + """ + ridge + """) AS step FROM f JOIN n USING (note_id) WHERE NOT held),
w0 AS MATERIALIZED (SELECT DISTINCT pos, 0.0::DOUBLE AS w, 0.0::DOUBLE AS u FROM f)"""]
    for k in range(rounds * passes):
        out.append(f"""z{k} AS MATERIALIZED (SELECT note_id, 1 / (1 + exp(-sum(v * u))) - any_value(y) AS e FROM f JOIN w{k} USING (pos) JOIN n USING (note_id) WHERE NOT held GROUP BY note_id),
w{k + 1} AS MATERIALIZED (SELECT pos, now AS w, now + {k}.0::DOUBLE / {k + 3} * (now - w) AS u FROM (SELECT pos, any_value(w) AS w, any_value(u) - any_value(step) * (sum(v * e) / any_value(many) + CASE WHEN pos < 768 THEN {ridge} ELSE 0 END * any_value(u)) AS now FROM f JOIN z{k} USING (note_id) JOIN w{k} USING (pos), q GROUP BY pos))""")
    parts = [f"SELECT {k} AS round, note_id, sum(v * w) AS z FROM f JOIN w{k * passes} USING (pos) GROUP BY note_id" for k in range(1, rounds + 1)]
    out.append("p AS MATERIALIZED (" + " UNION ALL ".join(parts) + ")")
    of = lambda what, side: f"avg({what}) FILTER ({side} held)"
    loss, hit = "ln(1 + exp(z)) - y * z", "CASE WHEN (z >= 0) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    out.append(f"h AS MATERIALIZED (SELECT round, {of(loss, 'NOT')} AS train_loss, {of(loss, '')} AS val_loss, {of(hit, 'NOT')} AS train_acc, {of(hit, '')} AS val_acc FROM p JOIN n USING (note_id) GROUP BY round)")
    out.append("best AS (SELECT arg_min(round, (coalesce(val_loss, train_loss), round)) AS kept FROM h)")
    return ",\n".join(out) + "\n"


ORACLE_SQL = {
    "m5_training_rounds": oracle(_training(4, 3) + "SELECT round, round(train_loss, 6) AS train_loss, round(val_loss, 6) AS val_loss, round(train_acc, 6) AS train_acc, round(val_acc, 6) AS val_acc, round = kept AS kept FROM h, best", "fx_pixels"),
    "m6_held_out_scores": oracle(_training(4, 3) + "SELECT note_id, y AS label, round(1 / (1 + exp(-z)), 6) AS raw FROM p JOIN n USING (note_id) JOIN best ON round = kept WHERE held", "fx_pixels"),
    "m10_rounds_diagnosis": oracle(_training(4, 3) + "SELECT round, round(train_acc, 6) AS train_acc, round(val_acc, 6) AS val_acc, CASE WHEN train_acc < 0.75 AND val_acc < 0.75 THEN 'UNDERFITTED' WHEN train_acc > val_acc AND train_acc - val_acc > 0.10 THEN 'OVERFITTED' ELSE 'WELL FITTED' END AS diagnosis FROM h", "fx_pixels"),
    "m1_feature_vectors": oracle("g AS (SELECT note_id, y * 16 // h AS gy, x * 16 // w AS gx, avg(b) / 255 AS b, avg(g) / 255 AS g, avg(r) / 255 AS r FROM fx_pixels GROUP BY ALL) SELECT note_id, CASE WHEN note_id % 4 = 3 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS label, CAST((gy * 16 + gx) * 3 + k AS INT) AS at, round(CASE k WHEN 0 THEN b WHEN 1 THEN g ELSE r END, 6) AS v FROM g, (VALUES (0), (1), (2)) c(k)", "fx_pixels"),
    "m4_augment": oracle(_AUGMENT, "fx_pixels"),
    "m2_stratified_split": oracle("SELECT note_id, label, row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws(':', note_id, 42)), note_id) <= ceil(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS held_out FROM fx_scores", "fx_scores"),
    "m3_validation_split": oracle("SELECT note_id, label, path, row_number() OVER (PARTITION BY label ORDER BY path) <= floor(0.2::DOUBLE * count(*) OVER (PARTITION BY label)) AS validation FROM fx_notes", "fx_notes"),
    "m7_roc": oracle(_ROC + "SELECT threshold, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM r", "fx_scores"),
    "m8_auc": oracle(_ROC + "SELECT round(sum(a), 6) AS auc FROM (SELECT (fpr - lag(fpr, 1, 0) OVER w) * (tpr + lag(tpr, 1, 0) OVER w) / 2 AS a FROM r WINDOW w AS (ORDER BY threshold DESC))", "fx_scores"),
    "m9_accuracy_loss": oracle(_L + ", s AS (SELECT CASE WHEN note_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, label, raw, least(greatest(raw, 1e-7), 1 - 1e-7) AS p FROM l) SELECT split, count(*) AS n, round(avg(CASE WHEN (raw >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(-CASE WHEN label = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss FROM s GROUP BY split", "fx_scores"),
    "m10_fit_diagnosis": oracle(_L + ", a AS (SELECT note_id % 7 AS model, avg(CASE WHEN (raw >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END) FILTER (note_id % 5 <> 0) AS t, avg(CASE WHEN (raw >= 0.7::DOUBLE) = (label = 1) THEN 1.0 ELSE 0.0 END) FILTER (note_id % 5 = 0) AS v FROM l GROUP BY ALL) SELECT model, round(t, 6) AS train_acc, round(v, 6) AS val_acc, CASE WHEN t < 0.75 AND v < 0.75 THEN 'UNDERFITTED' WHEN t > v AND t - v > 0.10 THEN 'OVERFITTED' ELSE 'WELL FITTED' END AS diagnosis FROM a", "fx_scores"),
    "s8_stream_verdicts": oracle("f AS (SELECT note_id, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status = 'PASS') AS p, count(*) FILTER (check_name <> 'modular_ai_pipeline' AND status IN ('PASS', 'FAIL')) AS t, bool_or(check_name = 'structural_sanity' AND status = 'FAIL') AS sf, bool_or(check_name = 'hologram_detection' AND status = 'FAIL') AS pf FROM fx_checks GROUP BY note_id) SELECT note_id, CASE WHEN sf THEN 'FAKE' WHEN p / greatest(t, 1) >= 0.65 AND p >= 5 AND NOT pf THEN 'REAL' WHEN p / greatest(t, 1) < 0.35 THEN 'FAKE' ELSE 'SUSPICIOUS' END AS verdict FROM f", "fx_checks"),
}
