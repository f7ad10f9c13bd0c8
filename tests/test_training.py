"""Training rounds with held-out rows."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from guilloche.operators import train


def table(spark, x, y, held):
    rows = [(k, [float(v) for v in a], float(b), bool(c), "z") for k, (a, b, c) in enumerate(zip(x, y, held))]
    rows += [(-1, None, 1.0, False, "z"), (-2, [9.0] * len(x[0]), None, False, "z"), (-3, [9.0] * len(x[0]), 1.0, None, "z")]
    df = spark.createDataFrame(rows, "note_id int, a array<double>, label double, validation boolean, x string")
    return df.withColumn("features", F.when(F.col("a").isNotNull(), array_to_vector("a"))).repartition(3)


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(240, 5))
    y = (x @ [2, -1, 0, 0.5, 1] + r.normal(size=240) > 0.3).astype(float)
    held = np.arange(240) % 4 == 0
    return x, y, held, table(spark, x, y, held).cache()


def test_long_trainings_reach_the_optimum_of_the_ridge_loss(rows):
    x, y, held, df = rows
    fitted = train.fit_rounds(df, rounds=6, passes=40, patience=9)
    w, one = fitted.weights, np.column_stack([x, np.ones(len(x))])[~held]
    gradient = one.T @ (1 / (1 + np.exp(-one @ w)) - y[~held]) / len(one) + np.append(np.full(5, 0.01), 0) * w
    assert np.abs(gradient).max() < 1e-3 and 1 <= fitted.best <= 6
    losses = [h["train_loss"] for h in fitted.history]
    assert losses[0] > losses[-1] and all(h["val_acc"] > 0.8 for h in fitted.history[2:])
    got = {r.note_id: r.raw for r in train.score_rounds(fitted, df).collect()}
    assert got[-1] is None and len(got) == len(x) + 3
    assert np.allclose([got[k] for k in range(len(x))], 1 / (1 + np.exp(-np.column_stack([x, np.ones(len(x))]) @ w)))


def test_the_best_round_stays_and_patience_ends_a_training(spark):
    """Held-out labels that contradict the others: the loss there only grows."""
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 2))
    held = np.arange(60) % 3 == 0
    y = np.where(held, x[:, 0] < 0, x[:, 0] > 0).astype(float)
    fitted = train.fit_rounds(table(spark, x, y, held), rounds=9, passes=2, patience=2)
    assert fitted.best == 1 and [h["round"] for h in fitted.history] == [1, 2, 3]
    losses = [h["val_loss"] for h in fitted.history]
    assert losses == sorted(losses)


def test_without_rows_and_without_held_out_rows(spark, rows):
    df = rows[3]
    none = train.fit_rounds(df.limit(0))
    assert none.history == [] and {r.raw for r in train.score_rounds(none, df).select("raw").collect()} == {0.5}
    alone = train.fit_rounds(df.withColumn("validation", F.lit(False)), rounds=2, passes=2)
    assert [h["val_loss"] for h in alone.history] == [None, None] and alone.best == 2


def test_turned_copies_are_made_in_tiles_without_a_join(spark):
    """Two images of several tiles, one of which lacks pixels and a whole tile, against the sources that SQL finds."""
    px = spark.range(2).selectExpr("id AS note_id").crossJoin(spark.range(300 * 140).selectExpr("CAST(id div 300 AS INT) AS y", "CAST(id % 300 AS INT) AS x"))
    px = px.selectExpr("*", "300 AS w", "140 AS h", "CAST((x * 3 + y * 5 + note_id) % 256 AS INT) AS b", "IF(x % 7 = 0, NULL, x) AS g", "y AS r").where("note_id = 0 OR x < 256 AND NOT (x = 100 AND y < 90)")
    made = train.augment(px, copies=2)
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString().replace("Join Cross", "")
    px.createOrReplaceTempView("px_of_copies")
    unit = lambda at: f"(CAST(conv(substr(m, {at}, 6), 16, 10) AS BIGINT) / 8388608D - 1)"
    turn = lambda c, a: f"CAST(floor(round({c} + ({a}) / zoom, 6) + 0.5D) AS INT)"
    want = spark.sql(f"""WITH p AS (SELECT *, md5(concat_ws(':', note_id, copy, 42)) AS m FROM (SELECT DISTINCT note_id, w, h FROM px_of_copies), (SELECT explode(array(1, 2)) AS copy)),
      q AS (SELECT *, radians(20 * {unit(1)}) AS angle, 1 + 0.2D * {unit(7)} AS zoom, 0.2D * {unit(13)} * w AS sx, 0.2D * {unit(19)} * h AS sy, {unit(25)} > 0 AS flip FROM p),
      g AS (SELECT *, CAST(id % 300 AS INT) AS x, CAST(id div 300 AS INT) AS y, (w - 1) / 2D AS cx, (h - 1) / 2D AS cy FROM q, range(42000)),
      d AS (SELECT *, IF(flip, -(x - cx), x - cx) - sx AS dx, y - cy - sy AS dy FROM g),
      s AS (SELECT *, {turn("cx", "dx * cos(angle) + dy * sin(angle)")} AS tx, {turn("cy", "dy * cos(angle) - dx * sin(angle)")} AS ty FROM d)
      SELECT s.note_id, copy, s.y, s.x, s.w, s.h, coalesce(b, 0) AS b, coalesce(g, 0) AS g, coalesce(r, 0) AS r FROM s LEFT JOIN px_of_copies f ON f.note_id = s.note_id AND f.y = ty AND f.x = tx""")
    assert made.columns == want.columns and made.count() == 2 * 2 * 42000
    assert made.exceptAll(want).isEmpty() and want.exceptAll(made).isEmpty()
