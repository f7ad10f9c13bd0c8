"""Training and scoring data work."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guilloche.functions.portable import digits, scatter
from guilloche.staging import stage

from . import tiles as T
from .geometry import blocks
from .pixels import block_means
from .ranges import running


def feature_vectors(pixels: DataFrame, labels: DataFrame, *, grid: int = 16) -> DataFrame:
    """(note_id, label 0 or 1, features): the image on a fixed grid, in row order, channels b, g, r."""
    from pyspark.ml.functions import array_to_vector

    cells = block_means(pixels, grid=grid)
    rows = cells.groupBy("note_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("gy", "gx", "b", "g", "r"))), lambda c: F.array(c["b"], c["g"], c["r"]))).alias("a"))
    return rows.join(labels.select("note_id", F.when(F.col("label") == "real", 1.0).otherwise(0.0).alias("label")), "note_id").select("note_id", "label", array_to_vector("a").alias("features"))


def stratified_split(rows: DataFrame, label: str, key: str, *, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``held_out``: the first ``share`` of each label in the order of a seeded hash of the key, rounded up."""
    hashed = rows.withColumn("_h", scatter(key, seed=seed))
    ranked = running(hashed, [label], [F.col("_h"), F.col(key)], {"_k": F.lit(1)})
    return _first_share(ranked, label, "held_out", lambda n: F.ceil(F.lit(share) * n)).drop("_h")


def validation_split(rows: DataFrame, label: str, order: str, *, share: float = 0.2) -> DataFrame:
    """Add ``validation``: the first ``share`` of each label by ``order``, rounded down."""
    ranked = running(rows, [label], [F.col(order)], {"_k": F.lit(1)})
    return _first_share(ranked, label, "validation", lambda n: F.floor(F.lit(share) * n))


def _first_share(ranked: DataFrame, label: str, name: str, many) -> DataFrame:
    """Whether the rank ``_k`` of a row is among the first of its label; labels are few."""
    sizes = ranked.groupBy(F.col(label).alias("_label")).agg(F.count("*").alias("_n"))
    return ranked.join(sizes, F.col(label).eqNullSafe(F.col("_label"))).withColumn(name, F.col("_k") <= many(F.col("_n"))).drop("_k", "_n", "_label")


def augment(pixels: DataFrame, *, copies: int = 2, seed: int = 42) -> DataFrame:
    """``copies`` of each image, turned up to 20 degrees, zoomed and shifted up to a fifth, maybe flipped.

    Parameters come from a seeded hash of note and copy; each target pixel takes the nearest
    source pixel, and is black where there is none. It is made in the tile that holds its
    source, or lies next to it, so that nothing is joined; a tile without pixels makes black ones.
    """
    u = lambda s, k: digits(s, 6 * k, 6) / F.lit(8388608.0) - 1

    def drawn(copy):
        s = scatter("note_id", copy, seed=seed)
        angle = F.radians(20 * u(s, 0))
        return F.struct(copy.alias("copy"), F.cos(angle).alias("cos"), F.sin(angle).alias("sin"), (1 + 0.2 * u(s, 1)).alias("zoom"), (0.2 * u(s, 2) * F.col("w")).alias("sx"), (0.2 * u(s, 3) * F.col("h")).alias("sy"), (u(s, 4) > 0).alias("flip"))

    def turned(t: T.Tile, turns: list[dict]) -> dict[str, np.ndarray]:
        cx, cy = (t.w - 1) / 2, (t.h - 1) / 2
        near = lambda a: np.floor(np.round(a, 6) + 0.5).astype(int)
        found = [[np.empty(0, int)] * 6]
        for m in turns:

            def place(i, j):
                dx, dy = (-(i - cx) if m["flip"] else i - cx) - m["sx"], j - cy - m["sy"]
                return near(cx + (dx * m["cos"] + dy * m["sin"]) / m["zoom"]), near(cy + (dy * m["cos"] - dx * m["sin"]) / m["zoom"])

            def beside(i, j):
                x, y = place(i, j)
                return np.clip(x, 0, t.w - 1), np.clip(y, 0, t.h - 1), np.full(x.shape, True)

            for i, j in blocks(t.w, t.h, beside, t):
                x, y = place(i, j)
                there = (x >= 0) & (x < t.w) & (y >= 0) & (y < t.h)
                x, y = np.clip(x, 0, t.w - 1) - t.x0, np.clip(y, 0, t.h - 1) - t.y0
                own = (x >= 0) & (x < t.cols) & (y >= 0) & (y < t.rows)
                i, j, x, y, there = (v[own] for v in (i, j, x, y, there))
                found.append([np.full(len(i), m["copy"]), j, i, *(np.where(there, t.values[c][y, x], 0) for c in "bgr")])
        copy, j, i, b, g, r = (np.concatenate(v) for v in zip(*found))
        return {"copy": copy, "y": j, "x": i, "w": np.full(len(i), t.w), "h": np.full(len(i), t.h), "b": b, "g": g, "r": r}

    tiles = T.cut(pixels, ("b", "g", "r"), (0, 0))
    tiles = tiles.unionByName(T.empty(pixels, tiles)).withColumn("turns", F.transform(F.sequence(F.lit(1), F.lit(copies)), drawn))
    return T.on_tiles(tiles, turned, "copy int, y int, x int, w int, h int, b int, g int, r int", (0, 0), more=("turns",))


def fit_classifier(rows: DataFrame, *, hidden: int | None = None, max_iter: int = 50):
    """A sigmoid over the feature vector; with ``hidden`` a layer of that many units before it."""
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier

    if hidden is None:
        return LogisticRegression(maxIter=max_iter, regParam=0.01).fit(rows)
    size = len(rows.select("features").first()[0])
    return MultilayerPerceptronClassifier(layers=[size, hidden, 2], maxIter=max_iter, seed=42).fit(rows)


def score(model, rows: DataFrame) -> DataFrame:
    """Add ``raw``: the model's chance of class 1."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn("raw", vector_to_array("probability")[1])


@dataclass
class Rounds:
    """What a training left: a row for each round, the weights of the best one (the last of them for the constant) and its number."""

    history: list[dict]
    weights: np.ndarray
    best: int


def _array(features: str):
    """A vector as an array; null stays null."""
    from pyspark.ml.functions import vector_to_array

    return F.when(F.col(features).isNotNull(), vector_to_array(features))


def _pass(data: DataFrame, ahead: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over (features, label, validation): the gradient's sum over training rows at ``ahead``, and rows, loss and hits of training and validation rows at ``now``.

    Each task adds up its rows; the sums, as many as there are weights, are added by place.
    """

    def sums(batches):
        total = np.zeros(len(now) + 6)
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(0).flatten().to_numpy().reshape(b.num_rows, -1), np.ones(b.num_rows)])
            y, held = b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            slope = 1 / (1 + np.exp(-(x @ ahead))) - y
            total[: len(now)] += slope[~held] @ x[~held]
            z = x @ now
            loss, hit = np.logaddexp(0, z) - y * z, (z >= 0) == (y == 1)
            for k, some in ((0, ~held), (3, held)):
                total[len(now) + k : len(now) + k + 3] += some.sum(), loss[some].sum(), hit[some].sum()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["a"])

    out = np.zeros(len(now) + 6)
    for r in data.mapInArrow(sums, "a array<double>").select(F.posexplode("a")).groupBy("pos").agg(F.sum("col").alias("s")).collect():
        out[r["pos"]] = r["s"]
    return out[: len(now)], out[len(now) :].reshape(2, 3)


def fit_rounds(rows: DataFrame, *, rounds: int = 10, passes: int = 5, ridge: float = 0.01, patience: int = 3) -> Rounds:
    """A sigmoid over ``features``, fitted to rows that are not ``validation`` by accelerated gradient steps, ``passes`` to a round.

    Each round goes on from the one before. After it log-loss and accuracy of both sides are
    noted; the weights of the least validation loss stay, and training ends when ``patience``
    rounds brought none less. The ridge spares the constant. The step follows from the mean
    square of the training rows. Rows with a null in features, label or validation are left
    out; without training rows there are no rounds. Only sums of as many numbers as there are
    features come to the driver.
    """
    data = rows.select(_array("features").alias("x"), F.col("label").cast("double").alias("y"), F.col("validation").alias("held")).dropna()
    data = stage(data, "training")
    size = data.where("NOT held").agg(F.count("*").alias("n"), F.avg(F.aggregate("x", F.lit(0.0), lambda s, v: s + v * v)).alias("q"), F.max(F.size("x")).alias("d")).first()
    if not size["n"]:
        return Rounds([], np.zeros(0), 0)
    step = 1 / ((size["q"] + 1) / 4 + ridge)
    now = before = np.zeros(size["d"] + 1)
    kept = np.append(np.full(size["d"], ridge), 0.0)
    history, best = [], Rounds([], now, 0)
    least = np.inf
    for k in range(rounds * passes + 1):
        ahead = now + max(k - 1, 0) / (k + 2) * (now - before)
        slope, ((n, loss, hits), (m, held_loss, held_hits)) = _pass(data, ahead, now)
        if k and k % passes == 0:
            share = lambda a, b: float(a / b) if b else None
            history.append({"round": k // passes, "train_loss": share(loss, n), "val_loss": share(held_loss, m), "train_acc": share(hits, n), "val_acc": share(held_hits, m)})
            judged = history[-1]["val_loss"] if m else history[-1]["train_loss"]
            if judged < least:
                least, best = judged, Rounds(history, now, k // passes)
            if k // passes - best.best >= patience:
                break
        before, now = now, ahead - step * (slope / n + kept * ahead)
    return Rounds(history, best.weights, best.best)


def score_rounds(fitted: Rounds, rows: DataFrame) -> DataFrame:
    """Add ``raw``: the chance of class 1 by the best weights; null where features are. Of no training: one half."""
    if not len(fitted.weights):
        return rows.withColumn("raw", F.lit(0.5))
    *weights, constant = fitted.weights.tolist()
    products = F.zip_with(_array("features"), F.array(*map(F.lit, weights)), lambda a, b: a * b)
    z = F.aggregate(products, F.lit(constant), lambda s, v: s + v)
    return rows.withColumn("raw", 1 / (1 + F.exp(-z)))


def roc(scores: DataFrame, *, label: str = "label", raw: str = "raw") -> DataFrame:
    """One point for each distinct score, highest first: rates of true and false positives, and what the score itself adds to them.

    Scores are counted first; the running sums are over ranges of distinct scores.
    """
    counts = scores.groupBy(F.col(raw).alias("threshold")).agg(F.sum(F.col(label)).cast("long").alias("p"), F.sum(1 - F.col(label)).cast("long").alias("n"))
    points = running(counts, [], [F.desc("threshold")], {"_p": F.col("p"), "_n": F.col("n")})
    total = scores.agg(F.sum(F.col(label)).cast("long").alias("_all_p"), F.sum(1 - F.col(label)).cast("long").alias("_all_n"))
    rate = lambda c, of: (F.col(c) / F.nullif(F.col(of), F.lit(0)))
    return points.crossJoin(F.broadcast(total)).select("threshold", rate("_p", "_all_p").alias("tpr"), rate("_n", "_all_n").alias("fpr"), rate("p", "_all_p").alias("tpr_step"), rate("n", "_all_n").alias("fpr_step"))  # one row


def auc(curve: DataFrame) -> DataFrame:
    """Area under a ROC curve by trapezoids, from the origin: each point has its own step."""
    return curve.agg(F.sum(F.col("fpr_step") * (2 * F.col("tpr") - F.col("tpr_step")) / 2).alias("auc"))


def accuracy_loss(scores: DataFrame, split: str, *, label: str = "label", raw: str = "raw") -> DataFrame:
    """Accuracy and log-loss of each split; scores are kept off 0 and 1 by 1e-7."""
    p = F.least(F.greatest(F.col(raw), F.lit(1e-7)), F.lit(1 - 1e-7))
    hit = F.when((F.col(raw) >= 0.5) == (F.col(label) == 1), 1.0).otherwise(0.0)
    return scores.groupBy(split).agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"), F.avg(-F.when(F.col(label) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("log_loss"))


def diagnosis(accuracies: DataFrame) -> DataFrame:
    """Both below 0.75: UNDERFITTED; training ahead by more than 0.10: OVERFITTED; else WELL FITTED. Columns train_acc, val_acc."""
    t, v = F.col("train_acc"), F.col("val_acc")
    return accuracies.withColumn("diagnosis", F.when((t < 0.75) & (v < 0.75), "UNDERFITTED").when((t > v) & (t - v > 0.10), "OVERFITTED").otherwise("WELL FITTED"))
