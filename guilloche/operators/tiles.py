"""Images as array tiles with a halo.

A pixel goes once to its own tile and, within reach of a border, to the neighbours there, all
in one exchange; what looks at neighbouring pixels then runs on whole arrays inside tasks. A
tile is bounded whatever the size of its image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows and columns of a tile without its halo.
SIDE = 128

#: Rows that small results of tiles are put together to.
TOGETHER = 1 << 14


@dataclass
class Tile:
    """Rows y0 up and columns x0 up of an image of h by w pixels; ``values`` hold ``ry`` rows and ``rx`` columns more on each side, mirrored at the image's border without repeating it."""

    y0: int
    x0: int
    rows: int
    cols: int
    h: int
    w: int
    ry: int
    rx: int
    values: dict[str, np.ndarray]

    @property
    def inside(self) -> np.ndarray:
        """Which places of the values lie in the image."""
        y, x = np.arange(-self.ry, self.rows + self.ry) + self.y0, np.arange(-self.rx, self.cols + self.rx) + self.x0
        return ((y >= 0) & (y < self.h))[:, None] & ((x >= 0) & (x < self.w))


def mirrored(places: np.ndarray, n: int) -> np.ndarray:
    """Places outside 0 to n - 1 reflected into it."""
    i = np.abs(places) % max(2 * (n - 1), 1)
    return np.where(i < n, i, 2 * (n - 1) - i)


def cut(pixels: DataFrame, names: tuple[str, ...], reach: tuple[int, int], *, side: int = SIDE) -> DataFrame:
    """One row a tile: note_id, ty, tx, h, w and ``px``, a list of the pixels of it and of its halo of ``reach`` rows and columns.

    ``pixels`` have note_id, y, x, h, w and whole-number columns ``names``. The one exchange of
    what is done on tiles. The place of a pixel in its tile and halo, row by row, and its first
    value are one long, further values stand beside it; null is no value. No pixels give no
    tiles; other columns are dropped.
    """
    if max(reach) > side:
        raise ValueError(f"a halo of {reach} does not fit tiles of {side}")

    def homes(c: str, size: str, far: int):
        at = lambda d: F.floor((F.col(c) + d) / side).cast("int")
        last = F.floor((F.col(size) - 1) / side).cast("int")
        return F.explode(F.sequence(F.greatest(at(-far), F.lit(0)), F.least(at(far), last)))

    dealt = pixels.select("note_id", "y", "x", "h", "w", *names).withColumn("ty", homes("y", "h", reach[0])).withColumn("tx", homes("x", "w", reach[1]))
    row, column = (F.col(c) - F.col(f"t{c}") * side + far for c, far in zip("yx", reach))
    place = F.shiftleft((row * (side + 2 * reach[1]) + column).cast("long"), 32)
    placed = lambda v: place.bitwiseOR(v.cast("long").bitwiseAND(F.lit(2**32 - 1)))
    first, *others = (F.col(n).cast("int").alias(n) for n in names)
    px = F.struct(placed(F.coalesce(first, F.lit(0))).alias(names[0]), *others) if others else placed(first)
    return dealt.groupBy("note_id", "ty", "tx").agg(F.first("h").cast("int").alias("h"), F.first("w").cast("int").alias("w"), F.struct(F.collect_list(px).alias(names[0])).alias("px"))


def empty(pixels: DataFrame, tiles: DataFrame, *, side: int = SIDE) -> DataFrame:
    """The tiles of the images in which no pixel lies, as rows of ``tiles``, which are ``cut`` from the same pixels.

    One more pass over places alone; of pixels dealt out by note none is shuffled.
    """
    at = lambda c: F.floor(F.col(c) / side).cast("int")
    last = lambda c: F.floor((F.col(c) - 1) / side).cast("int")
    have = pixels.groupBy("note_id").agg(F.first("h").cast("int").alias("h"), F.first("w").cast("int").alias("w"), F.collect_set(F.struct(at("y").alias("ty"), at("x").alias("tx"))).alias("have"))
    every = F.flatten(F.transform(F.sequence(F.lit(0), last("h")), lambda i: F.transform(F.sequence(F.lit(0), last("w")), lambda k: F.struct(i.alias("ty"), k.alias("tx")))))
    none = F.struct(F.array().cast(tiles.schema["px"].dataType[0].dataType).alias(tiles.schema["px"].dataType[0].name)).alias("px")
    return have.select("note_id", "h", "w", F.inline(F.array_except(every, "have"))).select("note_id", "ty", "tx", "h", "w", none)


def _tile(h: int, w: int, ty: int, tx: int, px: pa.Array, name: str, reach: tuple[int, int], side: int) -> Tile:
    (ry, rx), y0, x0 = reach, ty * side, tx * side
    rows, cols = min(side, h - y0), min(side, w - x0)
    ys, xs = mirrored(np.arange(y0 - ry, y0 + rows + ry), h) - y0 + ry, mirrored(np.arange(x0 - rx, x0 + cols + rx), w) - x0 + rx
    placed, *others = px.flatten() if pa.types.is_struct(px.type) else [px]
    placed, values = placed.to_numpy(), {}
    names = [name, *(px.type[k].name for k in range(1, len(others) + 1))]
    for n, v in zip(names, [placed.astype(np.int32), *(o.fill_null(0).to_numpy() for o in others)]):
        whole = np.zeros((side + 2 * ry, side + 2 * rx), np.int64)
        whole.ravel()[placed >> 32] = v
        values[n] = whole[np.ix_(ys, xs)]
    return Tile(y0, x0, rows, cols, h, w, ry, rx, values)


def on_tiles(tiles: DataFrame, fn: Callable[..., dict[str, np.ndarray]], schema: str, reach: tuple[int, int], *, side: int = SIDE, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows note_id and ``schema``: what ``fn`` makes of each tile, and of the values of ``more`` columns beside it, as arrays of equal length."""
    kind = dict(tiles.dtypes)["note_id"]

    def made(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        notes = batch.column(0)
        places = [batch.column(k).to_numpy() for k in range(1, 5)]
        lists, name = batch.column(5).field(0), batch.column(5).type[0].name
        beside = [batch.column(k).to_pylist() for k in range(6, 6 + len(more))]
        for i in range(batch.num_rows):
            ty, tx, h, w = (int(p[i]) for p in places)
            found = fn(_tile(h, w, ty, tx, lists[i].values, name, reach, side), *[b[i] for b in beside])
            n = len(next(iter(found.values())))
            yield pa.RecordBatch.from_arrays([notes.take(pa.array(np.full(n, i))), *[v if isinstance(v, pa.Array) else pa.array(np.asarray(v, np.int32)) for v in found.values()]], ["note_id", *found])

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for found in made(batch):
                held.append(found)
                rows += found.num_rows
                if rows >= TOGETHER or len(held) == SIDE:
                    yield pa.concat_batches(held)
                    held, rows = [], 0
            if held:
                yield pa.concat_batches(held)

    return tiles.select("note_id", "ty", "tx", "h", "w", "px", *more).mapInArrow(run, f"note_id {kind}, {schema}")


def per_pixel(pixels: DataFrame, names: tuple[str, ...], reach: tuple[int, int], fn: Callable[[Tile], dict[str, np.ndarray]], out: tuple[str, ...], *, side: int = SIDE) -> DataFrame:
    """Pixels note_id, y, x, h, w and ``out``: what ``fn`` makes of each tile's own pixels."""

    def rows(t: Tile) -> dict[str, np.ndarray]:
        y, x = np.mgrid[t.y0 : t.y0 + t.rows, t.x0 : t.x0 + t.cols].reshape(2, -1)
        found = fn(t)
        return {"y": y, "x": x, "h": np.full(y.size, t.h), "w": np.full(y.size, t.w)} | {k: found[k].ravel() for k in out}

    schema = ", ".join(f"{c} int" for c in ("y", "x", "h", "w", *out))
    return on_tiles(cut(pixels, names, reach, side=side), rows, schema, reach, side=side)


def column_runs(mask: np.ndarray, t: Tile, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of set pixels down the columns of a tile: x, y0, y1, and the largest of each further array within a run. One that goes on in the next tile ends here."""
    set_ = np.pad(mask.T.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(set_, axis=1)
    x, first = np.nonzero(step == 1)
    last = np.nonzero(step == -1)[1] - 1
    at = np.stack([x * mask.shape[0] + first, x * mask.shape[0] + last + 1], 1).ravel()
    most = [np.maximum.reduceat(np.append(m.T.ravel(), 0), at)[::2] if len(at) else np.empty(0, int) for m in more]
    return x + t.x0, first + t.y0, last + t.y0, *most


def filtered_down(mask: np.ndarray, inside: np.ndarray, steps: tuple[tuple[str, int], ...]) -> np.ndarray:
    """Greatest or least (``max``, ``min``) of frames of k rows, one step after the other; places outside the image do not count."""
    for what, k in steps:
        before, after, pick, none = k // 2, k - 1 - k // 2, (np.maximum if what == "max" else np.minimum), 0 if what == "max" else np.iinfo(np.int64).max
        held = np.pad(np.where(inside, mask, none), ((before, after), (0, 0)), constant_values=none)
        out = held[: mask.shape[0]].copy()
        for j in range(1, k):
            pick(out, held[j : j + mask.shape[0]], out=out)
        mask = out
    return mask
