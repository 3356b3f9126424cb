"""Active contours: many open and closed curves evolve in the potentials of their frames.

A curve is one row: its points as arrays, its own number of points and spacing. A frame's forces are tiles. In each pass a curve meets the tiles within
`REACH` of its points and takes its steps inside a task, until it rests, has used its rounds, or a point leaves those tiles; curves
that have left them meet their next tiles in the next pass. So passes follow how far curves travel, not how many steps they take, and a task holds the tiles along
one curve, or along a few short ones that step together, never a whole frame. Small frames may come packed instead; a task then opens those of many curves.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.banded import DENSE, FiveDiagonals
from framewright.functions.iterate import cut
from framewright.operators import curves

#: Pixels of a tile's side, and those around a point whose tiles a curve meets; curves of a group.
TILE, REACH, CURVES = 64, 16, 64
#: Curves of a group whose frames come packed.
PACKED = 1024
FRAME = ["video_id", "frame_idx"]
#: Slopes (2: gx, gy; frames, height, width) of packed frames; None has no slopes.
Opener = Callable[[list[bytes | None]], np.ndarray]


def evolution(count: int, spacing: float, alpha: float, beta: float, gamma: float, closed: bool) -> FiveDiagonals:
    """The matrix of an implicit step of tension alpha and stiffness beta; open ends have vanishing derivatives."""
    tension, stiffness = alpha / spacing**2, beta / spacing**4
    own, next_, second = 1 + gamma * (2 * tension + 6 * stiffness), -gamma * (tension + 4 * stiffness), gamma * stiffness
    bands = np.repeat(np.array([[second], [next_], [own], [next_], [second]]), count, axis=1)
    if not closed:
        bands[3, 0] = bands[1, -1] = 2 * next_
        bands[4, 0] = bands[0, -1] = 2 * second
        bands[2, 1] = bands[2, -2] = own + second
    return FiveDiagonals(bands, closed)


class Forces:
    """The forces on tiles around some curves, which are called by their place among `ids`."""

    def __init__(self, patch: pd.DataFrame, ids: list):
        owner = patch["curve"].map({c: k for k, c in enumerate(ids)})
        patch, owner = patch[owner.notna()], owner[owner.notna()].to_numpy(np.int64)
        place = np.array([patch["ty"], patch["tx"]], np.int64)
        self.corner = np.zeros((2, len(ids)), np.int64)
        far = np.zeros((2, len(ids)), np.int64)
        for k in range(len(ids)):
            own = place[:, owner == k]
            self.corner[:, k], far[:, k] = own.min(axis=1), own.max(axis=1)
        self.slots = np.full((len(ids), *(far - self.corner + 1).max(axis=1)), -1, np.int64)
        filled = patch["ys"].notna().to_numpy()
        slot = np.where(filled, np.cumsum(filled), 0)  # the first one is empty
        self.slots[owner, place[0] - self.corner[0, owner], place[1] - self.corner[1, owner]] = slot
        self.values = np.zeros((2, int(filled.sum()) + 1, TILE, TILE))
        for k, ys, xs, gx, gy in zip(slot, patch["ys"], patch["xs"], patch["gx"], patch["gy"], strict=True):
            if k:
                self.values[0, k, np.asarray(ys) % TILE, np.asarray(xs) % TILE] = gx
                self.values[1, k, np.asarray(ys) % TILE, np.asarray(xs) % TILE] = gy

    def at(self, x: np.ndarray, y: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Both forces at the points of the curves `which`, between the four pixels around each, and whether all tiles of a curve are there."""
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        fx, fy, total, there = x - x0, y - y0, np.zeros((2, *x.shape)), np.ones(len(which), bool)
        top, left = self.corner[:, which, None]
        height, width = self.slots.shape[1:]
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                row, column = (y0 + dy) // TILE - top, (x0 + dx) // TILE - left
                slot = self.slots[which[:, None], np.clip(row, 0, height - 1), np.clip(column, 0, width - 1)]
                there &= ((row >= 0) & (row < height) & (column >= 0) & (column < width) & (slot >= 0)).all(axis=1)
                total += wy * wx * self.values[:, slot, (y0 + dy) % TILE, (x0 + dx) % TILE]
        return total, there


class WholeForces:
    """The forces on the whole frames of some curves, as arrays gx, gy (2, curves, height, width)."""

    def __init__(self, values: np.ndarray):
        self.width, self.area = values.shape[3], values.shape[2] * values.shape[3]
        self.values = values.reshape(2, -1)

    def at(self, x: np.ndarray, y: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `Forces.at`; a frame has all its pixels."""
        x0, y0 = np.floor(x).astype(np.int64), np.floor(y).astype(np.int64)
        fx, fy, total = x - x0, y - y0, np.zeros((2, *x.shape))
        first = which[:, None] * self.area + y0 * self.width + x0
        for dy, wy in ((0, 1 - fy), (1, fy)):
            for dx, wx in ((0, 1 - fx), (1, fx)):
                total += wy * wx * self.values[:, first + dy * self.width + dx]
        return total, np.ones(len(which), bool)


def _advance(size: tuple[int, int], alpha: float, beta: float, gamma: float, rounds: int, tolerance: float, opened: Opener | None = None):
    """Steps of the curves of a group among their tiles, or in frames that are `opened`; those with equally many points step together."""
    limit = np.array([size[0] - 2.0, size[1] - 2.0])[:, None, None]

    def together(rows: pd.DataFrame, patch: pd.DataFrame) -> pd.DataFrame:
        now = np.array([rows["xs"].tolist(), rows["ys"].tolist()], float)
        held = np.array([rows["hold_x"].tolist(), rows["hold_y"].tolist()], float)
        systems = [evolution(now.shape[2], h, alpha, beta, gamma, bool(c)) for h, c in zip(rows["spacing"], rows["closed"], strict=True)]
        inverse = None if systems[0].inverse is None else np.stack([m.inverse for m in systems])
        forces = Forces(patch, rows["curve_id"].tolist()) if opened is None else WholeForces(opened(rows["curve_id"].map(patch.set_index("curve")["packed"]).tolist()))
        used, rests = rows["rounds"].to_numpy(np.int64).copy(), rows["converged"].to_numpy(bool).copy()
        which = np.flatnonzero(used < rounds)
        own = inverse if inverse is None else inverse[which]
        while len(which):
            force, there = forces.at(*now[:, which], which)
            if not there.all():
                which = which[there]
                own = inverse if inverse is None else inverse[which]
            before = now[:, which]
            pushed = before + gamma * force[:, there]
            after = np.array([[m.solve(v) for m, v in zip([systems[k] for k in which], axis, strict=True)] for axis in pushed]).reshape(before.shape) if inverse is None else (own @ pushed[..., None])[..., 0]
            after = np.where(np.isnan(held[:, which]), after, held[:, which])
            still = np.abs(after - before).sum(axis=(0, 2)) < tolerance * gamma
            now[:, which] = np.clip(after, 0, limit)
            used[which] += 1
            rests[which[still]] = True
            goes = ~still & (used[which] < rounds)
            if not goes.all():
                which = which[goes]
                own = inverse if inverse is None else inverse[which]
        return rows.assign(xs=list(now[0]), ys=list(now[1]), rounds=used, converged=rests, done=rests | (used >= rounds))

    def run(curve: pd.DataFrame, patch: pd.DataFrame) -> pd.DataFrame:
        curve = curve.drop(columns="deal")
        moved = [together(rows, patch) for _, rows in curve.groupby([curve["xs"].map(len), curve["closed"]])]
        return pd.concat(moved) if moved else curve

    return run


def _dealt(active: DataFrame, packed: bool = False) -> DataFrame:
    """The curves with `deal`, their group: about `CURVES` curves of few points and tiles, or a single one of more. Where frames come packed `PACKED` at most,
    but fewer if cores would be idle."""
    tiles = F.lit(1)
    for c in ("xs", "ys"):
        tiles = tiles * (F.floor((F.array_max(c) + REACH + 1) / TILE) - F.floor((F.array_min(c) - REACH) / TILE) + 1)
    count = active.count()
    groups = max(1, -(-count // CURVES))
    if packed:
        groups = max(-(-count // PACKED), min(groups, active.sparkSession.sparkContext.defaultParallelism))
    few = (F.size("xs") <= DENSE) & (tiles <= 4)
    return active.withColumn("deal", F.when(few, F.concat(F.lit("group "), F.pmod(F.xxhash64("curve_id"), F.lit(groups)).cast("string"))).otherwise(F.concat(F.lit("curve "), F.col("curve_id").cast("string"))))


def _packed(points: DataFrame, anchors: DataFrame | None, size: tuple[int, int]) -> DataFrame:
    """The curves as rows, their points at equal distances, with the coordinates that are held."""
    even = curves.evenly(points)
    spacing = curves.lengths(points).withColumnRenamed("length", "total")
    holds = [F.lit(None).cast("double").alias(c) for c in ("hold_x", "hold_y")]
    if anchors is None:
        marked = even.select("*", *holds)
    else:
        fixed = anchors.join(points, ["curve_id", "i"]).select("curve_id", F.col("i").alias("anchor"), F.col("x").alias("ax"), F.col("y").alias("ay"), "hold_x", "hold_y")
        away = F.pow(F.col("x") - F.col("ax"), F.lit(2)) + F.pow(F.col("y") - F.col("ay"), F.lit(2))
        best = even.join(fixed, "curve_id").groupBy("curve_id", "anchor").agg(F.min(F.struct(away.alias("away"), "i")).alias("m"), F.first("ax").alias("ax"), F.first("ay").alias("ay"), F.first("hold_x").alias("hx"), F.first("hold_y").alias("hy"))
        best = best.select("curve_id", F.col("m.i").alias("i"), F.when(F.col("hx"), F.col("ax")).alias("hold_x"), F.when(F.col("hy"), F.col("ay")).alias("hold_y"))
        best = best.groupBy("curve_id", "i").agg(F.max("hold_x").alias("hold_x"), F.max("hold_y").alias("hold_y"))
        marked = even.join(best, ["curve_id", "i"], "left")
    inside = [F.least(F.lit(n - 2.0), F.greatest(F.lit(0.0), F.col(c))).alias(c) for c, n in zip("xy", size, strict=True)]
    rows = marked.select("curve_id", F.struct("i", *inside, "hold_x", "hold_y").alias("p")).groupBy("curve_id").agg(F.sort_array(F.collect_list("p")).alias("p"))
    rows = rows.join(spacing, "curve_id").withColumn("spacing", F.col("total") / (F.size("p") - 1))
    return rows.select("curve_id", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"), F.col("p.hold_x").alias("hold_x"), F.col("p.hold_y").alias("hold_y"), "spacing")


def active_contours(points: DataFrame, gradients: DataFrame, size: tuple[int, int], alpha: float = 0.0, beta: float = 100.0, gamma: float = 0.001, closed: bool = False, anchors: DataFrame | None = None, rounds: int = 50, tolerance: float = 1.0, opened: Opener | None = None) -> DataFrame:
    """Evolves curves (curve_id, video_id, frame_idx, i, x, y[, closed]) toward high potential: curve_id, video_id, frame_idx, i, x, y, rounds, converged.

    `gradients` are the potential's slopes gx, gy by pixel (0 where a pixel lacks). Points are put at equal distances first. A step adds gamma
    times the slope, solves the curve's own system, puts held coordinates back and keeps points within the frame, less a last row and column.
    `anchors` (curve_id, i, hold_x, hold_y) name vertices whose x, y or both are held, at the nearest of the new points. A curve rests, and has
    `converged`, once the points move less than `tolerance * gamma` in all; others stop after `rounds`. A `closed` column says it for each
    curve. Curves of two points at most, or without length, stay as they are and rest. With `opened`, which makes the slopes of packed frames,
    `gradients` are small packed frames: video_id, frame_idx, packed.
    """
    shut = F.col("closed") if "closed" in points.columns else F.lit(closed)
    given = cut(points.select("curve_id", *FRAME, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), shut.alias("closed")))
    about = given.groupBy("curve_id").agg(*[F.first(c).alias(c) for c in (*FRAME, "closed")], F.count(F.lit(1)).alias("n"))
    about = cut(about.join(curves.lengths(given), "curve_id").withColumn("fit", (F.col("n") > 2) & (F.col("length") > 0)))
    moving = given.join(about.where("fit").select("curve_id"), "curve_id", "left_semi")
    state = _packed(moving.select("curve_id", "i", "x", "y"), anchors, size).join(about.select("curve_id", *FRAME, "closed"), "curve_id")
    state = cut(state.withColumns({"rounds": F.lit(0), "converged": F.lit(False), "done": F.lit(rounds <= 0)}))
    place = {t: F.floor(F.col(c) / TILE).cast("int") for t, c in (("ty", "y"), ("tx", "x"))}
    tiles = gradients if opened else cut(gradients.withColumns(place).groupBy(*FRAME, "ty", "tx").agg(*[F.collect_list(F.struct("y", "x", "gx", "gy")).alias("p")]).select(*FRAME, "ty", "tx", *[F.col(f"p.{c}").alias(n) for c, n in (("y", "ys"), ("x", "xs"), ("gx", "gx"), ("gy", "gy"))]))
    done = state.where("done")
    active = state.where("not done")
    while active.take(1):
        active = _dealt(active, opened is not None)
        if opened:
            patch = active.select(F.col("deal").alias("among"), F.col("curve_id").alias("curve"), *FRAME).join(tiles, FRAME, "left").select("among", "curve", "packed")
            parts = active.select("deal").distinct().count()  # few bytes, but much work a row
            moved = active.repartition(parts, "deal").groupBy("deal").cogroup(patch.repartition(parts, "among").groupBy("among"))
            after = cut(moved.applyInPandas(_advance(size, alpha, beta, gamma, rounds, tolerance, opened), active.drop("deal").schema))
            done, active = done.unionByName(after.where("done")), after.where("not done")
            continue
        corner = active.select(F.col("deal").alias("among"), F.col("curve_id").alias("curve"), *FRAME, F.explode(F.arrays_zip("xs", "ys")).alias("p"))
        for t, c in (("ty", "ys"), ("tx", "xs")):
            low, high = (F.floor((F.floor(F.col(f"p.{c}")) + d) / TILE).cast("int") for d in (-REACH, REACH + 1))
            corner = corner.withColumn(t, F.explode(F.sequence(low, high)))
        patch = corner.select("among", "curve", *FRAME, "ty", "tx").distinct().join(tiles, [*FRAME, "ty", "tx"], "left").select("among", "curve", "ty", "tx", "ys", "xs", "gx", "gy")
        moved = active.groupBy("deal").cogroup(patch.groupBy("among")).applyInPandas(_advance(size, alpha, beta, gamma, rounds, tolerance), active.drop("deal").schema)
        after = cut(moved)
        done, active = done.unionByName(after.where("done")), after.where("not done")
    ended = done.select("curve_id", *FRAME, F.posexplode(F.arrays_zip("xs", "ys")).alias("i", "p"), "rounds", "converged").select("curve_id", *FRAME, "i", F.col("p.xs").alias("x"), F.col("p.ys").alias("y"), "rounds", "converged")
    still = given.join(about.where("not fit").select("curve_id"), "curve_id", "left_semi")
    return ended.unionByName(still.select("curve_id", *FRAME, F.col("i").cast("int").alias("i"), "x", "y", F.lit(0).alias("rounds"), F.lit(True).alias("converged")))
