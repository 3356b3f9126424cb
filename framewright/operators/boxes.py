"""Longest ways and slopes in small frames, many at a time.

Frames whose box has `CELLS` pixels at most are opened side by side as one array, where rounds of shortest ways go over all frames at once. Lengths are kept
as exact whole numbers of small units, so equal ways are equal. Larger frames go tile by tile (`fields`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from framewright.functions import kernels
from framewright.functions.pieces import FRAME, cells, whole_frames

#: Pixels of a frame's box at most, and cells that are open at once.
CELLS, OPEN = 1 << 12, 1 << 17
ROOT2 = 2**0.5
#: Units of a straight step, and the nearest number of them in a diagonal one: ways of up to CELLS steps differ by far more than what that rounding adds up to.
UNIT = 1 << 32
SLANT = round(ROOT2 * UNIT)
#: Units of the chamfer metric (a straight step, a diagonal one and a knight's move are 1.0, 1.4 and 2.1969), and the reach of its steps.
TENTHS, CHAMFER, KNIGHT = 10_000, {(0, 1): 10_000, (1, 1): 14_000, (1, 2): 21_969}, 2
#: What is left of so many diagonal steps beyond whole units, ascending, and their numbers.
SPARE = np.arange(CELLS + 1) * SLANT % UNIT
SLANTS = np.argsort(SPARE)


def _lengths(units: np.ndarray) -> np.ndarray:
    """Lengths as doubles, as the tiles give them: 2, straight steps and diagonal ones."""
    held = np.where(np.isfinite(units), units, 0).astype(np.int64)
    slants = SLANTS[np.searchsorted(SPARE, held % UNIT, sorter=SLANTS)]
    return np.where(np.isfinite(units), 2.0 + (held - slants * SLANT) // UNIT * 1.0 + slants * ROOT2, np.inf)


def _relax(far: np.ndarray, walls: list[tuple[int, int, np.ndarray]], reach: int) -> None:
    """Shortens lengths (height, width, frames; with `reach` infinite cells around) until no step (dy, dx, its length into each cell) does so any more.

    A round goes over the rows down and up and over the columns right and left, each with the steps that lead on; so straight parts of ways take one round.
    """
    core = far[reach:-reach, reach:-reach]
    turned = [(dx, dy, wall.swapaxes(0, 1) if wall.ndim else wall) for dy, dx, wall in walls]
    ways = []
    for around, steps in ((far, walls), (far.swapaxes(0, 1), turned)):
        for sign in (-1, 1):
            ways.append((around, range(around.shape[0] - 2 * reach)[::-sign], [step for step in steps if step[0] * sign > 0]))
    before = np.empty_like(core)
    while True:
        before[:] = core
        for around, order, steps in ways:
            end = around.shape[1] - reach
            for k in order:
                line = around[reach + k, reach:end]
                for on, aside, wall in steps:
                    np.minimum(line, around[reach + k + on, reach + aside : end + aside] + (wall[k] if wall.ndim else wall), out=line)
        news = (before != core).any(axis=(0, 1))
        if not news.any():
            return
        if 2 * news.sum() < len(news):
            some = far[:, :, news]
            _relax(some, [(dy, dx, wall[:, :, news] if wall.ndim else wall) for dy, dx, wall in walls], reach)
            far[:, :, news] = some
            return


def _longest(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of masks (height, width, frames; with empty cells around, and some pixel in each) the lengths from the first end of a longest way, and its second end by its place.

    Sweeps go from the farthest pixel on until the length stops growing, as in `regions.farthest_pair`.
    """
    high, wide, count = inside.shape
    core = inside[1:-1, 1:-1]
    straight, bent = (np.where(core, float(c), np.inf) for c in (UNIT, SLANT))

    def sweep(of: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far, each = np.full((high, wide, len(of)), np.inf), np.arange(len(of))
        flat = far.reshape(-1, len(of))
        flat[starts, each] = 0
        own = straight[:, :, of], bent[:, :, of]
        _relax(far, [(dy, dx, own[bool(dy and dx)]) for dy, dx in kernels.EIGHT], 1)
        ends = len(flat) - 1 - np.where(np.isfinite(flat), flat, -1)[::-1].argmax(axis=0)
        return far, ends, flat[ends, each]

    active = np.arange(count)
    lengths, ends, most = sweep(active, inside.reshape(-1, count).argmax(axis=0))
    while len(active):
        far, last, length = sweep(active, ends[active])
        longer = length > most[active]
        active = active[longer]
        lengths[:, :, active], ends[active], most[active] = far[:, :, longer], last[longer], length[longer]
    return lengths, ends


def _walked(lengths: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The frames and places of the steepest ways down from the ends, step by step; of equal descents the first in row order."""
    high, wide, count = lengths.shape
    flat, size = _lengths(lengths).reshape(-1, count), np.array([ROOT2 if dy and dx else 1.0 for dy, dx in kernels.EIGHT])
    steps = np.array([dy * wide + dx for dy, dx in kernels.EIGHT])
    which, at = np.arange(count), ends
    while len(which):
        yield which, at
        near = at[:, None] + steps
        drop = np.rint((flat[at, which][:, None] - flat[near, which[:, None]]) / size * 1e9)
        best = drop.argmax(axis=1)
        down = drop[np.arange(len(which)), best] > 0
        which, at = which[down], near[np.arange(len(which)), best][down]


def _opened(spans: pd.DataFrame, frames: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The frames of spans as masks with a rim of one empty cell, those of like boxes together: numbers, tops, lefts, masks."""
    y, x0, x1 = (spans[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    starts = np.flatnonzero(np.diff(frames, prepend=-1))
    top, left = np.minimum.reduceat(y, starts), np.minimum.reduceat(x0, starts)
    high, wide = (-(-(np.maximum.reduceat(v, starts) - low + 1) // 8) * 8 for v, low in ((y, top), (x1, left)))
    at, x = cells(spans)
    frame, y = frames[at], y[at]
    kind = high * (1 << 32) + wide
    order = np.argsort(kind, kind="stable")
    bounds = [*np.flatnonzero(np.diff(kind[order], prepend=-1)).tolist(), len(order)]
    chunk = np.full(len(starts), -1)
    for begin, end in zip(bounds, bounds[1:], strict=False):
        h, w = int(high[order[begin]]), int(wide[order[begin]])
        many = max(1, OPEN // ((h + 2) * (w + 2)))
        for first in range(begin, end, many):
            own = order[first : min(end, first + many)]
            chunk[:] = -1
            chunk[own] = np.arange(len(own))
            held = np.flatnonzero(chunk[frame] >= 0)
            mask = np.zeros((h + 2, w + 2, len(own)), bool)
            mask[y[held] - top[frame[held]] + 1, x[held] - left[frame[held]] + 1, chunk[frame[held]]] = True
            yield own, top[own], left[own], mask


def _ways(spans: pd.DataFrame, frames: np.ndarray) -> Iterator[pd.DataFrame]:
    """The pixels (y, x, pos) of a longest way of each frame."""
    names = spans[FRAME].iloc[np.flatnonzero(np.diff(frames, prepend=-1))]
    for own, top, left, mask in _opened(spans, frames):
        steps = list(_walked(*_longest(mask)))
        which, at = (np.concatenate(c) for c in zip(*steps, strict=True))
        pos = np.repeat(np.arange(len(steps)), [len(w) for w, _ in steps])
        named = names.iloc[own[which]].reset_index(drop=True)
        yield named.assign(y=at // mask.shape[1] - 1 + top[which], x=at % mask.shape[1] - 1 + left[which], pos=pos)


def longest_ways(spans: DataFrame, pixels: int) -> DataFrame:
    """As `regions.farthest_path` from each frame's first pixel, for frames of small boxes, given as spans (`pixels` in all)."""
    kinds = dict(spans.dtypes)
    return whole_frames(spans, pixels, _ways, f"y {kinds['y']}, x {kinds['x0']}, pos long")


def _packing(height: int, width: int):
    """The masks of the frames as packed bits, without what lies beyond the frame."""

    def run(spans: pd.DataFrame, frames: np.ndarray) -> Iterator[pd.DataFrame]:
        names = spans[FRAME].iloc[np.flatnonzero(np.diff(frames, prepend=-1))]
        many = max(1, OPEN // (height * width))
        at, x = cells(spans)
        frame, y = frames[at], spans["y"].to_numpy(np.int64)[at]
        held = np.flatnonzero((y >= 0) & (y < height) & (x >= 0) & (x < width))
        frame, y, x = frame[held], y[held], x[held]
        for first in range(0, len(names), many):
            own = slice(*np.searchsorted(frame, [first, first + many]))
            mask = np.zeros((len(names.iloc[first : first + many]), height, width), bool)
            mask[frame[own] - first, y[own], x[own]] = True
            bits = np.packbits(mask.reshape(len(mask), -1), axis=1)
            yield names.iloc[first : first + many].assign(packed=[row.tobytes() for row in bits])

    return run


def packed(spans: DataFrame, pixels: int, height: int, width: int) -> DataFrame:
    """The masks of small frames as rows: video_id, frame_idx, packed."""
    return whole_frames(spans, pixels, _packing(height, width), "packed binary")


def _depths(inside: np.ndarray) -> np.ndarray:
    """Chamfer distance of each pixel to the nearest one that is not inside; 0 for those, and where there are none."""
    count, high, wide = inside.shape
    far = np.full((high + 2 * KNIGHT, wide + 2 * KNIGHT, count), np.inf)
    core = far[KNIGHT:-KNIGHT, KNIGHT:-KNIGHT]
    core[~inside.transpose(1, 2, 0)] = 0
    walls = [(dy, dx, np.float64(CHAMFER[kind])) for dy, dx in kernels.box(KNIGHT) if (kind := tuple(sorted((abs(dy), abs(dx))))) in CHAMFER]
    _relax(far, walls, KNIGHT)
    return np.where(np.isfinite(core), core, 0).transpose(2, 0, 1) / TENTHS


def depth_slopes(height: int, width: int, sigma: float) -> Callable[[list[bytes | None]], np.ndarray]:
    """A function that makes the 5x5 Sobel derivatives (2: gx, gy; frames, height, width) of the blurred distance to the background of packed masks, as `shapes.gradients`.

    Rows and columns in which the mirrored derivative has no weights have no slopes there, and 0 here.
    """
    gauss, soft, slope = kernels.gaussian(sigma), [1.0, 4.0, 6.0, 4.0, 1.0], [-1.0, -2.0, 0.0, 2.0, 1.0]

    def matrix(weights: list[float], n: int) -> np.ndarray:
        out = np.zeros((n, n))
        for to, source, w in kernels.convolution(weights, n):
            out[to, source] = w
        return out

    (gy, sy, ly), (gx, sx, lx) = ([matrix(w, n) for w in (gauss, soft, slope)] for n in (height, width))

    there = ly.any(axis=1)[:, None] & lx.any(axis=1)

    def run(masks: list[bytes | None]) -> np.ndarray:
        size = height * width
        bits = np.frombuffer(b"".join(m if m is not None else bytes(-(-size // 8)) for m in masks), np.uint8).reshape(len(masks), -1)
        inside = np.unpackbits(bits, axis=1, count=size).reshape(len(masks), height, width).astype(bool)
        base = gy @ _depths(inside) @ gx.T
        return np.stack([sy @ base @ lx.T, ly @ base @ sx.T]) * there

    return run
