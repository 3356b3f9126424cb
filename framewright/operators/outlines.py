"""Outlines of small frames, many at a time.

A task does for all frames of a piece at once what the dealt way does in rounds: regions, the largest of each frame, its sides, and its rings by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

from framewright.functions.pieces import FRAME, cells

#: Sides (0 to 3: top, right, bottom, left), inside on the right hand: offsets of the start and the end corner.
STARTS, ENDS = np.array([(0, 0), (0, 1), (1, 1), (1, 0)]), np.array([(0, 1), (1, 1), (1, 0), (0, 0)])


def _components(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component under the links (a, b)."""
    low = np.arange(count)
    while True:
        p, q = low[a], low[b]
        apart = p != q
        if not apart.any():
            return low
        np.minimum.at(low, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (low[low] != low).any():
            low = low[low]


def _found(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The place of each asked key among the ascending keys, -1 where it lacks."""
    at = np.searchsorted(keys, asked)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == asked, at, -1)


def _firsts(groups: np.ndarray, *order: np.ndarray) -> np.ndarray:
    """The place of the first of each group, by ascending `order`."""
    by = np.lexsort((*reversed(order), groups))
    return by[np.flatnonzero(np.diff(groups[by], prepend=-1))]


def _largest(cells: np.ndarray, side: int, area: int) -> np.ndarray:
    """Of ascending cells (frame * area + y * side + x) those of each frame's largest four-connected region, the first one if tied."""
    run = np.cumsum(np.diff(cells, prepend=cells[0] - 2) != 1) - 1
    below = _found(cells, cells + side)
    upper, lower = run[below >= 0], run[below[below >= 0]]
    region = _components(run[-1] + 1, upper, lower)[run]
    names, sizes = np.unique(region, return_counts=True)
    firsts = np.flatnonzero(np.diff(run, prepend=-1))
    frames = cells[firsts[names]] // area
    best = names[_firsts(frames, -sizes, names)]
    return cells[np.isin(region, best)]


def _rings(cells: np.ndarray, side: int, area: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The corners (frame, i, x, y) of the largest ring of each frame's cells."""
    edges = []
    for kind, step in enumerate((-side, 1, side, -1)):
        bare = cells[_found(cells, cells + step) < 0]
        edges.append((bare + STARTS[kind, 0] * side + STARTS[kind, 1]) * 4 + kind)
    nodes = np.sort(np.concatenate(edges))
    kind, start = nodes % 4, nodes // 4
    end = start + ((ENDS - STARTS) @ [side, 1])[kind]
    after = np.full(len(nodes), -1)
    for turn in (3, 0, 1):  # left, straight on, right, which keeps four-connected regions apart at a shared corner
        on = _found(nodes, end * 4 + (kind + turn) % 4)
        after = np.where(on >= 0, on, after)
    low, jump = np.minimum(np.arange(len(nodes)), after), after
    while True:
        less, jump = np.minimum(low, low[jump]), jump[jump]
        if (less == low).all():
            break
        low = less
    own = np.arange(len(nodes))
    last = after == low
    rank, jump = np.where(last, 0, 1), np.where(last, own, after)
    while (jump[jump] != jump).any():
        rank, jump = rank + rank[jump], jump[jump]
    frame, y, x = start // area, start % area // side, start % side
    twice = np.zeros(len(nodes), np.int64)
    np.add.at(twice, low, x * y[after] - x[after] * y)
    heads = np.flatnonzero(low == own)
    kept = np.flatnonzero(np.isin(low, heads[_firsts(frame[heads], -np.abs(twice[heads]), heads)]))
    kept = kept[np.lexsort((-rank[kept], frame[kept]))]
    return frame[kept], (rank[low] - rank)[kept], x[kept], y[kept]


def outlined(spans: pd.DataFrame, frames: np.ndarray) -> Iterator[pd.DataFrame]:
    """The outlines of the spans' frames, which are numbered from 0 on; frames whose cells have no common numbers are opened in halves."""
    y, x0, x1 = (spans[c].to_numpy(np.int64) for c in ("y", "x0", "x1"))
    starts = np.flatnonzero(np.diff(frames, prepend=-1))
    top, left = np.minimum.reduceat(y, starts), np.minimum.reduceat(x0, starts)
    y, x1 = y - top[frames], x1 - left[frames]
    side = int(x1.max()) + 4  # a cell beyond the last corner, so that rows do not touch
    area = side * (int(y.max()) + 4)
    if len(starts) > 1 and area * len(starts) >= 1 << 60:
        half = starts[len(starts) // 2]
        yield from outlined(spans.iloc[:half], frames[:half])
        yield from outlined(spans.iloc[half:], frames[half:] - len(starts) // 2)
        return
    at, x = cells(spans)
    inside = np.unique(frames[at] * area + (y[at] + 1) * side + x - left[frames[at]] + 1)
    frame, i, x, y = _rings(_largest(inside, side, area), side, area)
    named = spans[FRAME].iloc[starts[frame]].reset_index(drop=True)
    yield named.assign(i=i, x=x - 1 + left[frame], y=y - 1 + top[frame])
