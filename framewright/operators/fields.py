"""Lengths of shortest ways over pixels, tile by tile.

A frame is cut into tiles of `TILE` x `TILE` pixels, one row each, which holds the box of the tile's cells only, so small frames are small rows. A round settles every tile that has news inside a task (shortest ways from all its
improved pixels, in order of length) and sends the improved pixels at its rim to the neighbouring tiles. So rounds follow the number of tiles that
a way crosses, not its pixels, and a task holds one tile at a time. A way's length is kept as whole numbers of steps of each kind, so equal lengths are exactly
equal.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.iterate import _delete, _cut, cut

TILE = 128
#: Rows of tiles that a task opens at once, and pixels that it gives out at once.
ROWS, PIXELS = 256, 1 << 16
#: Bits of a count.
DIGIT = 32
FRAME, PIXEL, KEYS = ["video_id", "frame_idx"], ["video_id", "frame_idx", "y", "x"], ["video_id", "frame_idx", "ty", "tx"]
#: (dy, dx, kind) of a step, and the lengths of the kinds.
Steps = tuple[list[tuple[int, int, int]], list[float]]


def _settle(inside: np.ndarray, counts: np.ndarray, offers: list[tuple[tuple[int, ...], int, int]], steps: Steps, base: float, lengths: dict[int, float] | None = None) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Takes the offered ways (counts, y, x) of a tile's box and all that follow from them: the counts, and the pixels (ys, xs) that are improved.

    A way's counts are the digits of one whole number here, which is ordered as they are; `lengths` keeps those of ways met before.
    """
    moves, sizes = steps
    reach = max(max(abs(dy), abs(dx)) for dy, dx, _ in moves)
    frame = np.pad(inside, reach)
    side = frame.shape[1]
    units = [1 << DIGIT * k for k in reversed(range(len(sizes)))]
    free, known, best = frame.ravel().tolist(), [-1] * frame.size, [math.inf] * frame.size
    lengths = {} if lengths is None else lengths

    def number(c: Iterable[int]) -> int:
        return sum(n * unit for n, unit in zip(c, units, strict=True))

    def length(way: int) -> float:
        total = base
        for unit, size in zip(units, sizes, strict=True):
            total += (way // unit & (1 << DIGIT) - 1) * size
        lengths[way] = total
        return total

    ys, xs = np.nonzero(counts[0] >= 0)
    for at, c in zip(((ys + reach) * side + xs + reach).tolist(), counts[:, ys, xs].T.tolist(), strict=True):
        known[at] = way = number(c)
        best[at] = lengths[way] if way in lengths else length(way)
    queue, fresh, ways = [], set(), [(dy * side + dx, units[kind]) for dy, dx, kind in moves]

    def offer(size: float, way: int, at: int) -> None:
        if size < best[at] or (size == best[at] and way < known[at]):
            best[at], known[at] = size, way
            fresh.add(at)
            heapq.heappush(queue, (size, way, at))

    for c, y, x in offers:
        if inside[y, x]:
            way = number(c)
            offer(length(way), way, (y + reach) * side + x + reach)
    while queue:
        _, way, at = heapq.heappop(queue)
        if way == known[at]:
            for step, unit in ways:
                to, longer = at + step, way + unit
                if free[to]:
                    size = lengths.get(longer) or length(longer)
                    if size <= best[to]:
                        offer(size, longer, to)
    found = np.fromiter(fresh, np.int64, len(fresh))
    ys, xs = found // side - reach, found % side - reach
    for k, unit in enumerate(units):
        counts[k, ys, xs] = [known[at] // unit & (1 << DIGIT) - 1 for at in fresh]
    return counts, (ys, xs)


def _pack(array: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(array).tobytes(), 1)


def _round(steps: Steps, base: float, first: bool, tile: int):
    """Settles the tiles that have news: rows of tiles (kind 0), and of what neighbours are told (kind 1)."""
    moves, kinds = steps[0], len(steps[1])
    reach = max(max(abs(dy), abs(dx)) for dy, dx, _ in moves)

    def opened(row: dict) -> tuple[list[int], np.ndarray, np.ndarray, list]:
        """The box (top, left, height, width) of the tile's cells, those, their counts, and the ways that they are offered."""
        if first:
            ys, xs = np.asarray(row["ys"]), np.asarray(row["xs"])
            top, left = int(ys.min()), int(xs.min())
            box = [top, left, int(ys.max()) - top + 1, int(xs.max()) - left + 1]
            inside = np.zeros(box[2:], bool)
            inside[ys - top, xs - left] = True
            starts = np.flatnonzero(np.asarray(row["seeds"], bool))
            return box, inside, np.full((kinds, *box[2:]), -1, np.int32), [((0,) * kinds, int(ys[k]) - top, int(xs[k]) - left) for k in starts]
        top, left, height, width = box = [int(v) for v in row["box"]]
        inside = np.frombuffer(zlib.decompress(row["inside"]), bool).reshape(height, width)
        counts = np.frombuffer(zlib.decompress(row["counts"]), np.int32).reshape(kinds, height, width).copy()
        offers = []
        for news in row["news"]:
            for y, x, *c in np.frombuffer(zlib.decompress(news), np.int32).reshape(-1, 2 + kinds).tolist():
                for dy, dx, kind in moves:
                    ny, nx = y - top + dy, x - left + dx
                    if 0 <= ny < height and 0 <= nx < width:
                        offers.append(((*c[:kind], c[kind] + 1, *c[kind + 1 :]), ny, nx))
        return box, inside, counts, offers

    def told(row: dict, box: list[int], counts: np.ndarray, pixels: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple]:
        """The improved pixels within a step of each neighbour."""
        ys, xs = pixels
        up, aside = ys + box[0] - row["ty"] * tile, xs + box[1] - row["tx"] * tile
        beside_y, beside_x = ({s: v for s, v in ((-1, at < reach), (0, np.True_), (1, at >= tile - reach)) if v.any()} for at in (up, aside))
        for sy, low in beside_y.items():
            for sx, left in beside_x.items():
                rim = np.flatnonzero(low & left) if sy or sx else ()
                if len(rim):
                    y, x = ys[rim], xs[rim]
                    yield row["ty"] + sy, row["tx"] + sx, _pack(np.stack([y + box[0], x + box[1], *counts[:, y, x]], axis=1).astype(np.int32))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                out, lengths = [], {}
                for row in frame.iloc[start : start + ROWS].to_dict("records"):
                    ids = [row["video_id"], row["frame_idx"]]
                    if not first and row["news"] is None:
                        out.append((*ids, row["ty"], row["tx"], 0, row["box"], row["inside"], row["counts"]))
                        continue
                    box, inside, counts, offers = opened(row)
                    counts, pixels = _settle(inside, counts, offers, steps, base, lengths)
                    out.append((*ids, row["ty"], row["tx"], 0, box, _pack(inside), _pack(counts)))
                    out += [(*ids, ty, tx, 1, None, None, news) for ty, tx, news in told(row, box, counts, pixels)]
                yield pd.DataFrame(out, columns=[*FRAME, "ty", "tx", "kind", "box", "inside", "counts"])

    return run


def _gathered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles (ys, xs, seeds) of cells that come in the tiles' order, a piece of `ROWS` tiles and about `PIXELS` cells at most at a time; a tile may come in several batches."""
    rest = None

    def pieces(cells: pd.DataFrame, starts: list[int]) -> Iterator[pd.DataFrame]:
        ys, xs, seeds = (cells[c].to_numpy() for c in ("y", "x", "seed"))
        ends, first = [*starts[1:], len(cells)], 0
        for k, end in enumerate(ends):
            if k + 1 == len(ends) or k + 1 - first == ROWS or end - starts[first] >= PIXELS:
                bounds = list(zip(starts[first : k + 1], ends[first : k + 1], strict=True))
                yield cells.iloc[starts[first : k + 1]][KEYS].assign(**{n: [v[i:j] for i, j in bounds] for n, v in (("ys", ys), ("xs", xs), ("seeds", seeds))})
                first = k + 1

    for frame in frames:
        if not len(frame):
            continue
        cells = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        marks = [pd.factorize(cells[c])[0] for c in KEYS]
        starts = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()]
        rest = cells.iloc[starts[-1] :].drop_duplicates()
        if len(starts) > 1:
            yield from pieces(cells.iloc[: starts[-1]], starts[:-1])
    if rest is not None:
        yield from pieces(rest, [0])


def _boxed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The tiles as packed boxes; a seed has a place in the box, but is no cell by itself."""
    for frame in _gathered(frames):
        out = []
        for video, number, ty, tx, ys, xs, seeds in frame.itertuples(index=False, name=None):
            top, left = int(ys.min()), int(xs.min())
            inside = np.zeros((int(ys.max()) - top + 1, int(xs.max()) - left + 1), bool)
            inside[ys[~seeds] - top, xs[~seeds] - left] = True
            out.append((video, number, ty, tx, [top, left, *inside.shape], _pack(inside)))
        yield pd.DataFrame(out, columns=[*FRAME, "ty", "tx", "box", "inside"])


def _reopened(tile: int):
    """The tiles (ys, xs, seeds) of packed boxes and the seeds (sy, sx) of their frames; tiles with neither are left out."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                out = []
                for video, number, ty, tx, box, packed, sy, sx in frame.iloc[start : start + ROWS].itertuples(index=False, name=None):
                    ys, xs = np.nonzero(np.frombuffer(zlib.decompress(packed), bool).reshape(box[2:]))
                    sy, sx = np.asarray(sy), np.asarray(sx)
                    own = (sy // tile == ty) & (sx // tile == tx)
                    ys, xs = np.concatenate([ys + box[0], sy[own]]), np.concatenate([xs + box[1], sx[own]])
                    if len(ys):
                        out.append((video, number, ty, tx, ys, xs, np.arange(len(ys)) >= len(ys) - own.sum()))
                if out:
                    yield pd.DataFrame(out, columns=[*FRAME, "ty", "tx", "ys", "xs", "seeds"])

    return run


def _farthest(steps: Steps, base: float):
    """The pixels of each tile that may be the farthest of their frame, by a distance of nine digits."""
    ahead = _lengths(steps)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), ROWS):
                for found in ahead(iter([frame.iloc[start : start + ROWS]])):
                    if not len(found):
                        continue
                    length = base
                    for counts, size in zip(np.stack(found["counts"].to_numpy()).T, steps[1], strict=True):
                        length = length + counts * size
                    most = pd.Series(length).groupby([found[c].to_numpy() for c in FRAME], dropna=False).transform("max").to_numpy()
                    yield found[length >= most - 2e-9]

    return run


def _lengths(steps: Steps):
    """The reached pixels of the tiles, with their counts."""
    kinds = len(steps[1])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            parts, held = [], 0
            for video, number, box, packed in zip(frame["video_id"], frame["frame_idx"], frame["box"], frame["counts"], strict=True):
                counts = np.frombuffer(zlib.decompress(packed), np.int32).reshape(kinds, *box[2:])
                ys, xs = np.nonzero(counts[0] >= 0)
                parts.append((np.full(len(ys), video), np.full(len(ys), number), ys + box[0], xs + box[1], counts[:, ys, xs].T))
                held += len(ys)
                if held >= PIXELS:
                    yield _rows(parts)
                    parts, held = [], 0
            if parts:
                yield _rows(parts)

    return run


def _rows(parts: list[tuple]) -> pd.DataFrame:
    *columns, counts = (np.concatenate(c) for c in zip(*parts, strict=True))
    return pd.DataFrame(dict(zip(PIXEL, columns, strict=True))).assign(counts=list(counts))


def _dealt(cells: DataFrame, seeds: DataFrame, tile: int) -> DataFrame:
    """Cells and seeds in the order of their tiles: one shuffle, and no tile as a list."""
    every = cells.select(*PIXEL, F.lit(False).alias("seed")).unionByName(seeds.select(*PIXEL, F.lit(True).alias("seed")))
    placed = every.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    return placed.repartition(*KEYS).sortWithinPartitions(*KEYS)


def _types(rows: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in rows.schema}


def _settled(opened: DataFrame, pieces: Callable, steps: Steps, base: float, tile: int) -> DataFrame:
    """The tiles at their end: rounds from the rows that `pieces` makes tiles (ys, xs, seeds) of, while there is news."""
    kinds = _types(opened)
    schema = f"video_id {kinds['video_id']}, frame_idx {kinds['frame_idx']}, ty int, tx int, kind int, box array<int>, inside binary, counts binary"
    begin = _round(steps, base, True, tile)
    now, path = _cut(opened.mapInPandas(lambda frames: begin(pieces(frames)), schema))
    while True:
        news = now.where("kind = 1").groupBy(*KEYS).agg(F.collect_list("counts").alias("news"))
        state = now.where("kind = 0")
        if not news.join(state, KEYS, "left_semi").take(1):
            return state
        after, last = state.select(*KEYS, "box", "inside", "counts").join(news, KEYS, "left"), path
        now, path = _cut(after.mapInPandas(_round(steps, base, False, tile), schema))
        _delete(now.sparkSession, last)


def _measured(found: DataFrame, steps: Steps, base: float) -> DataFrame:
    length = F.lit(base)
    for k, size in enumerate(steps[1]):
        length = length + F.get("counts", F.lit(k)) * F.lit(size)
    return found.select(*PIXEL, "counts", length.alias("d"))


def ways(cells: DataFrame, seeds: DataFrame, steps: Steps, base: float = 0.0, tile: int = TILE) -> DataFrame:
    """video_id, frame_idx, y, x, counts, d of every cell that a way from the seeds reaches: steps of each kind, and base plus their length.

    Ways lead from cell to cell; seeds are cells, too. Of ways of one length that with the fewest steps of the first kind counts, and so on. Cells without a way have no row.
    """
    kinds = _types(cells)
    state = _settled(_dealt(cells, seeds, tile), _gathered, steps, base, tile)
    found = state.select(*FRAME, "box", "counts").mapInPandas(_lengths(steps), ", ".join(f"{n} {kinds[n]}" for n in PIXEL) + ", counts array<int>")
    return _measured(cut(found), steps, base)


def tiles(cells: DataFrame, seeds: DataFrame, tile: int = TILE) -> DataFrame:
    """The packed tiles of the cells, with places for the seeds: what sweeps from several seeds start from."""
    kinds = _types(cells)
    return _dealt(cells, seeds, tile).mapInPandas(_boxed, f"video_id {kinds['video_id']}, frame_idx {kinds['frame_idx']}, ty int, tx int, box array<int>, inside binary")


def farthest(boxes: DataFrame, seeds: DataFrame, steps: Steps, base: float = 0.0, tile: int = TILE) -> DataFrame:
    """Of the rows of `ways` those that may be their frame's farthest, for the cells of `tiles` and the seeds; pixels stay in their tiles. Frames without seeds are left out."""
    starts = seeds.groupBy(*FRAME).agg(F.collect_set(F.struct("y", "x")).alias("s"))
    opened = boxes.join(starts, FRAME).select(*KEYS, "box", "inside", F.col("s.y").alias("sy"), F.col("s.x").alias("sx"))
    state, kinds = _settled(opened, _reopened(tile), steps, base, tile), _types(seeds)
    found = state.select(*FRAME, "box", "counts").mapInPandas(_farthest(steps, base), ", ".join(f"{n} {kinds[n]}" for n in PIXEL) + ", counts array<int>")
    return _measured(found, steps, base)
