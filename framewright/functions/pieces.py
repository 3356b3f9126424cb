"""Small frames whole in tasks, many at a time.

The spans of a frame (video_id, frame_idx, y, x0, x1: pixels of a row, which may overlap) come to one task in order. A task opens pieces of whole frames, `PIXELS` pixels or one
frame at most, and works on all frames of a piece at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.iterate import cut

FRAME = ["video_id", "frame_idx"]
#: Pixels that a task opens at once, and pixels of a task: few bytes, but much work.
PIXELS, TASK = 1 << 18, 1 << 20
#: Spans of a piece and the number of each one's frame, from 0 on.
Work = Callable[[pd.DataFrame, np.ndarray], Iterator[pd.DataFrame]]


def split(spans: DataFrame, large: Column) -> tuple[DataFrame, int, DataFrame | None]:
    """The spans of the frames for which `large` (of `n`, the pixels of a frame, and `area`, its box) does not hold, the pixels of all frames, and the mask of
    those for which it does, if there are any. Spans that lack a value are left out."""
    found = cut(spans.select(*FRAME, "y", "x0", "x1").where("video_id is not null and frame_idx is not null and y is not null and x0 <= x1"))
    wide, high = ((F.max(b).cast("long") - F.min(a) + 1) for a, b in (("x0", "x1"), ("y", "y")))
    sizes = found.groupBy(*FRAME).agg(F.sum(F.col("x1").cast("long") - F.col("x0") + 1).alias("n"), (wide * high).alias("area"))
    pixels, some = sizes.agg(F.sum("n"), F.max(large)).first()
    if not some:
        return found, pixels or 0, None
    those = cut(sizes.where(large).select(*FRAME))
    mask = found.join(those, FRAME, "left_semi").select(*FRAME, "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct()
    return found.join(those, FRAME, "left_anti"), pixels, mask


def cells(spans: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The pixels of the spans: the place of the span and x of each."""
    wide = spans["x1"].to_numpy(np.int64) - spans["x0"].to_numpy(np.int64) + 1
    inner = np.arange(wide.sum()) - np.repeat(np.cumsum(wide) - wide, wide)
    return np.repeat(np.arange(len(spans)), wide), np.repeat(spans["x0"].to_numpy(np.int64), wide) + inner


def pieces(batches: Iterator[pd.DataFrame], work: Work) -> Iterator[pd.DataFrame]:
    """The results for spans that come frame by frame; a frame may come in several batches."""
    rest = None
    for batch in batches:
        spans = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(spans):
            continue
        marks = [spans[c].to_numpy() for c in FRAME]
        starts = [0, *(np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1).tolist()]
        yield from _whole(spans.iloc[: starts[-1]], work)
        rest = spans.iloc[starts[-1] :]
    if rest is not None:
        yield from _whole(rest, work)


def _whole(spans: pd.DataFrame, work: Work) -> Iterator[pd.DataFrame]:
    """The results for whole frames, a piece of about `PIXELS` pixels at a time."""
    if not len(spans):
        return
    changed = np.any([np.diff(pd.factorize(spans[c])[0], prepend=-1) != 0 for c in FRAME], axis=0)
    frames = np.cumsum(changed) - 1
    before = np.cumsum(spans["x1"].to_numpy(np.int64) - spans["x0"].to_numpy(np.int64) + 1)
    starts = np.append(np.flatnonzero(changed), len(spans))
    first = 0
    while first + 1 < len(starts):
        begun = before[starts[first] - 1] if starts[first] else 0
        last = max(first + 1, int(np.searchsorted(before[starts[first + 1 :] - 1], begun + PIXELS, "right")) + first)
        yield from work(spans.iloc[starts[first] : starts[last]], frames[starts[first] : starts[last]] - first)
        first = last


def whole_frames(spans: DataFrame, pixels: int, work: Work, columns: str) -> DataFrame:
    """What `work` makes of the frames (`pixels` in all): video_id, frame_idx and `columns`."""
    kinds = {f.name: f.dataType.simpleString() for f in spans.schema}
    dealt = spans.repartition(max(1, -(-pixels // TASK)), *FRAME).sortWithinPartitions(*FRAME)
    return dealt.mapInPandas(lambda batches: pieces(batches, work), f"video_id {kinds['video_id']}, frame_idx {kinds['frame_idx']}, {columns}")
