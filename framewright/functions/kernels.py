"""Weight tables for separable kernels, and the joins that apply them.

Tables are computed on the driver from literal sizes (a few entries for each row or column of a frame), so their size is
bounded by the kernel and the frame, never by the number of frames; they are broadcast, so a plan's size does not depend on them. Each pixel
is joined with the taps it contributes to and the destinations are summed. No sample leaves its frame, so pixels that are dealt by
frame once need no further shuffle, whatever the number of passes.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a weight table that may be broadcast (16 bytes each).
MAX_TAPS = 1 << 20
#: Offsets (dy, dx) of the four and the eight neighbours.
FOUR = [(-1, 0), (0, -1), (0, 1), (1, 0)]
EIGHT = [(-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)]


def box(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)]


def ellipse(radius: int) -> list[tuple[int, int]]:
    """Rows of half-width round(radius * sqrt(1 - dy^2 / radius^2))."""
    halves = {dy: round(radius * math.sqrt(1 - dy * dy / radius**2)) for dy in range(-radius, radius + 1)}
    return [(dy, dx) for dy, half in halves.items() for dx in range(-half, half + 1)]


def reflect(i: int, n: int) -> int:
    """Index behind a border that mirrors without repeating the edge."""
    while n > 1 and not 0 <= i < n:
        i = -i if i < 0 else 2 * (n - 1) - i
    return i if n > 1 else 0


def _merge(taps: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    total: dict[tuple[int, int], float] = {}
    for dst, src, w in taps:
        total[dst, src] = total.get((dst, src), 0.0) + w
    return [(d, s, w) for (d, s), w in sorted(total.items()) if w]


def convolution(weights: list[float], n: int) -> list[tuple[int, int, float]]:
    """(dst, src, weight) of a centred kernel on an axis of n cells with mirrored borders."""
    half = len(weights) // 2
    return _merge([(d, reflect(d + k - half, n), w) for d in range(n) for k, w in enumerate(weights)])


def gaussian(sigma: float) -> list[float]:
    half = math.ceil(3 * sigma)
    raw = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-half, half + 1)]
    return [w / sum(raw) for w in raw]


def _cubic(t: float, a: float = -0.75) -> float:
    t = abs(t)
    return (a + 2) * t**3 - (a + 3) * t**2 + 1 if t <= 1 else a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a if t < 2 else 0.0


def _lanczos(t: float, a: int = 4) -> float:
    return 1.0 if t == 0 else a * math.sin(math.pi * t) * math.sin(math.pi * t / a) / (math.pi * t) ** 2 if abs(t) < a else 0.0


def resampling(n: int, m: int, method: str) -> list[tuple[int, int, float]]:
    """(dst, src, weight) from n to m cells: nearest, linear, area, cubic or lanczos (edges repeat)."""
    ratio, taps = n / m, []
    for d in range(m):
        if method == "nearest":
            taps.append((d, min(n - 1, int(d * ratio)), 1.0))
        elif method == "area":
            low, high = d * ratio, (d + 1) * ratio
            taps += [(d, s, (min(high, s + 1) - max(low, s)) / ratio) for s in range(int(low), min(n, math.ceil(high))) if min(high, s + 1) > max(low, s)]
        else:
            reach, kernel = {"linear": (1, lambda t: max(0.0, 1 - abs(t))), "cubic": (2, _cubic), "lanczos": (4, _lanczos)}[method]
            at = (d + 0.5) * ratio - 0.5
            own = [(s, kernel(at - s)) for s in range(math.floor(at) - reach + 1, math.floor(at) + reach + 1)]
            taps += [(d, min(n - 1, max(0, s)), w / sum(w for _, w in own)) for s, w in own]
    return _merge(taps)


def by_frame(pixels: DataFrame) -> DataFrame:
    """The pixels dealt by frame: whatever is grouped by the frame and more needs no further shuffle."""
    return pixels.repartition("video_id", "frame_idx")


def apply_axis(pixels: DataFrame, axis: str, table: list[tuple[int, int, float]], value: str = "v") -> DataFrame:
    """One pass of a separable kernel along `axis`: sums weight * value by destination. Other columns are the keys.

    The table, a few rows for each row or column of a frame, is broadcast; one of over MAX_TAPS rows is joined as Spark decides.
    """
    taps = pa.table({"__s": pa.array([s for _, s, _ in table], pa.int32()), "__d": pa.array([d for d, _, _ in table], pa.int32()), "__w": pa.array([w for _, _, w in table], pa.float64())})
    weights = pixels.sparkSession.createDataFrame(taps)
    keys = [c for c in pixels.columns if c not in (axis, value)]
    far = pixels.join(F.broadcast(weights) if len(table) <= MAX_TAPS else weights, pixels[axis] == weights["__s"])
    return far.groupBy(*keys, F.col("__d").alias(axis)).agg(F.sum(F.col("__w") * F.col(value).cast("double")).alias(value))


def separable(pixels: DataFrame, rows: list, columns: list, value: str = "v", dealt: bool = False) -> DataFrame:
    """Both passes in one shuffle, by frame; none if the pixels are `dealt` by frame already."""
    dealt_out = pixels if dealt else by_frame(pixels)
    return apply_axis(apply_axis(dealt_out, "y", rows, value), "x", columns, value)


def spread(pixels: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Every pixel once for each offset, at the neighbour it contributes to; `oy`, `ox` say from where it came."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    rest = [c for c in pixels.columns if c not in ("y", "x")]
    far = pixels.select(*rest, F.col("y").alias("oy"), F.col("x").alias("ox"), F.explode(moves).alias("__m"))
    return far.select(*rest, (F.col("oy") + F.col("__m.dy")).alias("y"), (F.col("ox") + F.col("__m.dx")).alias("x"), "oy", "ox")


def inside(height: int | Column, width: int | Column) -> Column:
    return (F.col("y") >= 0) & (F.col("y") < height) & (F.col("x") >= 0) & (F.col("x") < width)
