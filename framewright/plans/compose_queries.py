"""Queries of the overlay operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import compose, frames, regions
from framewright.plans.base import Views, query
from framewright.plans.shape_queries import RING

query("g1_prepare", "select video_id, frame_idx, cast(y // 2 as int) as y, cast(x // 2 as int) as x, cast(floor(avg(v) + 1e-9) as int) as v, c from pixels8, (values (0), (1), (2)) t(c) where frame_idx % 10 = 0 group by 1, 2, 3, 4, c", "pixels8")(lambda s: compose.prepare(s.pixels8, (8, 8), 10, 2))
query("g2_highlight", "select video_id, frame_idx, y, x, case when v >= 140 then cast(trunc(128 + 127 * v / 255.0::double) as int) else v end as v from pixels8", "pixels8")(lambda s: compose.highlight(s.pixels8, s.mask8, 128))
query("g3_add", "select video_id, frame_idx, y, x, least(255, v + case when v >= 140 then 255 - v else 0 end) as v from pixels8", "pixels8")(lambda s: compose.add(s.pixels8, frames.map_values(s.pixels8, lambda v: 255 - v), s.mask8))
query("g2_highlight_channel", "select video_id, frame_idx, y, x, c, case when c = 1 and (v + 256 - 85) % 256 >= 140 then cast(trunc(100 + 155 * v / 255.0::double) as int) else v end as v from color8", "color8")(lambda s: compose.highlight(s.color8, s.mask8, 100, 1))
query("g3_unmatched", "select video_id, frame_idx, y, x from pixels8 where x = 7", "pixels8")(lambda s: compose.unmatched(s.pixels8, frames.crop(s.pixels8, 0, 0, 7, 8)))
query("g4_blend", "select video_id, frame_idx, y, x, cast(floor(0.5 * v + 0.5 * ((v * 7) % 256) + 0.5) as int) as v from pixels8", "pixels8")(lambda s: compose.blend(s.pixels8, frames.map_values(s.pixels8, lambda v: v * 7 % 256), 0.5))


def boxes(s: Views):
    k = F.col("rect_id")
    return s.rects.select("rect_id", (k % 5).cast("int").alias("left"), (k % 4).cast("int").alias("top"), (3 + k % 3).cast("int").alias("width"), (3 + k % 2).cast("int").alias("height"))


query("g5_rectangles", "with b as (select rect_id, rect_id % 5 as l, rect_id % 4 as t, 3 + rect_id % 3 as w, 3 + rect_id % 2 as h from rects) select rect_id, cast(y as int) as y, cast(x as int) as x from b, unnest(range(t, t + h)) u(y), unnest(range(l, l + w)) v(x) where x = l or y = t or x = l + w - 1 or y = t + h - 1", "rects")(lambda s: compose.rectangles(boxes(s)))


def marks(s: Views):
    k = F.col("rect_id")
    return s.rects.select(k.alias("point_id"), (k % 8).cast("double").alias("px"), ((k * 3 % 8) + 0.5).cast("double").alias("py"))


DISC = "with p as (select rect_id as point_id, (rect_id % 8)::double as px, (rect_id * 3 % 8 + 0.5)::double as py from rects) select point_id, cast(y as int) as y, cast(x as int) as x from p, range(-3, 14) u(y), range(-3, 14) v(x) where (x - px) ** 2 + (y - py) ** 2 <= 2.25"
query("g6_discs", DISC, "rects")(lambda s: compose.discs(marks(s), 1.5))
query("g6_rings", DISC + " and (x - px) ** 2 + (y - py) ** 2 > 0.25", "rects")(lambda s: compose.discs(marks(s), 1.5, 1.0))


@query("g7_polylines", """with s as (select rect_id as line_id, (rect_id % 8)::double as ax, (rect_id % 5)::double as ay, (rect_id % 7)::double as bx, (rect_id % 6)::double as by_ from rects),
t as (select *, case when (bx - ax) ** 2 + (by_ - ay) ** 2 > 0 then least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) else 0 end as f from s, range(-2, 11) u(y), range(-2, 11) v(x))
select line_id, cast(y as int) as y, cast(x as int) as x from t where (ax + f * (bx - ax) - x) ** 2 + (ay + f * (by_ - ay) - y) ** 2 <= 1""", "rects")
def g7(s: Views):
    k = F.col("rect_id")
    return compose.polylines(s.rects.select(k.alias("line_id"), *[(k % m).cast("double").alias(n) for n, m in (("x", 8), ("y", 5), ("x2", 7), ("y2", 6))]), 2.0)


def near_segments(width: float) -> str:
    """SQL of the pixels (line_id, y, x) within half a width of the segments seg (line_id, ax, ay, bx, by_)."""
    near = "case when (bx - ax) ** 2 + (by_ - ay) ** 2 > 0 then least(1, greatest(0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) ** 2 + (by_ - ay) ** 2))) else 0 end"
    span = "unnest(range(floor(least({0}, {1}))::bigint - 3, ceil(greatest({0}, {1}))::bigint + 4))"
    cells = f"select *, {near} as f from seg, {span.format('ay', 'by_')} u(y), {span.format('ax', 'bx')} v(x)"
    return f"select distinct line_id, y::int as y, x::int as x from ({cells}) where (ax + f * (bx - ax) - x) ** 2 + (ay + f * (by_ - ay) - y) ** 2 <= {width * width / 4}"


@query("g7_track_lines", f"""with p as (select curve_id as line_id, i, x / 10 as x, y / 10 as y from tracks where x > 0),
seg as (select a.line_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_ from p a join p b on a.line_id = b.line_id and b.i = a.i + 1),
marks as (select line_id, v::int as y, u::int as x from p, unnest(range(floor(y)::bigint - 3, ceil(y)::bigint + 4)) s(v), unnest(range(floor(x)::bigint - 3, ceil(x)::bigint + 4)) t(u) where (u - x) * (u - x) + (v - y) * (v - y) <= 4)
{near_segments(1.0)} union select line_id, y, x from marks""", "tracks")
def g7_tracks(s: Views):
    """Tracks as open lines on a coarse grid, broken where x is not above 0, with marks."""
    coarse = s.tracks.select(F.col("curve_id").alias("line_id"), "i", (F.col("x") / 10).alias("x"), (F.col("y") / 10).alias("y"))
    return compose.track_lines(coarse, 1.0, closed=False, marks=True)


query("g8_contour_lines", f"with {RING}, seg as (select poly_id as line_id, x::double as ax, y::double as ay, x2::double as bx, y2::double as by_ from ring) select line_id as poly_id, y, x from ({near_segments(1.0)})", "contours")(lambda s: compose.contour_lines(s.contours))
query("g8_mask_contour", "select * from mask8 m where (select count(*) from mask8 n where n.video_id = m.video_id and n.frame_idx = m.frame_idx and abs(n.y - m.y) + abs(n.x - m.x) = 1) < 4", "mask8")(lambda s: compose.mask_contour(s.mask8))
query("g9_colors", "select p_partkey as k, case p_partkey % 3 when 0 then [255, 0, 0] when 1 then [0, 0, 255] else [255, 255, 255] end as rgb, case p_partkey % 3 when 2 then 255 else 85 end as grey from part")(lambda s: s.table("part").select(F.col("p_partkey").alias("k"), F.element_at(F.array(F.lit("red"), F.lit("blue"), F.lit("white")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("name")).select("k", compose.color(F.col("name")).alias("rgb"), compose.color(F.col("name"), True).alias("grey")))


@query("g10_layers", "select video_id, frame_idx, y, x, case when y = 2 then 99 when x = 3 then 7 when v >= 140 then 255 else v end as v from pixels8", "pixels8")
def g10(s: Views):
    row = s.spark.createDataFrame([(2, x, 3, 99) for x in range(8)], "y int, x int, z int, color int")
    column = s.spark.createDataFrame([(y, 3, 2, 7) for y in range(8)], "y int, x int, z int, color int")
    return compose.layers(s.pixels8, s.mask8.withColumns({"z": F.lit(1), "color": F.lit(255)}), row, column)
