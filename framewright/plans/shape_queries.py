"""Queries of the spatial joins and shape measures."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from framewright.functions import kernels
from framewright.operators import shapes
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import rounded, sql_table
from framewright.plans.region_queries import KEY, REACH

query("e14_bounding_rects", "select curve_id, min(x) - 2 as x, min(y) - 2 as y, max(x) - min(x) + 4 as w, max(y) - min(y) + 4 as h from tracks group by 1", "tracks")(lambda s: shapes.bounding_rects(s.tracks, "curve_id", 2.0))


query("e14_inclusive", "select curve_id, min(x) as x, min(y) as y, max(x) - min(x) + 1 as w, max(y) - min(y) + 1 as h from tracks group by 1", "tracks")(lambda s: shapes.bounding_rects(s.tracks, "curve_id", 0.0, True))


@query("e15_points_in_rects", "select t.curve_id, t.i, r.rect_id from tracks t join rects r on t.x between r.x and r.x + r.w and t.y between r.y and r.y + r.h", "tracks rects")
def e15(s: Views):
    return shapes.points_in_rects(s.tracks, s.rects, 20.0).select("curve_id", "i", "rect_id")


@query("e16_overlaps", "select a.rect_id as a, b.rect_id as b, greatest(a.x, b.x) as x, greatest(a.y, b.y) as y, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) as w, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) as h from rects a join rects b on a.rect_id < b.rect_id and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h", "rects")
def e16(s: Views):
    return shapes.overlaps(s.rects, 40.0)


BOXES = [(k, [k % 4, 5 * k, 1100 + 200 * k], [5, 10, 300]) for k in range(10)]


@query("e17_cuboids", f"with b(id, x0, y0, t0) as (values {', '.join(f'({k}, {p[0]}, {p[1]}, {p[2]})' for k, p, _ in BOXES)}) select id, 15000.0::double as volume, count(*) as n, sum(v)::bigint as total, min(v) as lo, max(v) as hi from raster join b on x >= x0 and x < x0 + 5 and y >= y0 and y < y0 + 10 and frame_idx >= t0 and frame_idx < t0 + 300 group by 1", "raster")
def e17(s: Views):
    return shapes.cuboid_statistics(s.raster, s.spark.createDataFrame(BOXES, "id int, pos array<int>, size array<int>"))


@query("e18_template", "with t as (select y, x, v as t from pixels8 where video_id = 0 and frame_idx = 0 and y < 3 and x < 3), o as (select cast(a as int) as dy, cast(b as int) as dx from range(6) s(a), range(6) u(b)) select p.video_id, p.frame_idx, dy, dx, sum((v - t) * (v - t))::bigint as ssd, count(*) as n from pixels8 p, t, o where p.y = t.y + dy and p.x = t.x + dx group by all", "pixels8")
def e18(s: Views):
    template = s.pixels8.where("video_id = 0 and frame_idx = 0 and y < 3 and x < 3").select("y", "x", F.col("v").alias("t"))
    positions = s.spark.createDataFrame([(a, b) for a in range(6) for b in range(6)], "dy int, dx int")
    return shapes.template_match(s.pixels8, template, positions)


RING = "ring as (select poly_id, i, x, y, coalesce(lead(x) over w, first(x) over (partition by poly_id order by i)) as x2, coalesce(lead(y) over w, first(y) over (partition by poly_id order by i)) as y2 from contours window w as (partition by poly_id order by i))"


@query("e19_polygon", f"with {RING}, s as (select poly_id, sum(x * y2 - x2 * y) / 2 as a, sum(sqrt((x2 - x) ** 2 + (y2 - y) ** 2)) as p, sum((x + x2) * (x * y2 - x2 * y)) as sx, sum((y + y2) * (x * y2 - x2 * y)) as sy from ring group by 1) select poly_id, abs(a) as area, round(p, 4) as perimeter, round(sx / (6 * a), 4) as cx, round(sy / (6 * a), 4) as cy from s", "contours")
def e19(s: Views):
    return rounded(shapes.polygon_measures(s.contours), "perimeter", "cx", "cy")


TERMS = {"m00": "c / 2", "m10": "(x + x2) * c / 6", "m01": "(y + y2) * c / 6", "m20": "(x * x + x * x2 + x2 * x2) * c / 12", "m11": "(x * (2 * y + y2) + x2 * (y + 2 * y2)) * c / 24", "m02": "(y * y + y * y2 + y2 * y2) * c / 12"}
query("e20_contour_moments", f"with {RING}, c as (select *, (x * y2 - x2 * y)::double as c from ring) select poly_id, {', '.join(f'round(sum({e}), 3) as {n}' for n, e in TERMS.items())} from c group by 1", "contours")(lambda s: rounded(shapes.contour_moments(s.contours), *TERMS, digits=3))


query("e20_eccentricity", f"with {RING}, c as (select *, (x * y2 - x2 * y)::double as c from ring), m as (select poly_id, {', '.join(f'sum({e}) as {n}' for n, e in TERMS.items())} from c group by 1), t as (select poly_id, round(m20 / m00 - (m10 / m00) ** 2, 9) as a, round(m11 / m00 - m10 * m01 / m00 ** 2, 9) as b, round(m02 / m00 - (m01 / m00) ** 2, 9) as c from m where m00 <> 0), g as (select poly_id, a + c + sqrt(4 * b * b + (a - c) ** 2) as big, greatest(a + c - sqrt(4 * b * b + (a - c) ** 2), 0) as small from t) select poly_id, round(case when big > 0 then sqrt(1 - small / big) end, 3) as eccentricity from g", "contours")(lambda s: rounded(shapes.contour_eccentricity(s.contours), "eccentricity", digits=3))


@query("e21_in_polygon", f"with {RING}, p as (select a * 100 + b as point_id, a as px, b as py from range(40, 61) s(a), range(40, 61) t(b)) select poly_id, point_id from ring, p group by 1, 2 having sum(((y > py) <> (y2 > py) and px < (x2 - x) * (py - y) / (y2 - y)::double + x)::int) % 2 = 1", "contours")
def e21(s: Views):
    grid = s.spark.range(21 * 21).select((40 + F.floor(F.col("id") / 21)).alias("a"), (40 + F.col("id") % 21).alias("b"))
    points = grid.select((F.col("a") * 100 + F.col("b")).alias("point_id"), F.col("a").cast("double").alias("px"), F.col("b").cast("double").alias("py"))
    return shapes.points_in_polygons(points, s.contours, 8.0)


#: The pixels of the polygons, as CTEs and a select.
RASTER = f"""{RING}, rows_ as (select poly_id, cast(r as int) as r, x + (r - y) * (x2 - x) / (y2 - y)::double as px, r < greatest(y, y2) as counts from ring, unnest(range(least(y, y2), greatest(y, y2) + 1)) t(r) where y <> y2),
sp as (select poly_id, r, px, row_number() over w as k, lead(px) over w as stop from rows_ where counts window w as (partition by poly_id, r order by px)),
raster_ as (select distinct poly_id, r as y, cast(x as int) as x from sp, unnest(range(cast(ceil(px) as bigint), cast(floor(stop) as bigint) + 1)) t(x) where k % 2 = 1 and stop is not null
  union select poly_id, r, cast(round(px) as int) from rows_ union select poly_id, cast(y as int), cast(q as int) from ring, unnest(range(least(x, x2), greatest(x, x2) + 1)) t(q) where y = y2)"""


@query("e22_rasterize", f"with {RASTER} select * from raster_", "contours")
def e22(s: Views):
    return shapes.rasterize(s.contours)


query("e24_simplify_contours")(lambda s: shapes.simplify_contours(s.contours, 30.0))
#: Rings of pixel sides: each side goes on with the one that turns right, straight on or left, in this order.
OUTLINES = f"""{REACH},
region as (select {KEY}, y, x from labels join best using (video_id, frame_idx, label)),
sides(k, dy, dx, sy, sx, ey, ex) as (values (0, -1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1, 1), (2, 1, 0, 1, 1, 1, 0), (3, 0, -1, 1, 0, 0, 0)),
side as (select {KEY}, k, y + sy as sy, x + sx as sx, y + ey as ey, x + ex as ex, ((y + sy)::bigint * 16777216 + x + sx) * 4 + k as node from region r, sides
  where not exists (select 1 from region q where q.video_id = r.video_id and q.frame_idx = r.frame_idx and q.y = r.y + dy and q.x = r.x + dx)),
turns as (select a.video_id, a.frame_idx, a.node, min({{'t': case (b.k - a.k + 4) % 4 when 1 then 0 when 0 then 1 else 2 end, 'n': b.node}}).n as next
  from side a join side b on a.video_id = b.video_id and a.frame_idx = b.frame_idx and a.ey = b.sy and a.ex = b.sx group by all),
reached(video_id, frame_idx, node, there) as (select {KEY}, node, next from turns union select r.video_id, r.frame_idx, r.node, t.next from reached r join turns t on r.video_id = t.video_id and r.frame_idx = t.frame_idx and r.there = t.node),
lows as (select distinct {KEY}, low from (select {KEY}, node, min(there) as low from reached group by all)),
walked(video_id, frame_idx, low, node, i) as (select {KEY}, low, low, 0 from lows
  union all select w.video_id, w.frame_idx, low, t.next, i + 1 from walked w join turns t on w.video_id = t.video_id and w.frame_idx = t.frame_idx and w.node = t.node where t.next <> low),
corners as (select w.video_id, w.frame_idx, low, i, sx as x, sy as y from walked w join side s using (video_id, frame_idx, node)),
shoe as (select *, x * coalesce(lead(y) over w, first(y) over v) - coalesce(lead(x) over w, first(x) over v) * y as c from corners window w as (partition by {KEY}, low order by i), v as (partition by {KEY}, low order by i rows between unbounded preceding and unbounded following)),
widest as (select {KEY}, low from shoe group by {KEY}, low qualify row_number() over (partition by {KEY} order by abs(sum(c)) desc, low) = 1)"""

query("e25_outlines", f"with {OUTLINES} select {KEY}, i, x, y from corners join widest using (video_id, frame_idx, low)", "mask8")(lambda s: shapes.region_outlines(s.mask8))


def neighbours(s: Views):
    ids = s.contours.select("poly_id").distinct()
    return ids.select(F.col("poly_id").alias("p1"), (F.col("poly_id") + 1).alias("p2"))


CROSS = f"{RING}, a as (select poly_id as p1, x::double as ax, y::double as ay, x2::double as bx, y2::double as by_ from ring), b as (select poly_id - 1 as p1, poly_id as p2, x::double as cx, y::double as cy, x2::double as dx, y2::double as dy from ring)"


@query("e28_intersections", f"""with {CROSS}, j as (select *, (bx - ax) * (dy - cy) - (by_ - ay) * (dx - cx) as det, (cx - ax) * (by_ - ay) - (cy - ay) * (bx - ax) as side, greatest(least(ax, bx), least(cx, dx)) as l, least(greatest(ax, bx), greatest(cx, dx)) as r, greatest(least(ay, by_), least(cy, dy)) as tp, least(greatest(ay, by_), greatest(cy, dy)) as bt from a join b using (p1)),
o as (select distinct p1, p2 from j where l <= r and tp <= bt and det = 0 and side = 0 and (l < r or tp < bt)), h as (select *, ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / det as t, side / det as u from j where l <= r and tp <= bt and det <> 0)
select distinct p1, p2, round(ax + t * (bx - ax), 6) as x, round(ay + t * (by_ - ay), 6) as y from h where t between 0 and 1 and u between 0 and 1 and (p1, p2) not in (select p1, p2 from o)""", "contours")
def e28(s: Views):
    return shapes.intersections(neighbours(s), shapes.ring_edges(s.contours))


ANGLES = [0.1 + k * 0.39 for k in range(16)]
HITS = f"""{RING}, ang(k, angle) as (values {', '.join(f'({k}, {a!r}::double)' for k, a in enumerate(ANGLES))}), rays as (select c.poly_id, k, angle, c.x::double as ax, c.y::double as ay, c.x + 1000 * cos(angle) as bx, c.y + 1000 * sin(angle) as by_ from (select poly_id, 50.5 as x, 50.25 as y from contours where i = 0) c, ang),
hit as (select r.*, ((x - ax) * (y2 - y) - (y - ay) * (x2 - x)) / ((bx - ax) * (y2 - y) - (by_ - ay) * (x2 - x)) as t, ((x - ax) * (by_ - ay) - (y - ay) * (bx - ax)) / ((bx - ax) * (y2 - y) - (by_ - ay) * (x2 - x)) as u from rays r join ring g on g.poly_id = r.poly_id where (bx - ax) * (y2 - y) - (by_ - ay) * (x2 - x) <> 0),
firsts as (select poly_id, k, angle, min(t) * 1000 as dist, min_by(ax + t * (bx - ax), t) as hx, min_by(ay + t * (by_ - ay), t) as hy from hit where t between 0 and 1 and u between 0 and 1 group by 1, 2, 3)"""


def hits(s: Views):
    anchors = s.contours.where("i = 0").select(F.col("poly_id").alias("anchor_id"), "poly_id", F.lit(50.5).alias("x"), F.lit(50.25).alias("y"))
    return shapes.ray_hits(shapes.fan(anchors, ANGLES), shapes.ring_edges(s.contours))


@query("e29_ray_hits", f"with {HITS} select poly_id, k, round(hx, 4) as hx, round(hy, 4) as hy, round(dist, 4) as dist from firsts where k = 3", "contours")
def e29(s: Views):
    return rounded(hits(s).where("ray_id.k = 3").select("poly_id", F.col("ray_id.k").alias("k"), "hx", "hy", "dist"), "hx", "hy", "dist")


@query("e30_ray_fan", f"with {HITS} select poly_id, k, round(hx, 4) as hx, round(hy, 4) as hy, round(dist, 4) as dist from firsts", "contours")
def e30(s: Views):
    return rounded(hits(s).select("poly_id", F.col("ray_id.k").alias("k"), "hx", "hy", "dist"), "hx", "hy", "dist")


@query("e31_farthest_hit", f"with {HITS} select poly_id as anchor_id, round(hx, 4) as hx, round(hy, 4) as hy, round(dist, 4) as dist, angle from firsts qualify row_number() over (partition by poly_id order by round(dist, 9) desc, k) = 1", "contours")
def e31(s: Views):
    return rounded(shapes.farthest_hit(hits(s)), "hx", "hy", "dist")


def circles(s: Views):
    return s.rects.select(F.col("rect_id").alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("w") / 2).alias("r"))


query("e33_circle_points", "with c as (select rect_id as id, x as cx, y as cy, w / 2 as r, greatest(4, cast(round(2 * pi() * w / 2 / 3) as int)) as n from rects) select id, cast(i as int) as i, round(cx + r * cos(2 * pi() * i / n), 4) as x, round(cy + r * sin(2 * pi() * i / n), 4) as y from c, unnest(range(n)) t(i)", "rects")(lambda s: rounded(shapes.arc_points(circles(s), 3.0), "x", "y"))
def half_arcs(s: Views):
    return s.rects.select(F.col("rect_id").alias("id"), F.col("x").alias("cx"), F.col("y").alias("cy"), (F.col("w") / 2).alias("r"), F.lit(0.0).alias("start"), F.lit(math.pi).alias("stop"))


query("e33_half_arcs", "select rect_id as id, round(pi() * w / 2, 4) as length, round(pi() * w * w / 8, 4) as area, round(x, 4) as mx, round(y + w / pi(), 4) as my, round(x - w / 2, 4) as x, round(y, 4) as y, round(w, 4) as w, round(w / 2, 4) as h, 0.0::double as tx, 1.0::double as ty from rects", "rects")(lambda s: rounded(shapes.arc_figures(half_arcs(s)), "length", "area", "mx", "my", "x", "y", "w", "h").withColumns({"tx": F.round("tx", 9) + 0.0, "ty": F.round("ty", 9)}))
query("e33_circle_figures", "select rect_id as id, round(pi() * w * w / 4, 4) as area, round(pi() * w, 4) as perimeter, x - w / 2 as x, y - w / 2 as y, w, w as h from rects", "rects")(lambda s: rounded(shapes.circle_figures(circles(s)), "area", "perimeter"))

soft, slope, gauss = kernels.convolution([1.0, 4.0, 6.0, 4.0, 1.0], 8), kernels.convolution([-1.0, -2.0, 0.0, 2.0, 1.0], 8), kernels.convolution(kernels.gaussian(1.0), 8)


@query("e34_gradients", f"""with {sql_table(soft, 'sf')}, {sql_table(slope, 'sl')}, {sql_table(gauss, 'ga')}, b as (select video_id, frame_idx, a.d as y, b.d as x, sum(v * a.w * b.w) as v from pixels8 join ga a on a.s = y join ga b on b.s = x group by all),
gx as (select video_id, frame_idx, a.d as y, b.d as x, sum(v * a.w * b.w) as gx from b p join sf a on a.s = p.y join sl b on b.s = p.x group by all), gy as (select video_id, frame_idx, a.d as y, b.d as x, sum(v * a.w * b.w) as gy from b p join sl a on a.s = p.y join sf b on b.s = p.x group by all)
select video_id, frame_idx, y, x, round(gx, 3) as gx, round(gy, 3) as gy from gx join gy using (video_id, frame_idx, y, x)""", "pixels8")
def e34(s: Views):
    return rounded(shapes.gradients(s.pixels8, 8, 8, 1.0), "gx", "gy", digits=3)
