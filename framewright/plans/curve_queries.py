"""Queries of the curve operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from framewright.operators import curves
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import rounded

SEG = "seg as (select curve_id, i, x, y, lead(x) over w as x2, lead(y) over w as y2, sqrt((lead(x) over w - x) ** 2 + (lead(y) over w - y) ** 2) as length from tracks window w as (partition by curve_id order by i))"
query("e1_segments", f"with {SEG} select curve_id, i, round(length, 4) as length from seg where x2 is not null", "tracks")(lambda s: rounded(curves.segments(s.tracks).select("curve_id", "i", "length"), "length"))
query("e2_length", f"with {SEG} select curve_id, round(coalesce(sum(length), 0), 3) as length from seg group by 1", "tracks")(lambda s: rounded(curves.lengths(s.tracks), "length", digits=3))
query("e3_turning", """with a as (select curve_id, i, x - lag(x) over w as ax, y - lag(y) over w as ay, lead(x) over w - x as bx, lead(y) over w - y as by_ from tracks window w as (partition by curve_id order by i))
select curve_id, i, round(case when sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) > 0 then acos(least(1, greatest(-1, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_))))) end, 4) as angle from a where ax is not null and bx is not null""", "tracks")(lambda s: rounded(curves.turning_angles(s.tracks), "angle"))


@query("e4_translate", "select curve_id, i, x + curve_id % 5 as x, y + 1 as y from tracks", "tracks")
def e4(s: Views):
    offsets = s.tracks.select("curve_id").distinct().select("curve_id", (F.col("curve_id") % 5).cast("double").alias("dx"), F.lit(1.0).alias("dy"))
    return curves.translate(s.tracks, offsets)


@query("e5_merge", """select c.curve_id as pair_id, case when c.i < 10 then c.i else c.i end as i, x, y from (select curve_id, i, x, y from tracks where i < 10 union all select curve_id, i + 1, x, y from tracks where i >= 9) c
where exists (select 1 from tracks t where t.curve_id = c.curve_id and t.i = 9)""", "tracks")
def e5(s: Views):
    head = s.tracks.where("i < 10").select((F.col("curve_id") * 2).alias("curve_id"), "i", "x", "y")
    tail = s.tracks.where("i >= 9").select((F.col("curve_id") * 2 + 1).alias("curve_id"), (F.col("i") - 9).alias("i"), "x", "y")
    pairs = s.tracks.where("i = 9").select(F.col("curve_id").alias("pair_id"), (F.col("curve_id") * 2).alias("c1"), (F.col("curve_id") * 2 + 1).alias("c2"))
    return curves.merge_pairs(head.unionByName(tail), pairs)[0].withColumn("i", F.col("i").cast("int"))


#: The first ten points of a track and the rest, either of them turned: the joint is at the ends that the orientation names.
TURNED = {"start_start": (True, False), "start_end": (True, True), "end_end": (False, True)}


def split_tracks(s: Views, turn1: bool, turn2: bool):
    """Curves 2 * id (points 0 to 9) and 2 * id + 1 (from 9 on), turned as asked, and the pairs."""
    last = F.max("i").over(Window.partitionBy("curve_id"))
    t = s.tracks.withColumn("last", last)
    head = t.where("i < 10 and last >= 9").select((F.col("curve_id") * 2).alias("curve_id"), (9 - F.col("i") if turn1 else F.col("i")).alias("i"), "x", "y")
    tail = t.where("i >= 9").select((F.col("curve_id") * 2 + 1).alias("curve_id"), (F.col("last") - F.col("i") if turn2 else F.col("i") - 9).alias("i"), "x", "y")
    pairs = s.tracks.where("i = 9").select(F.col("curve_id").alias("pair_id"), (F.col("curve_id") * 2).alias("c1"), (F.col("curve_id") * 2 + 1).alias("c2"))
    return head.unionByName(tail), pairs


for name, turns in TURNED.items():
    # whatever way the parts are turned, merging at the named joint gives the track back, with the joint twice
    query(f"e5_merge_{name}", "select curve_id as pair_id, i + k as i, x, y from (select *, max(i) over (partition by curve_id) as last from tracks), (values (0), (1)) t(k) where last >= 9 and (k = 0 and i <= 9 or k = 1 and i >= 9)", "tracks")(lambda s, t=turns: curves.merge_pairs(*split_tracks(s, *t))[0].withColumn("i", F.col("i").cast("int")))


MEASURED = f"{SEG}, m0 as (select *, coalesce(sum(length) over (partition by curve_id order by i rows between unbounded preceding and 1 preceding), 0) as s, sum(length) over (partition by curve_id) as total from seg where length > 0), m as (select *, i = max(i) over (partition by curve_id) as final from m0)"
LERP = "round(x + least(1, greatest(0, (k * h - s) / length)) * (x2 - x), 4) as x, round(y + least(1, greatest(0, (k * h - s) / length)) * (y2 - y), 4) as y"


def sampled(h: str, count: str) -> str:
    return f"with {MEASURED}, g as (select *, {h} as h, {count} as cnt from m), grid as (select g.*, k from g, unnest(range(cast(cnt as bigint))) t(k) where k >= ceil(s / h - 1e-9) and (final or k <= ceil((s + length) / h - 1e-9) - 1)) select curve_id, cast(k as int) as i, {LERP} from grid"


query("e6_equidistant", sampled("total / 19", "20"), "tracks")(lambda s: rounded(curves.equidistant(s.tracks, 20), "x", "y"))
query("e7_spaced", sampled("total / round(total / 25)", "round(total / 25) + 1"), "tracks")(lambda s: rounded(curves.spaced(s.tracks, 25.0), "x", "y"))


@query("e8_projection", f"""with {SEG}, q as (select s.*, k as query_id, 20.0 * k as qx, 10.0 * k as qy from seg s, range(5) t(k) where x2 is not null),
t as (select *, case when length > 0 then least(1, greatest(0, ((qx - x) * (x2 - x) + (qy - y) * (y2 - y)) / (length * length))) else 0 end as f from q),
p as (select *, x + f * (x2 - x) as px, y + f * (y2 - y) as py from t), d as (select *, round(sqrt((px - qx) ** 2 + (py - qy) ** 2), 9) as dist from p)
select query_id, curve_id, round(px, 4) as px, round(py, 4) as py, round(dist, 4) as dist from d qualify row_number() over (partition by query_id, curve_id order by dist, i) = 1""", "tracks")
def e8(s: Views):
    points = s.tracks.select("curve_id").distinct().select("curve_id", F.explode(F.sequence(F.lit(0), F.lit(4)).cast("array<long>")).alias("query_id")).withColumns({"qx": 20.0 * F.col("query_id"), "qy": 10.0 * F.col("query_id")})
    return rounded(curves.projection(curves.segments(s.tracks), points), "px", "py", "dist")


@query("e9_smooth", """with w(k, g) as (select k, exp(-k * k / 2.0) from range(-3, 4) t(k)), j as (select a.curve_id, a.i, sum(b.x * g) / sum(g) as x, sum(b.y * g) / sum(g) as y from tracks a join w on true join tracks b on b.curve_id = a.curve_id and b.i = a.i + k group by 1, 2)
select curve_id, i, round(x, 4) as x, round(y, 4) as y from j""", "tracks")
def e9(s: Views):
    return rounded(curves.smooth(s.tracks, 1.0), "x", "y")


SMOOTH = "w(k, g) as (select k, exp(-k * k / 2.0) from range(-3, 4) t(k)), j as (select a.curve_id, a.i, sum(b.x * g) / sum(g) as x, sum(b.y * g) / sum(g) as y from {0} a join w on true join {0} b on b.curve_id = a.curve_id and b.i = a.i + k group by 1, 2)"
STEP = "round((coalesce(lead({0}) over o, {0}) - coalesce(lag({0}) over o, {0})) / nullif((lead({0}) over o is not null)::int + (lag({0}) over o is not null)::int, 0), 4) as {0}"
query("e9_counted", sampled("total / 19", "20").replace("with ", "with ", 1).replace(f"select curve_id, cast(k as int) as i, {LERP} from grid", f", even as (select curve_id, cast(k as int) as i, {LERP.replace('round(', '(').replace(', 4)', ')')} from grid), {SMOOTH.format('even')} select curve_id, i, round(x, 4) as x, round(y, 4) as y from j"), "tracks")(lambda s: rounded(curves.smooth(s.tracks, 1.0, count=20), "x", "y"))
query("e9_derivative", f"with {SMOOTH.format('tracks')} select curve_id, i, {STEP.format('x')}, {STEP.format('y')} from j window o as (partition by curve_id order by i)", "tracks")(lambda s: rounded(curves.smooth(s.tracks, 1.0, True), "x", "y"))

POINTS = "pts as (select rect_id as point_id, v.video_id, v.frame_idx, (rect_id % 13) * 0.5 as px, ((rect_id * 7) % 27) * 0.25 as py from rects join (select distinct video_id, frame_idx from pixels8) v on v.video_id = rect_id % 10 and v.frame_idx = rect_id % 7)"
BILINEAR = "taps as (select p.*, floor(px) + a as x, floor(py) + b as y, (case when a = 1 then px - floor(px) else 1 - px + floor(px) end) * (case when b = 1 then py - floor(py) else 1 - py + floor(py) end) as w from pts p, range(2) s(a), range(2) t(b)), val as (select t.point_id, t.video_id, t.frame_idx, sum(w * v) as v from taps t join pixels8 q on q.video_id = t.video_id and q.frame_idx = t.frame_idx and q.x = t.x and q.y = t.y where w > 0 group by 1, 2, 3)"


def sample_points(s: Views):
    k = F.col("rect_id")
    return s.rects.select(k.alias("point_id"), (k % 10).cast("int").alias("video_id"), (k % 7).cast("long").alias("frame_idx"), ((k % 13) * 0.5).cast("double").alias("px"), ((k * 7 % 27) * 0.25).cast("double").alias("py"))


query("e10_subpixel", f"with {POINTS}, {BILINEAR} select point_id, video_id, frame_idx, round(v::double, 4) as v from val", "pixels8 rects")(lambda s: rounded(curves.sample_bilinear(s.pixels8, sample_points(s)), "v"))


@query("e11_line_scan", """with f as (select distinct video_id, frame_idx, video_id * 100000 + frame_idx as scan_id from pixels8), pts as (select scan_id, pos, off, video_id, frame_idx, 1 + pos as px, 3 + off as py from f, range(6) t(pos), range(-1, 2) u(off))
select scan_id, cast(pos as int) as pos, round(avg(v), 4) as v from pts join pixels8 q using (video_id, frame_idx) where q.x = px and q.y = py group by 1, 2""", "pixels8")
def e11(s: Views):
    scans = s.frames8.select((F.col("video_id") * 100000 + F.col("frame_idx")).alias("scan_id"), "video_id", "frame_idx", F.lit(1.0).alias("x1"), F.lit(3.0).alias("y1"), F.lit(6.0).alias("x2"), F.lit(3.0).alias("y2"))
    return rounded(curves.line_scan(s.pixels8, scans, 1), "v")


@query("e12_subimage", """with g as (select distinct video_id, frame_idx, cast(a as int) as y, cast(b as int) as x, 1 + b * 0.5 as px, 1 + a * 0.5 as py from pixels8, range(11) s(a), range(11) t(b)),
taps as (select g.*, floor(px) + i as sx, floor(py) + j as sy, (case when i = 1 then px - floor(px) else 1 - px + floor(px) end) * (case when j = 1 then py - floor(py) else 1 - py + floor(py) end) as w from g, range(2) s(i), range(2) t(j))
select t.video_id, t.frame_idx, t.y, t.x, round(sum(w * v)::double, 4) as v from taps t join pixels8 q on q.video_id = t.video_id and q.frame_idx = t.frame_idx and q.x = sx and q.y = sy where w > 0 group by 1, 2, 3, 4""", "pixels8")
def e12(s: Views):
    return rounded(curves.subimage(s.pixels8, 1, 6, 1, 6, 11, 11), "v")


query("e13_steepest", "with d as (select curve_id, i, lead(y) over (partition by curve_id order by i) - y as d from tracks), b as (select curve_id, i from d where d is not null qualify row_number() over (partition by curve_id order by d desc, i) = 1) select c.curve_id, i + 0.5::double as pos from (select distinct curve_id from tracks) c left join b on b.curve_id = c.curve_id", "tracks")(lambda s: curves.steepest(s.tracks))
query("e23_simplify", """with spans(curve_id, a, b) as (select curve_id, min(i), max(i) from tracks group by 1 union all
  select curve_id, case when half = 0 then a else -(m.j) end, case when half = 0 then -(m.j) else b end from (select s.curve_id, s.a, s.b, max({'d': case when p0.x = p1.x and p0.y = p1.y then sqrt((p.x - p0.x) ** 2 + (p.y - p0.y) ** 2)
      else abs((p1.x - p0.x) * (p0.y - p.y) - (p0.x - p.x) * (p1.y - p0.y)) / sqrt((p1.x - p0.x) ** 2 + (p1.y - p0.y) ** 2) end, 'j': -p.i}) as m
    from spans s join tracks p on p.curve_id = s.curve_id and p.i > s.a and p.i < s.b join tracks p0 on p0.curve_id = s.curve_id and p0.i = s.a join tracks p1 on p1.curve_id = s.curve_id and p1.i = s.b group by all), (values (0), (1)) t(half) where m.d > 10),
kept as (select curve_id, a as i from spans union select curve_id, b from spans)
select t.* from tracks t join kept k on t.curve_id = k.curve_id and t.i = k.i""", "tracks")(lambda s: curves.simplify(s.tracks, 10.0))
query("e26_circle", """with m as (select poly_id, avg(x) as mx, avg(y) as my from contours group by 1), p as (select c.poly_id, mx, my, x - mx as u, y - my as v from contours c join m on m.poly_id = c.poly_id),
s as (select poly_id, count(*) as n, max(mx) as mx, max(my) as my, sum(u * u) as uu, sum(v * v) as vv, sum(u * v) as uv, sum(u * (u * u + v * v)) as uz, sum(v * (u * u + v * v)) as vz from p group by 1),
a as (select *, (uz * vv - vz * uv) / (2 * (uu * vv - uv * uv)) as a, (vz * uu - uz * uv) / (2 * (uu * vv - uv * uv)) as b from s where abs(uu * vv - uv * uv) > 1e-9)
select poly_id, round(a + mx, 4) as cx, round(b + my, 4) as cy, round(sqrt(a * a + b * b + (uu + vv) / n), 4) as r from a""", "contours")(lambda s: rounded(curves.circle_fit(s.contours, "poly_id"), "cx", "cy", "r"))
query("e27_runs", "with g as (select curve_id, i, i - row_number() over (partition by curve_id order by i) as g from tracks where x > 30) select curve_id, min(i) as first, max(i) + 1 as stop from g group by curve_id, g", "tracks")(lambda s: curves.runs(s.tracks, F.col("x") > 30))
query("d16_mean_profile", """with n as (select max(c) as grid from (select count(*) as c from profiles group by curve_id)), seg as (select curve_id, x, y, lead(x) over w as x2, lead(y) over w as y2, i = max(i) over (partition by curve_id) - 1 as final from profiles window w as (partition by curve_id order by i)),
g as (select k, k / (grid - 1)::double as gx, seg.*, grid from n, seg, unnest(range(grid)) t(k) where x2 > x and k >= ceil(x * (grid - 1) - 1e-9) and (final or k <= ceil(x2 * (grid - 1) - 1e-9) - 1))
select cast(k as int) as k, gx as x, round(avg(y + (gx - x) / (x2 - x) * (y2 - y)), 4) as y from g group by 1, 2""", "profiles")(lambda s: rounded(curves.mean_profile(s.profiles), "y"))
