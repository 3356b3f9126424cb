"""Queries of the region operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import kernels
from framewright.operators import regions
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import rounded


def offsets_sql(offsets: list[tuple[int, int]]) -> str:
    return f"(values {', '.join(f'({dy}, {dx})' for dy, dx in offsets)}) o(dy, dx)"


KEY = "video_id, frame_idx"
INSIDE = "y between 0 and 7 and x between 0 and 7"


def statistics_sql(offsets: list[tuple[int, int]]) -> str:
    n = len(offsets)
    return f"""with m as (select {KEY}, avg(v) as prior from pixels8 group by all),
s as (select p.video_id, p.frame_idx, p.y + dy as y, p.x + dx as x, max(prior) as prior, sum(v - prior) as s1, sum((v - prior) * (v - prior)) as s2 from pixels8 p join m on m.video_id = p.video_id and m.frame_idx = p.frame_idx, {offsets_sql(offsets)} group by 1, 2, 3, 4)
select {KEY}, y, x, round(s1 / {n} + prior, 4) as mean, round((s2 - s1 * s1 / {n}) / {n - 1}, 3) as var from s where {INSIDE}"""


for name, taps in (("box", kernels.box(1)), ("box_no_centre", kernels.EIGHT), ("ellipse", kernels.ellipse(2))):
    query(f"d4_statistics_{name}", statistics_sql(taps), "pixels8")(lambda s, t=taps: rounded(rounded(regions.local_statistics(s.pixels8, 8, 8, t), "mean"), "var", digits=3))

CROSS_SQL = offsets_sql(regions.CROSS)
query("d6_dilate", f"select distinct {KEY}, y + dy as y, x + dx as x from mask8, {CROSS_SQL} where y + dy between 0 and 7 and x + dx between 0 and 7", "mask8")(lambda s: regions.dilate(s.mask8, 8, 8, regions.CROSS))
query("d6_erode", f"select m.* from mask8 m where not exists (select 1 from {CROSS_SQL} where m.y + dy between 0 and 7 and m.x + dx between 0 and 7 and (m.video_id, m.frame_idx, m.y + dy, m.x + dx) not in (select video_id, frame_idx, y, x from mask8))", "mask8")(lambda s: regions.erode(s.mask8, 8, 8, regions.CROSS))

AROUND = f"with a as (select {KEY}, y + dy as y, x + dx as x, max(case when dy = 0 and dx = 0 then v end) as v, max(v) as most, min(v) as least, max(case when dy <> 0 or dx <> 0 then v end) as others from pixels8, {offsets_sql(kernels.box(1))} group by 1, 2, 3, 4)"
query("d7_peaks", f"{AROUND} select {KEY}, y, x from a where v = most and not (most = 0 and least = 0)", "pixels8")(lambda s: regions.peaks(s.pixels8, 8, 8))
query("d7_peaks_negative", f"{AROUND.replace('from pixels8', 'from (select * replace (v - 255 as v) from pixels8)')} select {KEY}, y, x from a where v = most and not (most = 0 and least = 0)", "pixels8")(lambda s: regions.peaks(s.pixels8.withColumn("v", F.col("v") - 255), 8, 8))
query("d8_strict_peaks", f"{AROUND} select {KEY}, y, x from a where v > others and y between 1 and 6 and x between 1 and 6", "pixels8")(lambda s: regions.strict_peaks(s.pixels8, 8, 8))

REACH = f"""reach(video_id, frame_idx, y, x, cell) as (select {KEY}, y, x, y * 8 + x from mask8
  union select m.video_id, m.frame_idx, m.y, m.x, r.cell from reach r, {offsets_sql(kernels.FOUR)}, mask8 m where m.video_id = r.video_id and m.frame_idx = r.frame_idx and m.y = r.y + dy and m.x = r.x + dx),
least_cell as (select {KEY}, y, x, min(cell) as cell from reach group by all),
labels as (select {KEY}, y, x, cast(dense_rank() over (partition by {KEY} order by cell) as int) as label from least_cell),
areas as (select {KEY}, label, count(*) as area from labels group by all),
best as (select {KEY}, label, area from areas qualify row_number() over (partition by {KEY} order by area desc, label) = 1)"""
query("d9_label", f"with {REACH} select * from labels", "mask8")(lambda s: regions.label(s.mask8))
query("d10_largest", f"with {REACH} select {KEY}, y, x, area from labels join best using (video_id, frame_idx, label)", "mask8")(lambda s: regions.largest_region(regions.label(s.mask8)))

MOMENTS = f"{REACH}, mom as (select {KEY}, label, count(*) as m00, sum(x)::bigint as m10, sum(y)::bigint as m01, sum(x * x)::bigint as m20, sum(x * y)::bigint as m11, sum(y * y)::bigint as m02 from labels group by all), mu as (select *, round(m20 - m10 * m10 / m00, 9) as mu20, round(m11 - m10 * m01 / m00, 9) as mu11, round(m02 - m01 * m01 / m00, 9) as mu02 from mom), ab as (select *, mu20 / m00 as a, mu11 / m00 as b, mu02 / m00 as c from mu), eig as (select *, a + c + sqrt(4 * b * b + (a - c) * (a - c)) as big, greatest(a + c - sqrt(4 * b * b + (a - c) * (a - c)), 0) as small from ab)"


@query("d11_moments", f"with {MOMENTS} select {KEY}, label, m00, m10, m01, m20, m11, m02, m00 as area, round(m10 / m00, 6) as cx, round(m01 / m00, 6) as cy from mom", "mask8")
def d11(s: Views):
    return rounded(regions.centroid(regions.moments(regions.label(s.mask8))), "cx", "cy", digits=6)


@query("d12_orientation", f"with {MOMENTS} select {KEY}, label, round(case when abs(mu20 - mu02) < 1e-9 then case when mu11 > 0 then -pi() / 4 else pi() / 4 end else -atan2(2 * mu11, mu20 - mu02) / 2 end, 4) + 0.0 as orientation from eig", "mask8")
def d12(s: Views):
    return rounded(regions.shape_figures(regions.moments(regions.label(s.mask8))).select(*regions.FRAME, "label", "orientation"), "orientation").withColumn("orientation", F.col("orientation") + 0.0)


@query("d13_axes", f"with {MOMENTS} select {KEY}, label, round(case when big > 0 then sqrt(1 - small / big) else 0 end, 3) as eccentricity, round(4 * sqrt(big), 4) as major, round(4 * sqrt(small), 2) as minor from eig", "mask8")
def d13(s: Views):
    figures = regions.shape_figures(regions.moments(regions.label(s.mask8))).select(*regions.FRAME, "label", "eccentricity", "major", "minor")
    return rounded(rounded(rounded(figures, "eccentricity", digits=3), "major"), "minor", digits=2)


query("d14_bounding_box", f'with {REACH} select {KEY}, label, min(x) - 1 as "left", min(y) - 1 as top, max(x) - min(x) + 3 as width, max(y) - min(y) + 3 as height from labels group by all', "mask8")(lambda s: regions.bounding_box(regions.label(s.mask8), 1))


def few(s: Views):
    """The largest region of every frame, and its first pixel as seed."""
    region = regions.largest_region(regions.label(s.mask8)).select(*regions.PIXEL)
    first = region.groupBy(*regions.FRAME).agg(F.min(F.struct("y", "x")).alias("p")).select(*regions.FRAME, "p.y", "p.x")
    return region, first


WAYS = f"""{REACH},
region as (select {KEY}, y, x from labels join best using (video_id, frame_idx, label)),
seed as (select {KEY}, min(y * 8 + x) // 8 as y, min(y * 8 + x) % 8 as x from region group by all),
ways(video_id, frame_idx, y, x, a, b) as (select {KEY}, y, x, 0, 0 from seed
  union select m.video_id, m.frame_idx, m.y, m.x, min(a + (dy * dx = 0)::int), min(b + (dy * dx <> 0)::int) from ways w, {offsets_sql(kernels.EIGHT)}, region m where m.video_id = w.video_id and m.frame_idx = w.frame_idx and m.y = w.y + dy and m.x = w.x + dx and w.a + w.b < 16 group by m.video_id, m.frame_idx, m.y, m.x, a + (dy * dx = 0)::int, b + (dy * dx <> 0)::int),
dist as (select {KEY}, y, x, min(2 + a + b * sqrt(2)) as d from ways group by all)"""


@query("d17_distance_map", f"with {WAYS} select {KEY}, y, x, round(d, 6) as d from dist", "mask8")
def d17(s: Views):
    region, first = few(s)
    return rounded(regions.distance_map(region, first).select(*regions.PIXEL, "d"), "d", digits=6)


STEEP = f"""{WAYS}, best_step as (select e.video_id, e.frame_idx, e.y, e.x, n.y as ny, n.x as nx from dist e join dist n on e.video_id = n.video_id and e.frame_idx = n.frame_idx and greatest(abs(e.y - n.y), abs(e.x - n.x)) = 1 where round(e.d - n.d, 9) > 0
  qualify row_number() over (partition by e.video_id, e.frame_idx, e.y, e.x order by round((e.d - n.d) / sqrt((e.y - n.y) ** 2 + (e.x - n.x) ** 2), 9) desc, n.y, n.x) = 1),
far_end as (select {KEY}, y, x from dist qualify row_number() over (partition by {KEY} order by round(d, 9) desc, y desc, x desc) = 1),
path(video_id, frame_idx, y, x, pos) as (select {KEY}, y, x, 0::bigint from far_end union all select p.video_id, p.frame_idx, ny, nx, pos + 1 from path p join best_step b on b.video_id = p.video_id and b.frame_idx = p.frame_idx and b.y = p.y and b.x = p.x)"""


@query("d18_descent_path", f"with {STEEP} select * from path", "mask8")
def d18(s: Views):
    dist = regions.distance_map(*few(s))
    return regions.walk(regions.farthest_pixel(dist), regions.steepest(dist))


#: Lengths between all pixels of a region: reaches of 1, 2, 4, ... 64 steps.
ALL_WAYS = f"""{REACH},
region as (select {KEY}, y, x, y * 8 + x as c from labels join best using (video_id, frame_idx, label)),
reach0 as (select a.video_id, a.frame_idx, a.c as s, b.c as t, case when a.c = b.c then 0 when a.y = b.y or a.x = b.x then 1 else sqrt(2) end as d
  from region a join region b on a.video_id = b.video_id and a.frame_idx = b.frame_idx and greatest(abs(a.y - b.y), abs(a.x - b.x)) <= 1),
{''.join(f"reach{k + 1} as (select a.video_id, a.frame_idx, a.s, b.t, min(a.d + b.d) as d from reach{k} a join reach{k} b on a.video_id = b.video_id and a.frame_idx = b.frame_idx and a.t = b.s group by all)," + chr(10) for k in range(6))}
farthest as (select {KEY}, s, max({{'d': round(2 + d, 9), 't': t}}) as f from reach6 group by all),
sweeps(video_id, frame_idx, p1, p2, d) as (select {KEY}, s, f.t, f.d from farthest qualify row_number() over (partition by {KEY} order by s) = 1
  union all select w.video_id, w.frame_idx, w.p2, n.f.t, n.f.d from sweeps w join farthest n on w.video_id = n.video_id and w.frame_idx = n.frame_idx and w.p2 = n.s where n.f.d > w.d),
pair as (select * from sweeps qualify row_number() over (partition by {KEY} order by d desc) = 1)"""


@query("d19_farthest_pair", f"with {ALL_WAYS} select {KEY}, p1 // 8 as y1, p1 % 8 as x1, p2 // 8 as y2, p2 % 8 as x2, round(d, 6) as d from pair", "mask8")
def d19(s: Views):
    return rounded(regions.farthest_pair(*few(s)), "d", digits=6)


@query("d20_background_distance", f"""with t as (select frame_idx, video_id, y, x from mask8), cells as (select distinct {KEY}, a as y, b as x from t, range(8) u(a), range(8) w(b)),
bg as (select * from cells except select {KEY}, y, x from t), pairs as (select t.video_id, t.frame_idx, t.y, t.x, greatest(abs(t.y - q.y), abs(t.x - q.x)) as g, least(abs(t.y - q.y), abs(t.x - q.x)) as l from t join bg q on t.video_id = q.video_id and t.frame_idx = q.frame_idx)
select {KEY}, y, x, round(min(case when g >= 2 * l then l * 2.1969 + (g - 2 * l) else (g - l) * 2.1969 + (2 * l - g) * 1.4 end)::double, 4) as d from pairs group by all""", "mask8")
def d20(s: Views):
    return rounded(regions.background_distance(s.mask8, 8, 8), "d")


#: A frame as a row of 100 characters, with a rim of one cell; a cell and its eight neighbours in turn, clockwise from the one above.
CELLS = "list_transform(range(100), lambda c: [substr(m, (c + k)::bigint + 1, 1) = '1' for k in [0, -10, -9, 1, 11, 10, 9, -1, -11]])"
TURNS = " + ".join(f"(not n[{a}] and (n[{b}] or n[{c}]))::int" for a, b, c in ((2, 3, 4), (4, 5, 6), (6, 7, 8), (8, 9, 2)))
PAIRS = ", ".join(" + ".join(f"(n[{a}] or n[{b}])::int" for a, b in group) for group in (((9, 2), (3, 4), (5, 6), (7, 8)), ((2, 3), (4, 5), (6, 7), (8, 9))))


def _kept(side: str) -> str:
    """A frame after a half round."""
    stays = f"n[1] and not ({TURNS} = 1 and least({PAIRS}) between 2 and 3 and not ({side}))"
    return f"array_to_string(list_transform({CELLS}, lambda n: case when {stays} then '1' else '0' end), '')"


THINNED = f"""cells as (select {KEY}, list((y + 1) * 10 + x + 1) as inside from mask8 group by all),
halves(video_id, frame_idx, k, m) as (select {KEY}, 0, array_to_string(list_transform(range(100), lambda c: case when list_contains(inside, c) then '1' else '0' end), '') from cells
  union all select {KEY}, k + 1, case when k % 2 = 0 then {_kept("(n[6] or n[7] or not n[9]) and n[8]")} else {_kept("(n[2] or n[3] or not n[5]) and n[4]")} end from halves where k < 32)"""

query("d5_thin_guo_hall", f"with {THINNED} select {KEY}, (c // 10 - 1)::int as y, (c % 10 - 1)::int as x from halves, range(100) t(c) where k = 32 and substr(m, c + 1, 1) = '1'", "mask8")(lambda s: regions.thin_guo_hall(s.mask8))
query("d19_farthest_path", f"""with {ALL_WAYS}, dist as (select r.video_id, r.frame_idx, (r.t // 8)::int as y, (r.t % 8)::int as x, 2 + r.d as d from reach6 r join pair p on r.video_id = p.video_id and r.frame_idx = p.frame_idx and r.s = p.p1),
best_step as (select e.video_id, e.frame_idx, e.y, e.x, n.y as ny, n.x as nx from dist e join dist n on e.video_id = n.video_id and e.frame_idx = n.frame_idx and greatest(abs(e.y - n.y), abs(e.x - n.x)) = 1 where round(e.d - n.d, 9) > 0
  qualify row_number() over (partition by e.video_id, e.frame_idx, e.y, e.x order by round((e.d - n.d) / sqrt((e.y - n.y) ** 2 + (e.x - n.x) ** 2), 9) desc, n.y, n.x) = 1),
path(video_id, frame_idx, y, x, pos) as (select {KEY}, (p2 // 8)::int, (p2 % 8)::int, 0::bigint from pair
  union all select p.video_id, p.frame_idx, ny, nx, pos + 1 from path p join best_step b on b.video_id = p.video_id and b.frame_idx = p.frame_idx and b.y = p.y and b.x = p.x)
select * from path""", "mask8")(lambda s: regions.farthest_path(*few(s)))


@query("d17_distance_to_end", f"with {WAYS}, goal as (select {KEY}, max(y * 8 + x) as cell from region group by all), stop as (select d.video_id, d.frame_idx, d.d from dist d join goal g on d.video_id = g.video_id and d.frame_idx = g.frame_idx and d.y * 8 + d.x = g.cell) select d.video_id, d.frame_idx, d.y, d.x, round(d.d, 6) as d from dist d join stop s on d.video_id = s.video_id and d.frame_idx = s.frame_idx and d.d <= s.d + 1e-9", "mask8")
def d17_end(s: Views):
    region, first = few(s)
    last = region.groupBy(*regions.FRAME).agg(F.max(F.struct("y", "x")).alias("p")).select(*regions.FRAME, "p.y", "p.x")
    return rounded(regions.distance_map(region, first, last).select(*regions.PIXEL, "d"), "d", digits=6)


def thinned_sql(source: str, size: int) -> str:
    """CTEs eroded and opened, and the select of the skeleton, of a mask `source` in frames of `size` x `size`."""
    inside = f"1 + (y + dy > 0)::int + (y + dy < {size - 1})::int + (x + dx > 0)::int + (x + dx < {size - 1})::int"
    cross = offsets_sql(regions.CROSS)
    return f"""eroded(k, video_id, frame_idx, y, x) as (select 0, {KEY}, y, x from {source}
  union all select k + 1, {KEY}, y + dy, x + dx from eroded, {cross} where k < {size} group by k, {KEY}, y + dy, x + dx having count(*) = {inside}),
opened as (select distinct k - 1 as k, {KEY}, y + dy as y, x + dx as x from eroded, {cross} where k > 0)
select distinct {KEY}, y, x from eroded e where k < {size} and not exists (select 1 from opened o where o.k = e.k and o.video_id = e.video_id and o.frame_idx = e.frame_idx and o.y = e.y and o.x = e.x)"""


query("d5_thin", f"with {thinned_sql('mask8', 8)}", "mask8")(lambda s: regions.thin(s.mask8, 8, 8))
query("f2_neighbours", f"select m.video_id, m.frame_idx, m.y, m.x, count(n.y) as n from mask8 m left join mask8 n on n.video_id = m.video_id and n.frame_idx = m.frame_idx and greatest(abs(n.y - m.y), abs(n.x - m.x)) = 1 group by all", "mask8")(lambda s: neighbour_counts(s.mask8))


def neighbour_counts(mask):
    """Eight-neighbour counts of mask pixels."""
    own = (F.col("oy") == F.col("y")) & (F.col("ox") == F.col("x"))
    near = kernels.spread(mask, kernels.box(1)).groupBy(*regions.PIXEL).agg((F.count(F.lit(1)) - 1).alias("n"), F.max(own).alias("own"))
    return near.where("own").drop("own")
