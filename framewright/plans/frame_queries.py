"""Queries of the frame-axis, consecutive-frame and temporal operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions import kernels
from framewright.operators import frames, temporal
from framewright.plans.base import Views, query


def sql_table(table: list[tuple[int, int, float]], name: str) -> str:
    """A weight table as a CTE."""
    return f"{name}(d, s, w) as (values {', '.join(f'({d}, {s}, {w!r}::double)' for d, s, w in table)})"


def sql_separable(rows: list, columns: list) -> str:
    return f"with {sql_table(rows, 'tr')}, {sql_table(columns, 'tc')} select video_id, frame_idx, tr.d as y, tc.d as x, round(sum(v * tr.w * tc.w), 4) as v from pixels8 join tr on tr.s = y join tc on tc.s = x group by 1, 2, 3, 4"


def rounded(df, *names, digits=4):
    return df.withColumns({n: F.round(n, digits) for n in names})


@query("b1_map", "select video_id, frame_idx, y, x, 255 - v as v from pixels8", "pixels8")
def b1(s: Views):
    return frames.map_values(s.pixels8, lambda v: 255 - v)


@query("b2_normalize", """select p.video_id, frame_idx, y, x, cast(case when hi > lo then trunc((least(greatest(v, lo), hi) - lo) * 255.0::double / (hi - lo)) else 0 end as int) as v
from pixels8 p join (select video_id, min(v)::double lo, max(v)::double hi from pixels8 where frame_idx = 0 group by 1) b on p.video_id = b.video_id""", "pixels8")
def b2(s: Views):
    return frames.normalize(s.pixels8)


@query("b3_crop", "select video_id, frame_idx, y - 2 as y, x - 1 as x, v from pixels8 where x >= 1 and x < 5 and y >= 2 and y < 7", "pixels8")
def b3(s: Views):
    return frames.crop(s.pixels8, 1, 2, 4, 5)


@query("b3_crop_shares", "select video_id, frame_idx, y - 2 as y, x - 2 as x, v from pixels8 where x between 2 and 5 and y between 2 and 5", "pixels8")
def b3_shares(s: Views):
    return frames.crop_by(s.pixels8, s.videos8, (0.25, 0.25, 0.5, 0.5))


@query("b4_region", "select video_id, frame_idx, y - 4 as y, x - 4 as x, v from pixels8 where x >= 4 and y >= 4", "pixels8")
def b4(s: Views):
    return frames.crop_region(s.pixels8, s.videos8, "lower right")


@query("b5_channel", "select video_id, frame_idx, y, x, v from color8 where c = 1", "color8")
def b5(s: Views):
    return frames.channel(s.color8, 1)


@query("b6_align", "select video_id, frame_idx, y - 2 as y, x - 1 as x, v from pixels8 where x between 1 and 4 and y between 2 and 7", "pixels8")
def b6(s: Views):
    return frames.crop_by(s.pixels8, s.videos8, (1, 2, 4, 5), align=2)


@query("b7_grey", "select video_id, frame_idx, y, x, cast(floor(avg(v)) as int) as v from color8 group by 1, 2, 3, 4", "color8")
def b7(s: Views):
    return frames.grey(s.color8)


for angle, (ny, nx) in {90: ("7 - x", "y"), 180: ("7 - y", "7 - x"), 270: ("x", "7 - y")}.items():
    query(f"b8_rotate{angle}", f"select video_id, frame_idx, {ny} as y, {nx} as x, v from pixels8", "pixels8")(lambda s, a=angle: frames.rotate(s.pixels8, s.videos8, a))

for name, to, method in (("area", 4, "area"), ("nearest", 16, "nearest"), ("linear", 16, "linear"), ("cubic", 16, "cubic"), ("lanczos", 16, "lanczos")):
    weights = kernels.resampling(8, to, method)
    query(f"b9_resize_{name}", sql_separable(weights, weights), "pixels8")(lambda s, n=to, m=method: rounded(frames.resize(s.pixels8, (8, 8), (n, n), m), "v"))

blur_weights = kernels.convolution(kernels.gaussian(1.0), 8)
query("b10_blur", sql_separable(blur_weights, blur_weights), "pixels8")(lambda s: rounded(frames.blur(s.pixels8, (8, 8), 1.0), "v"))


@query("b11_replicate", "select p.video_id, frame_idx + k * frame_count as frame_idx, y, x, v from pixels8 p join videos8 on videos8.video_id = p.video_id, range(3) t(k)", "videos8")
def b11(s: Views):
    return frames.replicate(s.pixels8, s.videos8, 3)


for name, c in (("fast", 2.5), ("slow", 0.5)):
    query(f"b12_drop_frames_{name}", f"select p.video_id, i as frame_idx, y, x, v from videos8 w, unnest(range(cast(floor((frame_count - 1) / {c}) as bigint) + 1)) t(i) join pixels8 p on p.video_id = w.video_id and p.frame_idx = cast(floor(i * {c}::double) as bigint)", "videos8")(lambda s, k=c: frames.drop_frames(s.pixels8, s.videos8, k))

query("b13_slice", "select video_id, (frame_idx - 2) // 3 as frame_idx, y, x, v from pixels8 where frame_idx >= 2 and frame_idx < 40 and (frame_idx - 2) % 3 = 0", "pixels8")(lambda s: frames.cut(s.pixels8, s.videos8, 2, 40, 3))
query("b13_reverse", "select p.video_id, frame_count - 1 - frame_idx as frame_idx, y, x, v from pixels8 p join videos8 w on w.video_id = p.video_id", "videos8")(lambda s: frames.cut(s.pixels8, s.videos8, None, None, -1))


@query("b14_get_frames", "select p.video_id, frame_idx, idx, y, x, v from pixels8 p join videos8 w on w.video_id = p.video_id, (values (0), (-1), (5)) t(idx) where frame_idx = case when idx < 0 then idx + frame_count else idx end", "videos8")
def b14(s: Views):
    return frames.get_frames(s.pixels8, s.videos8, s.spark.createDataFrame([(0,), (-1,), (5,)], "idx int"))


query("b15_every_nth", "select * from pixels8 where frame_idx % 10 = 0", "pixels8")(lambda s: frames.every_nth(s.pixels8, 10))
query("b16_border", "select video_id, frame_idx, y, x, case when x < 1 or y < 1 or x >= 7 or y >= 7 then 0 else v end as v from pixels8", "pixels8")(lambda s: frames.border(s.pixels8, s.videos8, 1, 0))
query("b17_class_grey", "select video_id, frame_idx, y, x, (v % 4 + 1) * 63 as v from pixels8", "pixels8")(lambda s: frames.class_to_grey(frames.map_values(s.pixels8, lambda v: v % 4)))
query("b18_named", "select video_id, frame_idx, y, x, v as raw, v * 2 as double, v * v as square from pixels8", "pixels8")(lambda s: frames.named_columns(s.pixels8, {"double": lambda v: v * 2, "square": lambda v: v * v}))


@query("b19_fork", sql_separable(blur_weights, blur_weights).replace("select video_id", ", b as (select video_id", 1) + ") select p.video_id, p.frame_idx, p.y, p.x, p.v as v1, b.v as v2 from pixels8 p join b on b.video_id = p.video_id and b.frame_idx = p.frame_idx and b.y = p.y and b.x = p.x where p.y < 4 and p.x < 4", "pixels8")
def b19(s: Views):
    return frames.zip_branches(frames.crop(s.pixels8, 0, 0, 4, 4), rounded(frames.blur(s.pixels8, (8, 8), 1.0), "v"))


query("b19_out_of_step", "select distinct video_id, frame_idx from pixels8 where frame_idx % 10 <> 0", "pixels8")(lambda s: frames.out_of_step(s.pixels8, frames.every_nth(s.pixels8, 10)))
query("b20_observe", "select * from pixels8", "pixels8")(lambda s: frames.observed(s.pixels8, "frames_seen", F.count(F.lit(1)).alias("pixels"), F.max("v").alias("brightest")))

NEXT = "lead(v) over (partition by video_id, y, x order by frame_idx)"
query("c1_compare", f"select * from (select video_id, y, x, frame_idx, case when {NEXT} is not null then greatest({NEXT}, v) end as v from pixels8) where v is not null", "pixels8")(lambda s: temporal.compare(s.pixels8, lambda this, previous: F.greatest(this, previous)))
query("c2_difference", f"select * from (select video_id, y, x, frame_idx, {NEXT} - v as v from pixels8) where v is not null", "pixels8")(lambda s: temporal.difference(s.pixels8))


@query("c2_packed", f"select video_id, frame_idx, list(v order by y, x) as data from (select video_id, y, x, frame_idx, {NEXT} - v as v from pixels8) where v is not null group by 1, 2", "pixels8")
def c2_packed(s: Views):
    return temporal.packed_difference(s.frames8)


gradient = kernels.convolution([-0.5, 0.0, 0.5], 8)


@query("c3_motion", f"""with {sql_table(gradient, 'g')},
ax as (select video_id, frame_idx, y, d as x, sum(v * w) as ix from pixels8 join g on s = x group by all), ay as (select video_id, frame_idx, d as y, x, sum(v * w) as iy from pixels8 join g on s = y group by all),
dt as (select * from (select video_id, y, x, frame_idx, {NEXT} - v as it from pixels8) where it is not null),
p as (select video_id, frame_idx, y, x, ix, iy, it from dt join ax using (video_id, frame_idx, y, x) join ay using (video_id, frame_idx, y, x)),
m as (select video_id, frame_idx, y + dy as y, x + dx as x, sum(ix * ix) xx, sum(iy * iy) yy, sum(ix * iy) xy, sum(ix * it) xt, sum(iy * it) yt from p, (values (-1), (0), (1)) a(dy), (values (-1), (0), (1)) b(dx) group by all)
select video_id, frame_idx, y, x, round(case when abs(xx * yy - xy * xy) > 1e-9 then sqrt(((xy * yt - yy * xt) / (xx * yy - xy * xy)) ** 2 + ((xy * xt - xx * yt) / (xx * yy - xy * xy)) ** 2) end, 4) as v from m where y between 0 and 7 and x between 0 and 7""", "pixels8")
def c3(s: Views):
    return rounded(temporal.motion(s.pixels8, 8, 8, 1), "v")


query("d1_reduce_max", "select frame_idx is null as never, y, x, v from (select null as frame_idx, y, x, max(v) as v from raster group by 2, 3)", "raster")(lambda s: temporal.reduce_time(s.raster, "max").select(F.lit(True).alias("never"), "y", "x", "v"))


@query("d1_fold", "select video_id, y, x, round(list_reduce(list(v::double order by frame_idx), lambda acc, v: acc * 0.5 + v), 4) as v from pixels8 group by 1, 2, 3", "pixels8")
def d1(s: Views):
    return rounded(temporal.fold(s.pixels8, lambda v, acc: acc * 0.5 + v), "v")


query("d2_mean", "select video_id, y, x, round(avg(v), 6) as mean from pixels8 group by 1, 2, 3", "pixels8")(lambda s: rounded(temporal.mean(s.pixels8), "mean", digits=6))
query("d3_mean_std", "select video_id, y, x, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from pixels8 group by 1, 2, 3", "pixels8")(lambda s: rounded(temporal.mean_std(s.pixels8), "mean", "std", digits=6))
query("d3_flagship", f"select video_id, y, x, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std from (select video_id, y - 2 as y, x - 1 as x, {NEXT} - v as v from pixels8 where x >= 1 and x < 5 and y >= 2 and y < 7) group by 1, 2, 3", "pixels8")(lambda s: rounded(temporal.mean_std(temporal.difference(frames.crop(s.pixels8, 1, 2, 4, 5))), "mean", "std", digits=6))
query("d15_range", "select video_id, min(v) as lo, max(v) as hi from pixels8 group by 1", "pixels8")(lambda s: temporal.value_range(s.pixels8))
