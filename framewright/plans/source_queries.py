"""Queries of the sources, catalogues and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.functions.iterate import shared_path
from framewright.operators import frames, temporal
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import NEXT
from framewright.sources import catalog


def scratch(s: Views, name: str) -> str:
    """A new path in the shared folder that the session names."""
    return f"{shared_path(s.spark)}-{name}"


query("a1_catalogue", "select video_id, max(x) + 1 as width, max(y) + 1 as height, count(distinct frame_idx) as frame_count, false as is_color from pixels8 group by 1", "pixels8")(lambda s: catalog.video_catalogue(s.pixels8))


@query("a2_scan", "select video_id, frame_idx, y, x, v from pixels8", "pixels8")
def a2(s: Views):
    path = scratch(s, "frames")
    catalog.write_frames(s.frames8, path)
    return catalog.unpack(catalog.read_frames(s.spark, path)).drop("c")


@query("a3_images", "select 0 as video_id, dense_rank() over (order by video_id, frame_idx) - 1 as frame_idx, y, x, 0 as c, v from pixels8", "pixels8")
def a3(s: Views):
    """All frames as image files, read back as a stack."""
    path = scratch(s, "images")
    catalog.write_images(s.frames8, path)
    return catalog.read_images(s.spark, path)


query("a12_gaps", "select curve_id, min(i) filter (i > 0 and i % 5 <> 3) as leading, count(*) + 2 - max(i) filter (i > 0 and i % 5 <> 3) as trailing, count(*) + 2 - max(i) filter (i > 0 and i % 5 <> 3) < greatest(5, 0.01 * (count(*) + 3)) as ended from tracks group by 1 having max(i) > 0", "tracks")(lambda s: catalog.gaps(s.tracks.where("i > 0 and i % 5 <> 3"), "curve_id", "i", s.tracks.groupBy("curve_id").agg((F.count(F.lit(1)) + 3).alias("n")).where("n > 4")))
query("a4_concatenate", "select idx, n, coalesce(sum(n) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as \"offset\" from files", "files")(lambda s: catalog.concatenated(s.files))
query("a4_agree", "select count(distinct (25.0, 8, 8, false)) <= 1 as agree from files", "files")(lambda s: catalog.agreeing(s.files.withColumns({"fps": F.lit(25.0), "width": F.lit(8), "height": F.lit(8), "is_color": F.lit(False)})))
query("a5_contiguous", "select idx, n from (select *, idx - row_number() over (order by idx) as g from files where idx >= 1) where g = 0", "files")(lambda s: catalog.contiguous(s.files, 1))


@query("a6_glob", "select video_id, count(*) as n, count(distinct frame_idx) as frames from pixels8 group by 1", "pixels8")
def a6(s: Views):
    path = scratch(s, "glob")
    for k in (0, 1):
        s.frames8.where(F.col("video_id") % 2 == k).write.parquet(f"{path}/part-{k}")
    return catalog.unpack(catalog.read_frames(s.spark, f"{path}/part-*")).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("frame_idx").alias("frames"))


@query("a7_locate", "with o as (select idx, n, coalesce(sum(n) over (order by idx rows between unbounded preceding and 1 preceding), 0)::bigint as o from files) select frame, idx, frame - o as local from o, range(0, (select sum(n)::bigint from files), 100) t(frame) where frame >= o and frame < o + n", "files")
def a7(s: Views):
    total = s.files.agg(F.sum("n").alias("n"))
    wanted = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(100).cast("long"))).alias("frame"))
    return catalog.locate(s.files, wanted)


@query("a8_materialise", "select video_id, frame_idx, y, x, v::double as v from pixels8", "pixels8")
def a8(s: Views):
    from framewright.functions.iterate import cut

    return cut(s.pixels8.withColumn("v", F.col("v").cast("double")))


query("a9_overwrite", "select video_id, frame_idx, y, x, case when frame_idx = 0 and y = 2 then 7 else v end as v from pixels8", "pixels8")(lambda s: catalog.overwrite(s.pixels8, s.pixels8.where("frame_idx = 0 and y = 2").withColumn("v", F.lit(7))))
query("a10_noise")(lambda s: catalog.noise(s.spark, s.files.count() * 10, 8, 8, 128.0, 20.0, 7, (0, 255)))


@query("a11_refresh", "select idx, 30000 / 1001.0::double as fps, n / (30000 / 1001.0::double) as duration, idx % 2 = 1 as is_new from files", "files")
def a11(s: Views):
    rate = 30000 / 1001
    known = s.files.where("idx % 2 = 0").select("idx", F.lit(rate).alias("fps"), (F.col("n") / rate).alias("duration"))
    found = s.files.select("idx", "n", F.lit("30000/1001").alias("rate"), F.lit(None).cast("double").alias("duration"))
    return catalog.refreshed(known, found)


query("a12_fill", "with k as (select * from tracks where i % 5 <> 3), d as (select curve_id, unnest(range(min(i), max(i) + 1)) as i from k group by 1) select d.curve_id, cast(d.i as int) as i, last_value(y ignore nulls) over (partition by d.curve_id order by d.i) as y from d left join k on k.curve_id = d.curve_id and k.i = d.i", "tracks")(lambda s: catalog.filled(s.tracks.where("i % 5 <> 3"), "curve_id", "i", "y"))
query("a13_write_casts", f"select video_id, frame_idx, y, x, (v % 256 + 256) % 256 as wrapped, least(255, abs(v)) as saturated from (select video_id, y, x, frame_idx, {NEXT} - v as v from pixels8) where v is not null", "pixels8")(lambda s: temporal.difference(s.pixels8).select("video_id", "frame_idx", "y", "x", catalog.as_bytes(F.col("v"), "wrap").alias("wrapped"), catalog.as_bytes(F.col("v"), "abs_saturate").alias("saturated")))


@query("a14_save_frame", "select video_id, y, x, v from pixels8 where frame_idx = 3", "pixels8")
def a14(s: Views):
    path = scratch(s, "frame")
    s.frames8.where("frame_idx = 3").write.parquet(path)
    return catalog.unpack(catalog.read_frames(s.spark, path)).select("video_id", "y", "x", "v")


@query("a15_pack", "select video_id, sum(v * (64 * frame_idx + 8 * y + x + 1))::bigint as hash from pixels8 group by 1", "pixels8")
def a15(s: Views):
    packed = catalog.pack(s.pixels8, 8, 8)
    return catalog.unpack(packed).groupBy("video_id").agg(F.sum(F.col("v") * (64 * F.col("frame_idx") + 8 * F.col("y") + F.col("x") + 1)).alias("hash"))


query("a13_to_color", "select video_id, frame_idx, y, x, c, v from pixels8, (values (0), (1), (2)) t(c)", "pixels8")(lambda s: frames.every_nth(s.pixels8, 1).withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))))
