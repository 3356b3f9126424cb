"""Registered queries: the views they read, and the same views as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(key: str, sql: str | None = None, views: str = ""):
    """Registers a function of Views under a key; `views` are the SQL views (names) that `sql` reads."""

    def keep(function: Callable) -> Callable:
        REGISTRY[key] = (function, None if sql is None else with_views(views.split(), sql))
        return function

    return keep


class Views:
    """The input relations of the queries, derived from the driver's tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def frames8(self) -> DataFrame:
        """Packed grey 8x8 frames: video_id, frame_idx, height, width, channels, data."""
        by_video = Window.partitionBy("label").orderBy("vec_id")
        value = F.transform("embedding", lambda e: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((e.cast("double") + 0.6) * 212.5).cast("int"))))
        return self.table("embeddings").select(F.col("label").alias("video_id"), (F.row_number().over(by_video) - 1).cast("long").alias("frame_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(1).alias("channels"), value.alias("data"))

    @cached_property
    def pixels8(self) -> DataFrame:
        """The frames' pixels, 64 rows a frame; joins shuffle them, as Spark judges them by the size of the frames."""
        p = self.frames8.select("video_id", "frame_idx", F.posexplode("data").alias("p", "v"))
        return p.select("video_id", "frame_idx", F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).alias("x"), "v").hint("merge")

    @cached_property
    def mask8(self) -> DataFrame:
        return self.pixels8.where("v >= 140").select("video_id", "frame_idx", "y", "x")

    @cached_property
    def color8(self) -> DataFrame:
        return self.pixels8.select("video_id", "frame_idx", "y", "x", F.explode(F.array(*map(F.lit, range(3)))).alias("c"), F.col("v").alias("g")).select("video_id", "frame_idx", "y", "x", "c", ((F.col("g") + 85 * F.col("c")) % 256).alias("v"))

    @cached_property
    def videos8(self) -> DataFrame:
        return self.frames8.groupBy("video_id").agg(F.max("width").alias("width"), F.max("height").alias("height"), F.count(F.lit(1)).alias("frame_count"))

    @cached_property
    def raster(self) -> DataFrame:
        day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("long")
        return self.table("lineitem").groupBy(day.alias("frame_idx"), F.col("l_quantity").cast("int").alias("y"), F.round(F.col("l_discount") * 100).cast("int").alias("x")).agg(F.count(F.lit(1)).cast("int").alias("v"))

    @cached_property
    def tracks(self) -> DataFrame:
        by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
        return self.table("events").select(F.col("user_id").alias("curve_id"), (F.row_number().over(by_user) - 1).alias("i"), F.get_json_object("props", "$.k").cast("double").alias("x"), F.col("value").alias("y"))

    @cached_property
    def profiles(self) -> DataFrame:
        last = F.max("i").over(Window.partitionBy("curve_id"))
        return self.tracks.select("curve_id", "i", F.when(last > 0, F.col("i") / last).otherwise(0.0).alias("x"), "y")

    @cached_property
    def rects(self) -> DataFrame:
        k = F.col("p_partkey")
        return self.table("part").select(k.alias("rect_id"), (k % 100).cast("double").alias("x"), (F.col("p_size") * 7 % 400).cast("double").alias("y"), (5 + k % 17).cast("double").alias("w"), (20 + F.col("p_size")).cast("double").alias("h"))

    @cached_property
    def contours(self) -> DataFrame:
        corners = F.create_map(*[F.lit(z) for i, (dx, dy) in enumerate(((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))) for z in (i, dx * 10 + dy)])
        t = self.tracks.where("i < 8").select("curve_id", "i", (3 + F.col("x").cast("int") % 10).alias("r"), F.element_at(corners, F.col("i")).alias("d"))
        dx = F.round(F.col("d") / 10).cast("int")
        return t.select(F.col("curve_id").alias("poly_id"), "i", (50 + dx * F.col("r")).alias("x"), (50 + (F.col("d") - 10 * dx) * F.col("r")).alias("y"))

    @cached_property
    def files(self) -> DataFrame:
        """Numbered files of ten frames each; number 13 is missing."""
        number = F.floor(F.col("vec_id") / 10).cast("long") + 1
        return self.table("embeddings").groupBy(number.alias("idx")).agg(F.count(F.lit(1)).alias("n")).where("idx <> 13")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("node_id"), (F.col("s_suppkey") % 37).cast("double").alias("x"), (F.floor(F.abs("s_acctbal")) % 101).cast("double").alias("y"))

    @cached_property
    def edges(self) -> DataFrame:
        line = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
        a, b = line.alias("a"), line.alias("b")
        on = (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
        edge = F.col("a.l_orderkey") * 100 + F.col("a.l_linenumber") * 10 + F.col("b.l_linenumber")
        return a.join(b, on).groupBy(edge.alias("edge_id")).agg(F.min("a.l_suppkey").alias("n1"), F.min("b.l_suppkey").alias("n2"))

    @cached_property
    def edge_points(self) -> DataFrame:
        p, q = (self.nodes.select(F.col("node_id").alias(n), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y")) for n in ("n1", "n2"))
        e = self.edges.join(p, "n1").join(q, "n2")
        points = F.array(F.struct(F.col("n1x").alias("x"), F.col("n1y").alias("y")), F.struct(F.col("n1x").alias("x"), F.col("n2y").alias("y")), F.struct(F.col("n2x").alias("x"), F.col("n2y").alias("y")))
        return e.select("edge_id", F.posexplode(points).alias("i", "p")).select("edge_id", "i", "p.x", "p.y")


#: The views in DuckDB, in the order of their dependencies.
SQL_VIEWS = {
    "pixels8": "select video_id, frame_idx, cast(p // 8 as int) as y, cast(p % 8 as int) as x, cast(greatest(0, least(255, floor((cast(e as double) + 0.6) * 212.5))) as int) as v from (select label as video_id, row_number() over (partition by label order by vec_id) - 1 as frame_idx, unnest(range(64)) as p, unnest(embedding) as e from embeddings)",
    "mask8": "select video_id, frame_idx, y, x from pixels8 where v >= 140",
    "color8": "select video_id, frame_idx, y, x, c, (v + 85 * c) % 256 as v from pixels8, (values (0), (1), (2)) t(c)",
    "videos8": "select video_id, 8 as width, 8 as height, count(distinct frame_idx) as frame_count from pixels8 group by 1",
    "raster": "select cast(datediff('day', date '1992-01-01', cast(l_shipdate as date)) as bigint) as frame_idx, cast(l_quantity as int) as y, cast(round(l_discount * 100) as int) as x, cast(count(*) as int) as v from lineitem group by 1, 2, 3",
    "tracks": "select user_id as curve_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as i, cast(json_extract_string(props, '$.k') as double) as x, value as y from events",
    "profiles": "select curve_id, i, case when max(i) over (partition by curve_id) > 0 then i / cast(max(i) over (partition by curve_id) as double) else 0 end as x, y from tracks",
    "rects": "select p_partkey as rect_id, cast(p_partkey % 100 as double) as x, cast((p_size * 7) % 400 as double) as y, cast(5 + p_partkey % 17 as double) as w, cast(20 + p_size as double) as h from part",
    "contours": "select t.curve_id as poly_id, d.i, 50 + d.dx * (3 + cast(t.x as int) % 10) as x, 50 + d.dy * (3 + cast(t.x as int) % 10) as y from tracks t join (values (0, 1, 0), (1, 1, 1), (2, 0, 1), (3, -1, 1), (4, -1, 0), (5, -1, -1), (6, 0, -1), (7, 1, -1)) as d(i, dx, dy) on t.i = d.i",
    "files": "select vec_id // 10 + 1 as idx, count(*) as n from embeddings where vec_id // 10 <> 12 group by 1",
    "nodes": "select s_suppkey as node_id, cast(s_suppkey % 37 as double) as x, cast(floor(abs(s_acctbal)) % 101 as double) as y from supplier",
    "edges": "select a.l_orderkey * 100 + a.l_linenumber * 10 + b.l_linenumber as edge_id, min(a.l_suppkey) as n1, min(b.l_suppkey) as n2 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and b.l_linenumber = a.l_linenumber + 1 group by 1",
    "edge_points": "select edge_id, k as i, case when k < 2 then p.x else q.x end as x, case when k = 0 then p.y else q.y end as y from edges join nodes p on p.node_id = n1 join nodes q on q.node_id = n2, (values (0), (1), (2)) t(k)",
}
NEEDS = {"mask8": ["pixels8"], "color8": ["pixels8"], "videos8": ["pixels8"], "profiles": ["tracks"], "contours": ["tracks"], "edge_points": ["nodes", "edges"]}


def with_views(names: list[str], sql: str) -> str:
    """`sql` behind the WITH clause of the views it needs."""
    wanted: list[str] = []
    for name in names:
        for view in [*NEEDS.get(name, []), name]:
            if view not in wanted:
                wanted.append(view)
    ctes = [f"{v} as ({SQL_VIEWS[v]})" for v in wanted]
    body = sql.strip()
    if body.startswith("with "):
        ctes.append(body[5:].removeprefix("recursive "))
        return "with recursive " + ",\n".join(ctes)
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body
