"""Queries of the skeleton-graph operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from framewright.operators import graphs, regions
from framewright.plans.base import Views, query
from framewright.plans.frame_queries import rounded
from framewright.plans.region_queries import thinned_sql
from framewright.plans.shape_queries import RASTER

LEN = "len as (select edge_id, sum(d) as length from (select edge_id, sqrt((lead(x) over w - x) ** 2 + (lead(y) over w - y) ** 2) as d from edge_points window w as (partition by edge_id order by i)) group by 1)"
QUERIES = "q as (select rect_id as query_id, x as qx, y as qy from rects)"

def measured(s: Views):
    return s.edges.join(graphs.edge_lengths(s.edge_points), "edge_id")


def asked(s: Views):
    return s.rects.select(F.col("rect_id").alias("query_id"), F.col("x").alias("qx"), F.col("y").alias("qy"))


query("f4_merge_nodes", "with r(a, b) as (select node_id, node_id from nodes union select r.a, m.node_id from r join nodes n on n.node_id = r.b join nodes m on abs(m.x - n.x) <= 2 and abs(m.y - n.y) <= 2) select a as node_id, min(b) as kept from r group by 1", "nodes")(lambda s: graphs.merge_nodes(s.nodes, 2.0))
query("f5_add_edges", f"with {LEN} select edge_id, n1, n2, false as flipped, round(length, 4) as length from edges join len using (edge_id) where length > 1e-6", "edge_points")(lambda s: rounded(graphs.add_edges(s.nodes, s.edges, s.edge_points)[0], "length"))
PRUNED = f"""{LEN}, measured as (select e.edge_id, n1, n2, length from edges e join len using (edge_id)),
live(k, edge_id, n1, n2, length) as (select 0, edge_id, n1, n2, length from measured union all
  select k + 1, edge_id, n1, n2, length from (select *, bool_or(gone) over () as more from (select *, length < 30 and (n1 = n2 or least_degree = 1) as gone
    from (select k, edge_id, n1, n2, length, min(degree) as least_degree from (select l.*, count(*) over (partition by node) as degree from live l, unnest([n1, n2]) t(node)) group by all))) where more and not gone),
rounds as (select max(k) as k from live)"""

query("f6_prune", f"with {PRUNED} select edge_id, n1, n2, round(length, 4) as length from live join rounds using (k)", "edges edge_points")(lambda s: rounded(graphs.prune(measured(s), 30.0), "length"))
query("f7_contract")(lambda s: rounded(graphs.contract(measured(s)), "length"))
query("f8_split_edges", "select edge_id, part, i, x, y from (select edge_id, cast(k as int) as part, cast(i - k as int) as i, x, y from edge_points, range(2) t(k) where (k = 0 and i <= 1) or (k = 1 and i >= 1))", "edge_points")(lambda s: graphs.split_edges(s.edge_points, s.edges.select("edge_id", F.lit(1).alias("i"))))
NEAR_EDGE = f"""{QUERIES}, seg as (select edge_id, x, y, lead(x) over w as x2, lead(y) over w as y2 from edge_points window w as (partition by edge_id order by i)),
t as (select q.*, s.*, case when (x2 - x) ** 2 + (y2 - y) ** 2 > 0 then least(1, greatest(0, ((qx - x) * (x2 - x) + (qy - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2))) else 0 end as f from seg s, q where x2 is not null),
b as (select query_id, qx, qy, edge_id from t qualify row_number() over (partition by query_id order by round(sqrt((x + f * (x2 - x) - qx) ** 2 + (y + f * (y2 - y) - qy) ** 2), 9), edge_id) = 1),
v as (select query_id, edge_id, i, round(sqrt((x - qx) ** 2 + (y - qy) ** 2), 9) as dist, x, y, qx, qy from b join edge_points using (edge_id) qualify row_number() over (partition by query_id order by round(sqrt((x - qx) ** 2 + (y - qy) ** 2), 9), i) = 1)"""
query("f9_connect", f"with {NEAR_EDGE} select query_id, k as i, case when k = 0 then qx else x end as x, case when k = 0 then qy else y end as y from v, (values (0), (1)) t(k)", "edge_points rects")(lambda s: graphs.connect(s.edge_points, asked(s))[0])
query("f10_nearest_node", f"with {QUERIES} select query_id, node_id, x, y, round(sqrt((x - qx) ** 2 + (y - qy) ** 2), 6) as dist from q, nodes qualify row_number() over (partition by query_id order by round(sqrt((x - qx) ** 2 + (y - qy) ** 2), 9), node_id) = 1", "nodes rects")(lambda s: rounded(graphs.nearest_nodes(s.nodes, asked(s)), "dist", digits=6))
query("f11_nearest_edge", f"with {NEAR_EDGE} select query_id, edge_id, i, round(dist, 6) as dist from v", "edge_points rects")(lambda s: rounded(graphs.nearest_edges(s.edge_points, asked(s)), "dist", digits=6))
query("f12_total_length", f"with {LEN} select round(sum(length), 2) as length from len", "edge_points")(lambda s: rounded(graphs.total_length(measured(s)), "length", digits=2))
query("f13_single_edges", "select least(n1, n2) as a, greatest(n1, n2) as b, count(*) as n, case when count(*) = 1 then min(edge_id) end as edge_id from edges group by 1, 2", "edges")(lambda s: graphs.single_edges(s.edges, s.edges.select(F.least("n1", "n2").alias("a"), F.greatest("n1", "n2").alias("b")).distinct()))

@query("f1_skeleton", f"with {RASTER}, moved as (select poly_id as video_id, 0::bigint as frame_idx, y - 36 as y, x - 36 as x from raster_), {thinned_sql('moved', 28)}", "contours")
def f1(s: Views):
    """Skeleton pixels of polygons: rasterised, then thinned."""
    from framewright.operators import shapes

    mask = shapes.rasterize(s.contours).select(F.col("poly_id").alias("video_id"), F.lit(0).cast("long").alias("frame_idx"), (F.col("y") - 36).alias("y"), (F.col("x") - 36).alias("x"))
    return regions.thin(mask, 28, 28)



query("f13_points_on_edges", "select edge_id, k as i, x, y from edge_points, (values (1), (-1)) t(k) where i = case when k = 1 then 1 else 2 end", "edge_points")(lambda s: graphs.points_on_edges(s.edge_points, s.edges.select("edge_id", F.explode(F.array(F.lit(1), F.lit(-1))).alias("i"))))


def skeletons(s: Views):
    return graphs.skeleton_graph(regions.thin(s.mask8, 8, 8))


query("f3_skeleton_graph")(lambda s: rounded(skeletons(s)[1], "length"))
query("f3_skeleton_curves")(lambda s: rounded(skeletons(s)[2], "x", "y"))


@query("f7_simplified_skeletons")
def f7_chain(s: Views):
    """Skeleton to graph, short edges pruned, chains merged, curves simplified."""
    _, edges, points = graphs.one_graph(*skeletons(s))
    kept = graphs.prune(edges, 2.0)
    return rounded(graphs.contract(kept, points.join(kept.select("edge_id"), "edge_id", "left_semi"), 0.5)[0], "length")


query("f7_contract_curves")(lambda s: rounded(graphs.contract(measured(s), s.edge_points)[1], "x", "y"))
query("f6_left_nodes", f"""with {PRUNED}, had as (select n1 as node_id from measured where n1 <> n2 union select n2 from measured where n1 <> n2),
has as (select n1 as node_id from live join rounds using (k) union select n2 from live join rounds using (k))
select * from nodes where node_id not in (select node_id from had except select node_id from has)""", "edges edge_points")(lambda s: graphs.left_nodes(s.nodes, measured(s), graphs.prune(measured(s), 30.0)))
query("f5_rejected", "select edge_id from edges where n1 = 1 or n2 = 1", "edges")(lambda s: graphs.add_edges(s.nodes.where("node_id <> 1"), s.edges, s.edge_points)[1])
