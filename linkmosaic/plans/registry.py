"""Queries over the library's operators, and their SQL for DuckDB."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmosaic.functions import units
from linkmosaic.operators import cellsets, graph, labels, landscape, masks, pairs, routing, selection
from linkmosaic.plans import raster, vector
from linkmosaic.plans.oracles import cte, prune, sql
from linkmosaic.sources import fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if oracle:
            ORACLES[key] = oracle
        return f

    return add


def habitat(spark: SparkSession, sf_dir: str):
    cells, meta = fixtures.raster(spark, sf_dir)
    return cells.filter(masks.in_values_or_ranges("value", (), [fixtures.HABITAT])), meta


def labelled(spark: SparkSession, sf_dir: str, connectivity: int = 8, least: int = 1):
    cells, meta = habitat(spark, sf_dir)
    found = labels.label_patches(cells, meta, connectivity)
    return (labels.min_size(found, least) if least > 1 else found), meta


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in cols})


# ---------------------------------------------------------------- masks and filters


@query(sql("select cell, coalesce(value in (1, 2, 3), false) as mask from cells", "cells"))
def mask_values(spark, sf_dir):
    return fixtures.raster(spark, sf_dir)[0].select("cell", masks.in_values("value", [1, 2, 3]).alias("mask"))


@query(sql("select cell, coalesce(value in (20, 21) or value between 1 and 15 or value between 46 and 50, false) as mask from cells", "cells"))
def mask_values_ranges(spark, sf_dir):
    return fixtures.raster(spark, sf_dir)[0].select("cell", masks.in_values_or_ranges("value", [20, 21], [(15, 1), (46, 50), (7,)]).alias("mask"))


@query(sql("select cell, (value <= 15 or value >= 48) and not value >= 46 as habitat from cells", "cells"))
def habitat_minus_obstacle(spark, sf_dir):
    cells, _ = fixtures.raster(spark, sf_dir)
    hab = masks.in_values_or_ranges("value", (), [(1, 15), (48, 50)])
    return cells.select("cell", (hab & ~masks.in_values_or_ranges("value", (), [fixtures.OBSTACLE])).alias("habitat"))


@query(sql("select cell, value > 15 and value < 46 and r between 2 and h - 1 and c between 2 and 49 and not exists (select 1 from cells o where o.value >= 46 and abs(o.r - t.r) <= 1 and abs(o.c - t.c) <= 1) as passable from cells t, (select max(r) as h from cells)", "cells"))
def clearance_mask(spark, sf_dir):
    cells, meta = fixtures.raster(spark, sf_dir)
    marked = cells.withColumn("obstacle", F.col("value") >= 46).withColumn("passable", (F.col("value") > 15) & (F.col("value") < 46))
    return masks.clearance(marked, meta, 3).select("cell", "passable")


@query(sql("select t.cell, (select count(*) from cells o where abs(o.r - t.r) <= 1 and abs(o.c - t.c) <= 1 and o.value <= 45) = 9 as eroded from cells t", "cells"))
def erode_mask(spark, sf_dir):
    cells, _ = fixtures.raster(spark, sf_dir)
    return masks.erode(cells.withColumn("m", F.col("value") <= 45), "m", 3).select("cell", "eroded")


@query("select c_custkey as id, cast(case when y >= 0 then 32600 else 32700 end + floor((x + 180) / 6) + 1 as bigint) as epsg from (select c_custkey, (c_custkey * 7) % 360 - 180.0 as x, (c_custkey * 11) % 160 - 80.0 as y from customer)")
def utm_zone(spark, sf_dir):
    k = F.col("c_custkey")
    return fixtures.read(spark, sf_dir, "customer").select(k.alias("id"), units.utm_epsg((k * 7) % 360 - 180.0, (k * 11) % 160 - 80.0).alias("epsg"))


@query("select p_partkey as id, substr(case when n = '' then 'layer' else n end, 1, 10) as name from (select p_partkey, trim(regexp_replace(p_type || '/' || p_name || '!', '[^A-Za-z0-9_-]+', '_', 'g'), '_') as n from part)")
def safe_name(spark, sf_dir):
    return fixtures.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), units.safe_name(F.concat("p_type", F.lit("/"), "p_name", F.lit("!")), 10).alias("name"))


@query("select c_custkey as id, coalesce(printf('%.2f', case when c_custkey % 7 = 0 then null else c_custkey / 8.0 end), '') as text from customer")
def format_number(spark, sf_dir):
    k = F.col("c_custkey")
    return fixtures.read(spark, sf_dir, "customer").select(k.alias("id"), units.number(F.when(k % 7 != 0, k / 8)).alias("text"))


@query(sql("select value, n, 100.0 * n / sum(n) over () as percent from (select value, count(*) as n from cells where value is not null group by value) order by n desc, value limit 10", "cells"))
def value_summary(spark, sf_dir):
    return masks.value_summary(fixtures.raster(spark, sf_dir)[0])


# ---------------------------------------------------------------- patches


@query(sql("select cell, patch_id from labels4", "labels4"))
def label_4(spark, sf_dir):
    return labelled(spark, sf_dir, 4)[0].select("cell", "patch_id")


@query(sql("select cell, patch_id from labels8", "labels8"))
def label_8(spark, sf_dir):
    return labelled(spark, sf_dir, 8)[0].select("cell", "patch_id")


@query(sql("select patch_id, cell_count, cast(cell_count as double) as area, round(x, 6) as x, round(y, 6) as y from patches", "patches"))
def patch_summary(spark, sf_dir):
    return rounded(labels.patch_summary(*labelled(spark, sf_dir)), "x", "y")


@query(sql("select cell, patch_id from labels8 where patch_id in (select patch_id from patches where cell_count >= 5)", "patches"))
def min_size_filter(spark, sf_dir):
    return labelled(spark, sf_dir, 8, 5)[0].select("cell", "patch_id")


@query(sql("select cast(quantile_cont(cell_count, 0) as double) as q0, quantile_cont(cell_count, 0.5) as q50, round(quantile_cont(cell_count, 0.9), 6) as q90, round(quantile_cont(cell_count, 0.99), 6) as q99 from patches", "patches"))
def patch_size_quantiles(spark, sf_dir):
    return rounded(labels.size_quantiles(labels.patch_summary(*labelled(spark, sf_dir))), "q90", "q99")


@query(sql("select cell, r, c, count(*) over (partition by patch_id) as cells from labels8", "labels8"))
def connectivity_diagnosis(spark, sf_dir):
    found, _ = labelled(spark, sf_dir)
    return found.join(found.groupBy("patch_id").agg(F.count("*").alias("cells")), "patch_id").select("cell", "r", "c", "cells")


# ---------------------------------------------------------------- pairs


@query(sql("select a.patch_id as patch1, b.patch_id as patch2, round(sqrt((a.x - b.x)^2 + (a.y - b.y)^2), 6) as cost, row_number() over (order by a.patch_id, b.patch_id) as id from big a join big b on a.patch_id < b.patch_id where sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 12", "big"))
def centroid_pairs(spark, sf_dir):
    found, meta = labelled(spark, sf_dir, 8, 3)
    out = pairs.centroid_candidates(labels.patch_summary(found, meta), 12, meta)
    return rounded(out, "cost").select("patch1", "patch2", "cost", "id")


@query("with p as (select c_custkey as id, cast(c_custkey % 40 as double) as x, cast(c_custkey // 40 as double) as y from customer) select a.id as i, b.id as j, round(sqrt((a.x - b.x)^2 + (a.y - b.y)^2), 6) as dist from p a join p b on a.id < b.id and sqrt((a.x - b.x)^2 + (a.y - b.y)^2) <= 2.5")
def binned_pairs(spark, sf_dir):
    return rounded(pairs.bin_join(fixtures.points(spark, sf_dir), 2.5), "dist")


@query(sql("select cell, patch_id from edge_cells", "edge_cells"))
def boundary_cells(spark, sf_dir):
    return pairs.boundary_cells(*labelled(spark, sf_dir, 8, 3), 4).select("cell", "patch_id")


@query(sql("select cell, patch_id from (select *, row_number() over (partition by patch_id, (r - 1) // 2, (c - 1) // 2 order by c, r) as k from edge_cells) where k = 1", "edge_cells"))
def boundary_subsample(spark, sf_dir):
    return pairs.block_subsample(pairs.boundary_cells(*labelled(spark, sf_dir, 8, 3), 4)).select("cell", "patch_id")


@query(sql("select a.patch_id as p1, b.patch_id as p2, min((a.r - b.r)^2 + (a.c - b.c)^2)::bigint as d2, count(*) as n from thin a join thin b on a.patch_id < b.patch_id and (a.r - b.r)^2 + (a.c - b.c)^2 <= 64 group by all", "thin"))
def boundary_pair_min_distance(spark, sf_dir):
    thin = pairs.block_subsample(pairs.boundary_cells(*labelled(spark, sf_dir, 8, 3), 4))
    return pairs.boundary_pairs(thin, 8).groupBy("p1", "p2").agg(F.min("d2").alias("d2"), F.count("*").alias("n"))


@query()
def boundary_pair_seeds(spark, sf_dir):
    thin = pairs.block_subsample(pairs.boundary_cells(*labelled(spark, sf_dir, 8, 3), 4))
    return pairs.pair_seeds(pairs.boundary_pairs(thin, 8), 3)


@query(sql("select f.cell, arg_min(l.patch_id, m.k) as patch_id from (select * from cells where value > 15 and value < 46) f cross join (values (0, -1, 0), (1, 1, 0), (2, 0, -1), (3, 0, 1)) m(k, dr, dc) join labels8 l on l.r = f.r + m.dr and l.c = f.c + m.dc group by f.cell", "labels8"))
def start_positions(spark, sf_dir):
    cells, meta = fixtures.raster(spark, sf_dir)
    found, _ = labelled(spark, sf_dir)
    v = F.col("value")
    marked = cells.join(found.select("cell", "patch_id"), "cell", "left").withColumns({"habitat": v <= 15, "obstacle": v >= 46, "passable": (v > 15) & (v < 46)})
    return pairs.start_positions(marked, meta, 4).select("cell", "patch_id")


@query(sql("select concat_ws('_', least(u, v), greatest(u, v)) as key, cast((u * 50 + v) as bigint) as cell, cast(u + 1 as bigint) as r, cast(v as bigint) as c from edges", "edges"))
def pair_and_cell_keys(spark, sf_dir):
    _, edges = fixtures.nation_graph(spark, sf_dir)
    cell = pairs.cell_of(F.col("u") + 1, F.col("v"), 50)
    r, c = pairs.row_col_of(cell, 50)
    return edges.select(pairs.pair_key(F.col("v"), F.col("u")).alias("key"), cell.alias("cell"), r.alias("r"), c.alias("c"))


# ---------------------------------------------------------------- cell sets


@query(sql("select distinct (t.r + dr - 1) * 50 + t.c + dc as cell from labels8 t cross join (values (0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)) o(dr, dc), (select max(r) as h from cells) where t.r + dr between 1 and h and t.c + dc between 1 and 50", "labels8"))
def inflate_cells(spark, sf_dir):
    found, meta = labelled(spark, sf_dir)
    return cellsets.disc(found.select("cell", "r", "c"), meta, 2).select("cell")


@query(sql("select distinct o.cell from labels8 t join cells o on abs(o.r - t.r) <= 2 and abs(o.c - t.c) <= 2", "labels8"))
def expand_cells(spark, sf_dir):
    found, meta = labelled(spark, sf_dir)
    return cellsets.expand(found.select("cell", "r", "c"), meta, 2).select("cell")


@query(sql("select a.r as r, round(count(b.c) / count(*), 6) as share from (select r, c from cells where value <= 30) a left join (select r, c from cells where value between 20 and 50) b on a.r = b.r and a.c = b.c group by a.r", "cells"))
def overlap_ratio(spark, sf_dir):
    cells, _ = fixtures.raster(spark, sf_dir)
    sets = cells.groupBy("r").agg(F.collect_list(F.when(F.col("value") <= 30, F.col("c"))).alias("a"), F.collect_list(F.when(F.col("value") >= 20, F.col("c"))).alias("b"))
    return rounded(sets.filter(F.size("a") > 0).select("r", cellsets.overlap(F.col("a"), F.col("b")).alias("share")), "share")


@query(sql("select cell, cast(max(p) as double) as value from (select o.cell, l.patch_id as p from labels8 l join cells o on abs(o.r - l.r) <= 1 and abs(o.c - l.c) <= 1) group by cell", "labels8"))
def corridor_raster(spark, sf_dir):
    found, meta = labelled(spark, sf_dir)
    wide = cellsets.expand(found.select("cell", "r", "c", "patch_id"), meta, 1)
    return cellsets.corridor_raster(wide.groupBy("patch_id").agg(F.collect_list("cell").alias("buffered_cells")).withColumnRenamed("patch_id", "connected_size"))


@query(sql("select cell, cast(count(*) over (partition by root) as double) as value from (select cell, min(root) as root from reachu group by cell)", "reachu"))
def contiguous_raster(spark, sf_dir):
    hab, meta = habitat(spark, sf_dir)
    cells, _ = fixtures.raster(spark, sf_dir)
    return cellsets.contiguous_raster(hab, cells.filter("value = 20"), meta, 8).select("cell", "value")


# ---------------------------------------------------------------- landscape


@query(sql("select cell, n4, 4 - n4 as edge from n4", "n4"))
def edge_map(spark, sf_dir):
    hab, _ = habitat(spark, sf_dir)
    return landscape.edge_map(hab).select("cell", "n4", "edge")


@query(sql(prune("select {cols} from metrics"), "metrics"))
def landscape_metrics(spark, sf_dir):
    hab, meta = habitat(spark, sf_dir)
    return rounded(landscape.mask_metrics(hab, meta), *landscape.METRICS)


@query(sql("select count(*) as groups from (select u.root from (select cell, min(root) as root from reachu group by cell) u join labels8 l on l.cell = u.cell group by u.root having count(distinct l.patch_id) >= 2)", "labels8", "reachu"))
def connected_groups(spark, sf_dir):
    found, meta = labelled(spark, sf_dir)
    hab, _ = habitat(spark, sf_dir)
    cells, _ = fixtures.raster(spark, sf_dir)
    both = hab.select("cell", "r", "c").unionByName(cells.filter("value = 20").select("cell", "r", "c"))
    return landscape.connected_groups(found, labels.label_patches(both, meta, 8))


@query()
def landscape_report(spark, sf_dir):
    hab, meta = habitat(spark, sf_dir)
    cells, _ = fixtures.raster(spark, sf_dir)
    post = hab.select("cell", "r", "c").unionByName(cells.filter("value = 20").select("cell", "r", "c"))
    return rounded(landscape.report_rows(hab, post, meta), "pre", "post")


@query("""with s as (select (60 + s_nationkey * 2)::double as w, (60 + (s_suppkey * 7) % 50)::double as h from supplier), p as (select w * h / 10000 as a, 2 * (w + h) as p from s),
t as (select sum(a) as A1, sum(a * a) as A2, max(a) as m, count(*)::double as n, sum(p) as e, avg(0.25 * p / sqrt(a)) as msi, avg(p / a) as para, avg(case when a <> 1 then 2 * ln(0.25 * p) / ln(a) end) as frac from p)
select round(A1, 6) as total_area, n as num_patches, round(e, 6) as total_edge, round(A2 / A1, 6) as mesh, round(A1 * A1 / A2, 6) as split, round(m, 6) as lps, round(100 * m / A1, 6) as lpi, round(100 * n / A1, 6) as pd, round(e / A1, 6) as ed,
round(msi, 6) as msi, round(para, 6) as mean_para, round(frac, 6) as frac, 0::double as ai, 0::double as cai, 0::double as mean_gyrate from t""")
def polygon_metrics(spark, sf_dir):
    shapes = fixtures.rectangles(spark, sf_dir).select((F.col("w") * F.col("h")).alias("area"), (2 * (F.col("w") + F.col("h"))).alias("perimeter"))
    return rounded(landscape.polygon_metrics(shapes), *landscape.METRICS)


# ---------------------------------------------------------------- graphs


def network(spark, sf_dir):
    """The nodes, and the network that is chosen from all edges between nations under a tenth of their cost."""
    nodes, edges = fixtures.nation_graph(spark, sf_dir)
    budget = edges.agg(F.expr("cast(sum(cost) / 10 as bigint)")).first()[0]
    return nodes, selection.largest_network(nodes, edges, float(budget), 0.05, 2)


def chosen_graph(spark, sf_dir):
    """(nodes(id, weight), edges(u, v, id, cost, weight)) of that network."""
    nodes, found = network(spark, sf_dir)
    return nodes, found["selected"].select("u", "v", "id", "cost", F.col("cost").cast("double").alias("weight"))


def sparse(spark, sf_dir):
    nodes, edges = chosen_graph(spark, sf_dir)
    return nodes.select("id"), edges


@query(sql("select id, count(e.u) as degree, coalesce(sum(e.cost), 0)::bigint as weight from nodes left join (select u as i, u, cost from edges union all select v, u, cost from edges) e on e.i = id group by id", "edges"))
def graph_build(spark, sf_dir):
    nodes, edges = fixtures.nation_graph(spark, sf_dir)
    v, e = graph.build(nodes, edges.select(F.col("u").alias("patch1"), F.col("v").alias("patch2"), F.col("cost").alias("distance_m")))
    both = graph.ends(e)
    return v.join(both, "id", "left").groupBy("id").agg(F.count("other").alias("degree"), F.coalesce(F.sum("weight"), F.lit(0)).cast("long").alias("weight"))


ENTROPY = "(select -sum(q * ln(q + 1e-10)) / 25 as h from (select p / sum(p) over (partition by i) as q from (select u as i, exp(-0.002 * cost) as p from {e} union all select v, exp(-0.002 * cost) from {e})))"


@query(sql(f"select round(h, 6) as h_mov from {ENTROPY.format(e='edges')}", "edges"))
def movement_entropy(spark, sf_dir):
    nodes, edges = fixtures.nation_graph(spark, sf_dir)
    return rounded(graph.movement_entropy(nodes, edges.withColumn("weight", F.col("cost").cast("double"))), "h_mov")


TOPOLOGY = "(select count(*) as components from (select distinct root from parts)), (select count(*) as vertices from nodes), (select count(*) as edges from few)"


@query(sql(f"select vertices, edges, components, greatest(0, edges - (vertices - components))::double as penalty from {TOPOLOGY}", "parts"))
def topology_penalty(spark, sf_dir):
    return graph.topology_penalty(*sparse(spark, sf_dir))


@query(sql("select round(max(d) / 25, 6) as penalty from (select s, t, min(d) as d from hops group by s, t)", "hops"))
def disturbance_penalty(spark, sf_dir):
    nodes, edges = fixtures.nation_graph(spark, sf_dir)
    return rounded(graph.disturbance_penalty(nodes.select("id"), selection.spanning_forest(edges)), "penalty")


@query(sql(f"select round(h, 6) as h_mov, components::double as c, f, d, round(h + components - 1 + f + d, 6) as h_total from (select components, greatest(0, edges - (vertices - components))::double as f from {TOPOLOGY}), (select case when (select count(distinct root) from parts) > 1 then 1.0 else max(d) / 25 end::double as d from (select s, t, min(d) as d from fewhops group by s, t)), {ENTROPY.format(e='few')}", "parts", "fewhops"))
def total_entropy(spark, sf_dir):
    return rounded(graph.total_entropy(*sparse(spark, sf_dir)), "h_mov", "h_total")


@query(sql("select round(coalesce(sum(k * (k - 1) / 2), 0) / 300.0, 6) as fraction from (select root, count(*) as k from (select id, min(root) as root from blocks group by id) group by root)", "blocks"))
def two_edge_connectivity(spark, sf_dir):
    return rounded(graph.two_edge_connectivity(*sparse(spark, sf_dir)), "fraction")


@query(sql("select round((select count(*) from bridges) / (select count(*) from few), 6) as probability", "bridges"))
def failure_probability_k1(spark, sf_dir):
    return rounded(graph.failure_probability(*sparse(spark, sf_dir)), "probability")


@query()
def failure_probability_k3(spark, sf_dir):
    return graph.failure_probability(*sparse(spark, sf_dir), k=3, iterations=40, seed=3)


@query(sql("select f.u, f.v, f.cost::double as weight, round(min(w.d) / (f.cost + 1e-6), 6) as score from few f join walks w on w.s = f.u and w.t = f.v group by f.u, f.v, f.cost", "walks"))
def loop_score(spark, sf_dir):
    _, edges = sparse(spark, sf_dir)
    return rounded(graph.loop_scores(edges.select("u", "v", "weight"), edges), "score")


@query(sql("select f.id, f.cost, (select sum(weight) from parts p join nodes using (id) where p.root = q.root) + (select sum(g.cost) from few g join parts p on p.id = g.u where p.root = q.root) as connected_size from few f join parts q on q.id = f.u", "parts"))
def connected_sizes(spark, sf_dir):
    nodes, edges = chosen_graph(spark, sf_dir)
    chosen = edges.select("id", F.col("u").alias("patch1"), F.col("v").alias("patch2"), "cost")
    return graph.connected_sizes(chosen, nodes.select(F.col("id").alias("patch_id"), F.col("weight").alias("cell_count"))).select("id", "cost", "connected_size")


@query(sql("select root as component, sum(weight) as size, count(*) as count from parts join nodes using (id) group by root", "parts"))
def component_sizes(spark, sf_dir):
    return graph.component_sizes(*chosen_graph(spark, sf_dir))


@query(sql("select f.id, dense_rank() over (order by p.root) as component_id, w.s as connected_area, round(w.s / greatest(f.cost, 1e-6), 6) as efficiency, false as multipart from few f join parts p on p.id = f.u join (select root, sum(weight) as s from parts join nodes using (id) group by root) w on w.root = p.root", "parts"))
def vector_components(spark, sf_dir):
    nodes, edges = chosen_graph(spark, sf_dir)
    chosen = edges.select("id", F.array("u", "v").alias("patch_ids"), F.col("cost").cast("double").alias("area"))
    out = graph.vector_components(chosen, nodes.select(F.col("id").alias("patch_id"), F.col("weight").alias("area")))
    return rounded(out, "efficiency").select("id", "component_id", "connected_area", "efficiency", "multipart")


@query("with t as (select c_custkey as id, case when c_custkey % 11 = 0 then null else (c_custkey % 97)::double end as p, (c_custkey % 13)::double as l from customer) select id, case when l <= 0 then 0.1 when p is null then 0.5 when p / l >= 3 then 0.9 when p / l >= 1.5 then 0.5 else 0.1 end::double as worth from t")
def shortcut_ladder(spark, sf_dir):
    k = F.col("c_custkey")
    return fixtures.read(spark, sf_dir, "customer").select(k.alias("id"), graph.shortcut_multiplier(F.when(k % 11 != 0, (k % 97).cast("double")), (k % 13).cast("double")).alias("worth"))


# ---------------------------------------------------------------- selection


@query(sql("select u, v, id, cost from forest", "forest"))
def spanning_forest(spark, sf_dir):
    _, edges = fixtures.nation_graph(spark, sf_dir)
    return selection.spanning_forest(edges)


@query(sql("select u, v, id, cost from forest", "forest"))
def spanning_forest_rounds(spark, sf_dir):
    _, edges = fixtures.nation_graph(spark, sf_dir)
    return selection.spanning_forest(edges, small=0)


@query(sql("select id, u, v, cost, kind from chosen", "chosen"))
def largest_network(spark, sf_dir):
    return network(spark, sf_dir)[1]["selected"].select("id", "u", "v", "cost", "kind")


@query(sql("select root as component, sum(weight) as size, count(*) as count from (select id, min(root) as root from mainreach group by id) join nodes using (id) group by root", "mainreach"))
def component_report(spark, sf_dir):
    return network(spark, sf_dir)[1]["components"]


@query(sql("select least(a, b) as patch1, greatest(a, b) as patch2, min(id) as id from (select id, u % 5 as a, v % 5 as b from edges) where a <> b group by 1, 2", "edges"))
def pair_dedup(spark, sf_dir):
    _, edges = fixtures.nation_graph(spark, sf_dir)
    c = edges.select("id", (F.col("u") % 5).alias("patch1"), (F.col("v") % 5).alias("patch2")).filter("patch1 <> patch2")
    return selection.one_per_pair(c).select(F.least("patch1", "patch2").alias("patch1"), F.greatest("patch1", "patch2").alias("patch2"), "id")


def nation_candidates(spark, sf_dir):
    """The nation graph as candidates with integer costs and ROI = sqrt(w_u w_v) / cost."""
    nodes, edges = fixtures.nation_graph(spark, sf_dir)
    a = nodes.select(F.col("id").alias("u"), F.col("weight").alias("wu"))
    b = nodes.select(F.col("id").alias("v"), F.col("weight").alias("wv"))
    cost = F.col("cost").cast("double")
    c = edges.join(a, "u").join(b, "v").select("id", F.col("u").alias("patch1"), F.col("v").alias("patch2"), cost.alias("cost"), cost.alias("length"), (F.sqrt(F.col("wu") * F.col("wv")) / cost).alias("roi"))
    return nodes.select(F.col("id").alias("patch_id"), "weight"), c


@query(sql("select a.mid, least(a.id, b.id) as id1, greatest(a.id, b.id) as id2, (a.cost + b.cost)::double as cost, round(sqrt(x.weight * y.weight) / (a.cost + b.cost), 6) as score from sides a join sides b on a.mid = b.mid and a.id < b.id and a.far <> b.far join nodes x on x.id = a.far join nodes y on y.id = b.far where a.k <= 25 and b.k <= 25 and a.cost + b.cost <= 1000000", "sides"))
def bridge_pairs(spark, sf_dir):
    patches, c = nation_candidates(spark, sf_dir)
    return rounded(selection.bridge_pairs(c, patches, 1_000_000.0), "score").select("mid", "id1", "id2", "cost", "score")


def packed(candidates: DataFrame, patches: DataFrame, budgets: DataFrame, choose: Callable, schema: str) -> DataFrame:
    """Runs choose(candidates, weights, budget) -> rows in one task for each (scenario_id, budget)."""
    pool = candidates.agg(F.sort_array(F.collect_list(F.struct("id", "patch1", "patch2", "cost", "length", "roi"))).alias("c"))
    sizes = patches.agg(F.collect_list(F.struct("patch_id", "weight")).alias("w"))

    def run(batches):
        for b in batches:
            for sid, budget, cs, w in b[["scenario_id", "budget", "c", "w"]].itertuples(index=False):
                given = [{"id": x["id"], "patch_ids": [x["patch1"], x["patch2"]], "cost": x["cost"], "length": x["length"], "roi": x["roi"]} for x in cs]
                rows = choose(given, {x["patch_id"]: x["weight"] for x in w}, budget)
                yield pd.DataFrame([(sid, *r) for r in rows], columns=[x.split()[0] for x in schema.split(", ")])

    return budgets.crossJoin(F.broadcast(pool)).crossJoin(F.broadcast(sizes)).mapInPandas(run, schema)


def scenarios(spark, sf_dir):
    key = F.col("r_regionkey").cast("long")
    return fixtures.read(spark, sf_dir, "region").select(key.alias("scenario_id"), (50.0 * (key + 1)).alias("budget"))


@query(sql("select scenario_id, id from scanned", "scanned"))
def circuit_utility_primary(spark, sf_dir):
    """The greedy choice where neither loops nor pairs through a patch are taken: by ROI, while affordable and joining."""
    patches, c = nation_candidates(spark, sf_dir)

    def choose(given, weights, budget):
        picks, _ = selection.circuit_utility(given, weights, budget, seeding=False, far_enough=lambda *_: False)
        return [(p["id"],) for p in picks]

    return packed(c, patches, scenarios(spark, sf_dir), choose, "scenario_id long, id long")


@query()
def circuit_utility_full(spark, sf_dir):
    patches, c = nation_candidates(spark, sf_dir)
    return selection.scenario_sweep(c, patches, scenarios(spark, sf_dir))


@query()
def hybrid_leftover(spark, sf_dir):
    """What is added to a greedy choice when the budget doubles."""
    patches, c = nation_candidates(spark, sf_dir)

    def choose(given, weights, budget):
        picks, stats = selection.circuit_utility(given, weights, budget)
        added, _ = selection.spend_leftover(given, picks, weights, 2 * budget - stats["budget_used"])
        return [(k, p["id"], p["cost"]) for k, p in enumerate(added)]

    return packed(c, patches, scenarios(spark, sf_dir), choose, "scenario_id long, ord int, id long, cost double")


OPEN = "open as (select cell, r, c, false as bridge from cells where value > 15 and value < 46 union all select cell, r, c, true from labels8 where patch_id not in (select patch_id from big))"
STEPS = "steps as (select a.cell as u, b.cell as v, case when b.bridge then 0 else 1 end as w from open a join open b on abs(a.r - b.r) + abs(a.c - b.c) = 1)"
BEGIN = "begin_at as (select o.cell as src from open o join labels8 l on abs(o.r - l.r) + abs(o.c - l.c) = 1 where l.patch_id in (select patch_id from big))"
WAYS = "ways as (select distinct src, src as id, 0 as d from begin_at union select w.src, s.v, w.d + s.w from ways w join steps s on s.u = w.id where w.d + s.w <= 5)"


@query(cte("labels8", "big") + f",\n{OPEN},\n{STEPS},\n{BEGIN},\n{WAYS}\nselect id as cell, min(d)::double as cost from ways group by id")
def route_cost(spark, sf_dir):
    """Least cost of open cells from beside the patches of 3 cells or more; stray habitat is free."""
    cells, meta = fixtures.raster(spark, sf_dir)
    found, _ = labelled(spark, sf_dir)
    big = labels.min_size(found, 3)
    stray = found.join(big.select("cell"), "cell", "left_anti").select("cell", "r", "c", F.lit(True).alias("bridge"))
    free = cells.filter("value > 15 and value < 46").select("cell", "r", "c", F.lit(False).alias("bridge")).unionByName(stray)
    edges = routing.routing_graph(free, meta, 4)
    ring = masks.shifted(big.select("r", "c"), pairs.moves(4), meta).select(F.col("target").alias("cell")).distinct()
    start = free.join(ring, "cell").select(F.col("cell").alias("src"), F.col("cell").alias("id"), F.lit(0.0).alias("dist"))
    return graph.relax(start, edges, "cost", 5.0).groupBy(F.col("id").alias("cell")).agg(F.min("dist").alias("cost"))


@query(sql("select cell, r, c from cells where value > 15 and value < 46 and greatest(abs(r - 2), abs(c - 25)) <= 6 order by greatest(abs(r - 2), abs(c - 25)), (r - 2)^2 + (c - 25)^2, c, r limit 1", "cells"))
def nearest_passable(spark, sf_dir):
    cells, _ = fixtures.raster(spark, sf_dir)
    return pairs.nearest_passable(cells.withColumn("passable", (F.col("value") > 15) & (F.col("value") < 46)), 2, 25)


@query()
def lines_to_cells(spark, sf_dir):
    """Cells of the straight lines between the ends of the nation graph, laid on a raster 50 wide."""
    _, meta = fixtures.raster(spark, sf_dir)
    _, edges = fixtures.nation_graph(spark, sf_dir)
    return cellsets.lines_to_cells(edges.select("id", (F.col("u") % 5 + 1).alias("r1"), (F.col("u") + 1).alias("c1"), (F.col("v") % 5 + 1).alias("r2"), (F.col("v") + 1).alias("c2")), meta)


RASTER_RUN = {"patch_ranges": [fixtures.HABITAT], "budget": 120, "min_patch_size": 5, "max_search_distance": 12, "obstacle_ranges": [fixtures.OBSTACLE]}


@query()
def raster_candidates(spark, sf_dir):
    found = raster.search_corridors(*fixtures.raster(spark, sf_dir), **RASTER_RUN)
    return found.candidates.select("id", "patch1", "patch2", "cost", "length", "roi", "variant", "path_cells")


@query()
def raster_pipeline(spark, sf_dir):
    return raster.find_corridors(*fixtures.raster(spark, sf_dir), **RASTER_RUN).tables["corridors"].select("id", "patch1", "patch2", "cost", "length", "roi", "thicken_factor", "connected_size", "buffered_cells")


@query(sql("select s_suppkey as id, w * h as area, 2 * (w + h) as perimeter, x + w / 2 as x, y + h / 2 as y from (select s_suppkey, (s_suppkey % 10) * 220.0::double as x, (s_suppkey // 10) * 220.0::double as y, (60 + s_nationkey * 2)::double as w, (60 + (s_suppkey * 7) % 50)::double as h from supplier)"))
def polygon_shapes(spark, sf_dir):
    shapes = vector.prepared(fixtures.rectangle_polygons(fixtures.rectangles(spark, sf_dir)))
    return rounded(shapes.select("id", "area", "perimeter", "x", "y"), "area", "perimeter", "x", "y")


@query("with b as (select s_suppkey as id, (s_suppkey % 10) * 220.0::double as x, (s_suppkey // 10) * 220.0::double as y, (60 + s_nationkey * 2)::double as w, (60 + (s_suppkey * 7) % 50)::double as h from supplier), d as (select a.id as i, b.id as j, sqrt(greatest(0, a.x - b.x - b.w, b.x - a.x - a.w)^2 + greatest(0, a.y - b.y - b.h, b.y - a.y - a.h)^2) as dist from b a join b on a.id < b.id) select i, j, round(dist, 6) as dist from d where dist <= 300")
def near_polygons(spark, sf_dir):
    shapes = vector.prepared(fixtures.rectangle_polygons(fixtures.rectangles(spark, sf_dir)))
    return rounded(vector.near_polygons(shapes, 300.0).select("i", "j", "dist"), "dist")


@query("select min(s_suppkey) as id, cast(sum(220 * (60 + (s_suppkey * 7) % 50)) as double) as area from supplier group by s_suppkey // 10")
def merge_touching(spark, sf_dir):
    """Rectangles widened so that neighbours in a row touch: merged groups with their area."""
    rects = fixtures.rectangles(spark, sf_dir).withColumn("w", F.lit(220.0))
    merged = vector.merge_touching(vector.prepared(fixtures.rectangle_polygons(rects)))
    return rounded(vector.prepared(merged).select("id", "area"), "area")


VECTOR_RUN = {"budget": 2.0, "crs": 32618, "min_patch_size": 0.1, "min_corridor_width": 20, "max_search_distance": 200}


@query()
def vector_candidates(spark, sf_dir):
    found = vector.search_corridors(fixtures.rectangle_polygons(fixtures.rectangles(spark, sf_dir)), **VECTOR_RUN)
    return found.candidates.select("id", "patch1", "patch2", "cost", "length", "roi", "is_connected")


@query()
def vector_pipeline(spark, sf_dir):
    done = vector.find_corridors(fixtures.rectangle_polygons(fixtures.rectangles(spark, sf_dir)), **VECTOR_RUN)
    return done.tables["corridors"].select("id", "patch1", "patch2", "patch_ids", "corridor_area_m2", "corridor_length_m", "component_id", "connected_area_m2", "efficiency")


@query("select c_custkey as id, round(x::double, 4) as lon, round(y::double, 4) as lat from (select c_custkey, (c_custkey * 7) % 360 - 179.5 as x, (c_custkey * 11) % 160 - 79.5 as y from customer)")
def utm_round_trip(spark, sf_dir):
    """Degrees to the zone's metres and back."""
    k = F.col("c_custkey")
    at = fixtures.read(spark, sf_dir, "customer").select(k.alias("id"), ((k * 7) % 360 - 179.5).alias("lon"), ((k * 11) % 160 - 79.5).alias("lat"))
    zone = F.floor((F.col("lon") + 180) / 6) + 1
    east, north = units.utm_forward(F.col("lon"), F.col("lat"), zone)
    lon, lat = units.utm_inverse(F.col("e"), F.col("n"), F.col("zone"), F.col("lat") < 0)
    out = at.withColumns({"zone": zone, "e": east, "n": north}).select("id", lon.alias("lon"), lat.alias("lat"))
    return rounded(out, "lon", "lat", digits=4)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster -> patches of 3 cells or more -> centroid candidates -> budgeted network with component sizes."""
    found, meta = labelled(spark, sf_dir, 8, 3)
    patches = labels.patch_summary(found, meta)
    c = pairs.centroid_candidates(patches, 12, meta)
    edges = c.select(F.col("patch1").alias("u"), F.col("patch2").alias("v"), "id", F.round(F.col("cost") * 1000).cast("long").alias("cost"))
    nodes = patches.select(F.col("patch_id").alias("id"), F.col("cell_count").cast("double").alias("weight"))
    chosen = selection.largest_network(nodes, edges, 60_000.0)["selected"]
    out = chosen.select("id", F.col("u").alias("patch1"), F.col("v").alias("patch2"), F.col("cost").cast("double").alias("cost"), "kind")
    return graph.connected_sizes(out, patches).select("id", "patch1", "patch2", "cost", "kind", "connected_size")


QUERIES["flagship"] = functools.partial(flagship)
