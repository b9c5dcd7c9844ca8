"""Graphs of patches and corridors: components, forests, paths and the metrics on them."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmosaic.operators.components import SMALL, connected_components
from linkmosaic.sources.shared import discard, materialize


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes(id), edges(u, v) -> (id, component), isolated nodes included."""
    found = connected_components(edges.select("u", "v"), small=SMALL)
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def component_sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size (sum of weights), count."""
    return nodes.join(components(nodes, edges), "id").groupBy("component").agg(F.sum("weight").alias("size"), F.count("*").alias("count"))


def build(patches: DataFrame, corridors: DataFrame, distance: str = "distance_m") -> tuple[DataFrame, DataFrame]:
    """(vertices(id), edges(u, v, weight)): parallel edges stay, patches without corridors are isolated, no distance is 1."""
    weight = F.coalesce(F.col(distance).cast("double"), F.lit(1.0)) if distance in corridors.columns else F.lit(1.0)
    edges = corridors.select(F.col("patch1").cast("long").alias("u"), F.col("patch2").cast("long").alias("v"), weight.alias("weight"))
    ids = patches.select(F.col("id").cast("long").alias("id")).union(edges.select("u")).union(edges.select("v")).distinct()
    return ids, edges


def ends(edges: DataFrame) -> DataFrame:
    """Every edge from both ends: id, other, and the other columns."""
    rest = [c for c in edges.columns if c not in ("u", "v", "id", "other")]
    return edges.select(F.col("u").alias("id"), F.col("v").alias("other"), *rest).unionAll(edges.select(F.col("v").alias("id"), F.col("u").alias("other"), *rest))


def movement_entropy(vertices: DataFrame, edges: DataFrame, alpha: float = 0.002) -> DataFrame:
    """h_mov: entropy of the shares exp(-alpha d) among each vertex's edges, as a mean over all vertices."""
    d = F.when(F.isnan("weight") | (F.abs("weight") == float("inf")), 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    held = ends(edges).withColumn("p", F.exp(-alpha * d))
    p = F.col("p") / F.sum("p").over(Window.partitionBy("id"))
    total = held.select((p * F.log(p + 1e-10)).alias("t")).agg(F.coalesce(-F.sum("t"), F.lit(0.0)).alias("s"))
    return total.crossJoin(F.broadcast(vertices.agg(F.count("*").alias("n")))).select(F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(0.0).alias("h_mov"))


def topology_penalty(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """vertices, edges, components, penalty: the number of independent cycles."""
    v = vertices.agg(F.count("*").alias("vertices"))
    e = edges.agg(F.count("*").alias("edges"))
    c = components(vertices, edges).agg(F.count_distinct("component").alias("components"))
    penalty = F.greatest(F.lit(0), F.col("edges") - (F.col("vertices") - F.col("components")))
    return v.crossJoin(F.broadcast(e)).crossJoin(F.broadcast(c)).withColumn("penalty", penalty.cast("double"))


def _paths(starts: DataFrame, edges: pd.DataFrame, limit: float | None) -> DataFrame:
    near: dict[int, list[tuple[int, float]]] = {}
    for u, v, w in edges.itertuples(index=False):
        near.setdefault(int(u), []).append((int(v), float(w)))

    def search(g: pd.DataFrame) -> pd.DataFrame:
        best: dict[int, float] = {}
        heap = sorted((float(d), int(i)) for i, d in g[["id", "dist"]].itertuples(index=False))
        while heap:
            d, x = heapq.heappop(heap)
            if x in best:
                continue
            best[x] = d
            for y, w in near.get(x, ()):
                if y not in best and (limit is None or d + w <= limit):
                    heapq.heappush(heap, (d + w, y))
        return pd.DataFrame({"src": g["src"].iloc[0], "id": list(best), "dist": list(best.values())})

    return starts.groupBy("src").applyInPandas(search, "src long, id long, dist double")


def relax(starts: DataFrame, edges: DataFrame, cost: str | None = None, limit: float | None = None, rounds: int = 10_000, small: int = SMALL) -> DataFrame:
    """Least costs: starts(src, id, dist), edges(u, v[, cost]) directed, costs not negative -> (src, id, dist).

    Up to `small` edges go to every task, which searches from the sources that it has.  More are relaxed by
    joins: only rows that the last round improved are joined on, every round is written to the shared
    folder, and the loop ends when none improves.
    """
    step = edges.select("u", "v", (F.col(cost) if cost else F.lit(1.0)).alias("w"))
    if step.limit(small + 1).count() <= small:
        return _paths(starts, step.toPandas(), limit)
    best = materialize(starts.groupBy("src", "id").agg(F.min("dist").alias("dist")).withColumn("new", F.lit(True)), "relax")
    for _ in range(rounds):
        sent = best.filter("new").join(step, F.col("id") == F.col("u")).select("src", F.col("v").alias("id"), (F.col("dist") + F.col("w")).alias("dist"))
        if limit is not None:
            sent = sent.filter(F.col("dist") <= limit)
        both = best.select("src", "id", "dist", F.lit(False).alias("sent")).unionAll(sent.withColumn("sent", F.lit(True)))
        old = F.min(F.when(~F.col("sent"), F.col("dist")))
        then = both.groupBy("src", "id").agg(F.min("dist").alias("dist"), old.alias("old")).select("src", "id", "dist", (F.col("old").isNull() | (F.col("dist") < F.col("old"))).alias("new"))
        then = materialize(then, "relax")
        discard(best)
        best = then
        if not best.filter("new").limit(1).count():
            break
    return best.select("src", "id", "dist")


def disturbance_penalty(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """penalty: unweighted diameter over vertices; 1 if unconnected; 0 under two vertices."""
    n = vertices.count()
    spark = vertices.sparkSession
    if n < 2:
        return spark.range(1).select(F.lit(0.0).alias("penalty"))
    if components(vertices, edges).agg(F.count_distinct("component")).first()[0] > 1:
        return spark.range(1).select(F.lit(1.0).alias("penalty"))
    hops = relax(vertices.select(F.col("id").alias("src"), "id", F.lit(0.0).alias("dist")), ends(edges).select(F.col("id").alias("u"), F.col("other").alias("v")).distinct())
    return hops.agg((F.max("dist") / n).alias("penalty"))


def total_entropy(vertices: DataFrame, edges: DataFrame, lambda_c: float = 1.0, lambda_f: float = 1.0, lambda_d: float = 1.0) -> DataFrame:
    """One row: h_mov, c, f, d, h_total = h_mov + lambda_c (c - 1) + lambda_f f + lambda_d d."""
    h = movement_entropy(vertices, edges)
    t = topology_penalty(vertices, edges).select(F.col("components").cast("double").alias("c"), F.col("penalty").alias("f"))
    d = disturbance_penalty(vertices, edges).select(F.col("penalty").alias("d"))
    total = F.col("h_mov") + lambda_c * (F.col("c") - 1) + lambda_f * F.col("f") + lambda_d * F.col("d")
    return h.crossJoin(F.broadcast(t)).crossJoin(F.broadcast(d)).withColumn("h_total", total)


def bridges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges whose removal parts their component: (u, v).

    A breadth-first forest gives every vertex a parent; an edge to a parent is a bridge if no other edge
    leaves the subtree below it.  Every other edge adds one at its ends and takes two away at their lowest
    common ancestor, in effect: each tree edge is covered by the edges whose ends' paths to the root
    differ by it, which is counted by climbing both paths, a level a round.
    """
    multi = edges.filter("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("k"))
    multi = materialize(multi, "bridges")
    roots = components(vertices, multi).filter("id = component").select(F.col("id").alias("src"), "id", F.lit(0.0).alias("dist"))
    both = ends(multi.select("u", "v")).select(F.col("id").alias("u"), F.col("other").alias("v"))
    level = materialize(relax(roots, both).groupBy("id").agg(F.min("dist").cast("int").alias("depth")), "bridges")
    up = both.join(level.select(F.col("id").alias("u"), F.col("depth").alias("du")), "u").join(level.select(F.col("id").alias("v"), F.col("depth").alias("dv")), "v")
    tree = materialize(up.filter("dv = du - 1").groupBy(F.col("u").alias("id")).agg(F.min("v").alias("parent")).join(level, "id"), "bridges")
    depth = level.agg(F.max("depth")).first()[0] or 0
    as_tree = tree.select(F.least("id", "parent").alias("u"), F.greatest("id", "parent").alias("v"), "id")
    extra = multi.join(as_tree, ["u", "v"], "left").filter((F.col("k") > 1) | F.col("id").isNull()).select(F.col("u").alias("a"), F.col("v").alias("b"))
    walk, covered = extra, None
    climb = tree.select("id", "parent", "depth")
    for _ in range(2 * depth + 1):
        walk = walk.filter("a <> b")
        x = climb.select(F.col("id").alias("a"), F.col("parent").alias("pa"), F.col("depth").alias("da"))
        y = climb.select(F.col("id").alias("b"), F.col("parent").alias("pb"), F.col("depth").alias("db"))
        now = walk.join(x, "a", "left").join(y, "b", "left").fillna(0, ["da", "db"])
        now = materialize(now.withColumn("left_up", F.col("da") >= F.col("db")).withColumn("right_up", F.col("db") >= F.col("da")), "bridges")
        if not now.limit(1).count():
            break
        step = now.filter("left_up").select(F.col("a").alias("id")).unionAll(now.filter("right_up").select(F.col("b").alias("id"))).distinct()
        covered = step if covered is None else covered.unionAll(step)
        walk = now.select(F.when(F.col("left_up"), F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(F.col("right_up"), F.col("pb")).otherwise(F.col("b")).alias("b")).distinct()
    free = as_tree if covered is None else as_tree.join(covered.distinct(), "id", "left_anti")
    return free.select("u", "v")


def two_edge_connectivity(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """fraction of the vertex pairs that no single edge parts: pairs inside what is connected without bridges."""
    n = vertices.count()
    if n < 3:
        return vertices.sparkSession.range(1).select(F.lit(0.0).alias("fraction"))
    plain = edges.filter("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    kept = plain.join(bridges(vertices, edges), ["u", "v"], "left_anti")
    sizes = components(vertices, kept).groupBy("component").agg(F.count("*").alias("k"))
    return sizes.agg((F.sum(F.col("k") * (F.col("k") - 1) / 2) / (n * (n - 1) / 2)).alias("fraction"))


def failure_probability(vertices: DataFrame, edges: DataFrame, k: int = 1, iterations: int = 100, seed: int = 1) -> DataFrame:
    """probability that removing k random edges parts a component; k = 1 exactly (bridges over edges), else by seeded trials.

    Trials are rows: each draws its k edges by rank of a hash, and the components of all trials are found
    in one loop over (trial, vertex) numbers.
    """
    m = edges.count()
    spark = vertices.sparkSession
    if m <= k:
        return spark.range(1).select(F.lit(1.0).alias("probability"))
    if k == 1:
        return bridges(vertices, edges).agg((F.count("*") / m).alias("probability"))
    low, high = vertices.agg(F.min("id"), F.max("id")).first()
    span = high - low + 1
    trials = spark.range(iterations).select(F.col("id").alias("trial"))
    drawn = F.row_number().over(Window.partitionBy("trial").orderBy(F.xxhash64("trial", "u", "v", "_n", F.lit(seed)), "u", "v", "_n"))
    # equal edges are numbered, so that draws do not depend on partitions
    alike = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("k"))
    numbered = alike.select("u", "v", F.explode(F.sequence(F.lit(1).cast("long"), "k")).alias("_n"))
    copies = numbered.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long"))))
    kept = copies.withColumn("_d", drawn).filter(F.col("_d") > k)
    at = lambda c: F.col("trial") * span + F.col(c) - low
    linked = kept.select(at("u").alias("u"), at("v").alias("v"))
    nodes = vertices.withColumn("trial", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(iterations - 1).cast("long")))).select(at("id").alias("id"))
    counts = components(nodes, linked).groupBy(F.floor(F.col("id") / span).alias("trial")).agg(F.count_distinct("component").alias("c"))
    whole = components(vertices, edges).agg(F.count_distinct("component")).first()[0]
    return trials.join(counts, "trial").agg(F.avg((F.col("c") > whole).cast("double")).alias("probability"))


def loop_scores(candidates: DataFrame, edges: DataFrame, require_adjacent: bool = True) -> DataFrame:
    """candidates(u, v, weight) -> with score: shortest path between the ends over weight; 0 for weights of 0 or less, and for ends that are not adjacent."""
    both = ends(edges.select("u", "v", "weight")).select(F.col("id").alias("u"), F.col("other").alias("v"), "weight").groupBy("u", "v").agg(F.min("weight").alias("weight"))
    both = materialize(both, "loops")
    starts = candidates.select(F.col("u").alias("src")).distinct().select("src", F.col("src").alias("id"), F.lit(0.0).alias("dist"))
    paths = relax(starts, both, "weight")
    out = candidates.join(paths.select(F.col("src").alias("u"), F.col("id").alias("v"), "dist"), ["u", "v"], "left")
    out = out.join(both.select("u", "v", F.lit(True).alias("adjacent")), ["u", "v"], "left")
    fine = (F.col("weight") > 0) & F.col("dist").isNotNull()
    if require_adjacent:
        fine = fine & F.col("adjacent").isNotNull()
    return out.select("u", "v", "weight", F.when(fine, F.col("dist") / (F.col("weight") + 1e-6)).otherwise(0.0).alias("score"))


def shortcut_multiplier(path: Column, length: Column, high: float = 0.9, base: float = 0.5, low: float = 0.1) -> Column:
    """Worth of a redundant link by path over length; no length: low; no path: base."""
    ratio = path / length
    bad = length.isNull() | F.isnan(length) | (F.abs(length) == float("inf")) | (length <= 0)
    return F.when(bad, low).when(path.isNull() | (path == float("inf")), base).when(ratio >= 3, high).when(ratio >= 1.5, base).otherwise(low)


def connected_sizes(selected: DataFrame, patches: DataFrame) -> DataFrame:
    """selected(id, patch1, patch2, cost) -> with connected_size: patches and corridors of its component together."""
    links = selected.select(F.col("patch1").alias("u"), F.col("patch2").alias("v"))
    parts = materialize(connected_components(links, small=SMALL), "sizes")
    sized = parts.join(patches.select(F.col("patch_id").alias("id"), F.col("cell_count").cast("double").alias("n")), "id", "left").groupBy("component").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("s"))
    placed = selected.join(parts.withColumnRenamed("id", "patch1"), "patch1")
    costs = placed.groupBy("component").agg(F.sum("cost").cast("double").alias("k"))
    both = sized.join(costs, "component").select("component", (F.col("s") + F.col("k")).alias("connected_size"))
    return placed.join(both, "component").drop("component").select(*selected.columns, "connected_size")


def vector_components(selected: DataFrame, patches: DataFrame) -> DataFrame:
    """selected(id, patch_ids, area) -> with component_id, connected_area (patches alone), efficiency, multipart."""
    star = selected.withColumn("_o", F.explode(F.slice("patch_ids", 2, F.greatest(F.size("patch_ids") - 1, F.lit(1))))).select(F.col("patch_ids")[0].alias("u"), F.col("_o").alias("v"))
    parts = materialize(connected_components(star, small=SMALL), "sizes")
    areas = parts.join(patches.select(F.col("patch_id").alias("id"), "area"), "id").groupBy("component").agg(F.sum("area").alias("connected_area"))
    ids = areas.select("component", F.row_number().over(Window.orderBy("component")).cast("long").alias("component_id"), "connected_area")
    out = selected.withColumn("_first", F.col("patch_ids")[0]).join(parts.withColumnRenamed("id", "_first"), "_first").join(ids, "component")
    return out.withColumn("efficiency", F.col("connected_area") / F.greatest(F.col("area"), F.lit(1e-6))).withColumn("multipart", F.size("patch_ids") > 2).drop("_first", "component")
