"""From polygons to corridors: merging, candidates, choice, networks and report."""

from __future__ import annotations

import math
import time
import warnings as py_warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmosaic.errors import GeometryError, InputError
from linkmosaic.functions.units import area_divisor, distance_factor, is_projected, utm_epsg, utm_forward, utm_inverse
from linkmosaic.operators import geometry as g
from linkmosaic.operators import graph, labels, landscape, pairs, selection
from linkmosaic.sources.schema import VECTOR_CANDIDATES, RasterMeta, Result
from linkmosaic.sources.shared import materialize

TOGETHER = 64  # pairs of patches that Python gets at a time
KEEP = 8  # candidates kept for a pair
ALIKE = 0.75  # overlap from which two candidates of a pair are one
GRID = 50.0  # metres a cell of the report's raster
POLY = "array<array<array<double>>>"
COLUMNS = [k.strip().split()[0] for k in VECTOR_CANDIDATES.split(", ")]


def _plain(slabs: list[tuple]) -> list:
    return [[[a, y0], [b, y0], [d, y1], [c, y1], [a, y0]] for y0, a, b, y1, c, d in slabs]


def _wide(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def prepared(shapes: DataFrame, repair: bool = True) -> DataFrame:
    """(id, geom) -> (id, geom, area, perimeter, x, y, bounds), empty shapes left out, crossing sides repaired or refused."""

    def run(batches):
        for b in batches:
            rows = []
            for i, geom in zip(b["id"], b["geom"], strict=True):
                shape = g.rings(geom) if geom is not None else []
                shape = [p for p in shape if len(p) > 2]
                if not shape:
                    continue
                many = [shape]
                if not g.is_valid(shape):
                    if not repair:
                        raise GeometryError(f"polygon {i} is not valid")
                    many = g.repair(shape)
                if not many:
                    continue
                slabs_area = sum(g.area(p) for p in many)
                x = sum(g.centroid(p)[0] * g.area(p) for p in many) / slabs_area
                y = sum(g.centroid(p)[1] * g.area(p) for p in many) / slabs_area
                flat = [p.tolist() for part in many for p in part]
                rows.append((i, flat, slabs_area, sum(g.perimeter(p) for p in many), x, y, *g.box([p for part in many for p in part])))
            yield pd.DataFrame(rows, columns=["id", "geom", "area", "perimeter", "x", "y", "x0", "y0", "x1", "y1"])

    # few bytes and much work: dealt out by number here and below, or few tasks would get them all
    return shapes.select(F.col("id").cast("long").alias("id"), "geom").repartition(_wide(shapes)).mapInPandas(run, f"id long, geom {POLY}, area double, perimeter double, x double, y double, x0 double, y0 double, x1 double, y1 double")


def _step(shapes: DataFrame, most: float) -> float:
    """Width of the bins: the distance, or the usual size of a shape; larger shapes lie in more bins."""
    size = shapes.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    return max(size, most, 1e-9)


def near_polygons(shapes: DataFrame, most: float) -> DataFrame:
    """(i, j, dist, line) of prepared polygons at a distance of most or less; boxes meet in bins, then exact distances."""
    step = _step(shapes, most)
    names = ["id", "geom", "x0", "y0", "x1", "y1"]
    left = _bins(shapes.select(*names), step, most).select("bx", "by", *[F.col(k).alias(f"a_{k}") for k in names])
    right = _bins(shapes.select(*names), step).select("bx", "by", *[F.col(k).alias(f"b_{k}") for k in names])
    close = (F.col("a_x0") - most <= F.col("b_x1")) & (F.col("b_x0") - most <= F.col("a_x1")) & (F.col("a_y0") - most <= F.col("b_y1")) & (F.col("b_y0") - most <= F.col("a_y1"))
    # the pair belongs to the bin where the lower corner of the boxes' common part lies
    home = (F.col("bx") == F.greatest(F.floor((F.col("a_x0") - most) / step), F.floor(F.col("b_x0") / step))) & (F.col("by") == F.greatest(F.floor((F.col("a_y0") - most) / step), F.floor(F.col("b_y0") / step)))
    both = left.join(right, ["bx", "by"]).filter(close & home & (F.col("a_id") < F.col("b_id")))

    def run(batches):
        for b in batches:
            rows = []
            for i, j, p, q in b[["a_id", "b_id", "a_geom", "b_geom"]].itertuples(index=False):
                d, u, v = g.nearest(g.rings(p), g.rings(q))
                if d <= most:
                    rows.append((i, j, d, [u.tolist(), v.tolist()]))
            yield pd.DataFrame(rows, columns=["i", "j", "dist", "line"])

    return both.select("a_id", "b_id", "a_geom", "b_geom").repartition(_wide(shapes)).mapInPandas(run, "i long, j long, dist double, line array<array<double>>")


def merge_touching(shapes: DataFrame) -> DataFrame:
    """Prepared polygons -> (id, geom) with those that touch merged; the id is the group's smallest."""
    held = materialize(shapes, "shapes")
    touch = near_polygons(held, 0.0)
    parts = graph.components(held.select("id"), touch.select(F.col("i").alias("u"), F.col("j").alias("v")))
    grouped = held.join(parts, "id").repartition(_wide(shapes), "component").groupBy("component").agg(F.collect_list("geom").alias("geoms"))

    def run(batches):
        for b in batches:
            rows = []
            for i, geoms in zip(b["component"], b["geoms"], strict=True):
                many = [g.rings(x) for x in geoms]
                flat = [p.tolist() for p in (many[0] if len(many) == 1 else g.outline(g.overlay(many)))]
                rows.append((i, flat))
            yield pd.DataFrame(rows, columns=["id", "geom"])

    return grouped.mapInPandas(run, f"id long, geom {POLY}")


def _corridor(i: int, j: int, line: np.ndarray, width: float, shapes: dict, walls: list, single: bool) -> list[tuple]:
    """Candidates of one line: (patch ids, slabs, connected)."""
    raw = g.buffer_line(line, width / 2)
    x0, y0, x1, y1 = g.box([p for part in raw for p in part])
    around = {k: s for k, s in shapes.items() if (b := g.box(s)) and b[0] <= x1 and b[2] >= x0 and b[1] <= y1 and b[3] >= y0}
    touched = [k for k, s in around.items() if k in (i, j) or g.slabs_area(g.overlay(raw, both=[s])) > 0]
    left = g.overlay(raw, drop=[*around.values(), *walls])
    if not left:
        return []
    parts = g.slabs_parts(left)
    extra = sorted(set(touched) - {i, j})
    # a part is connected, so its trapezoids can be asked together
    away = lambda part, k: g.nearest([ring for p in g.slabs_polygons(part) for ring in p], shapes[k])[0]
    if extra and len(parts) > 1:
        out = []
        for end in (i, j):
            part = min(parts, key=lambda q, end=end: away(q, end))
            other = min(extra, key=lambda k, end=end: g.nearest(shapes[end], shapes[k])[0])
            out.append(([end, other], part, max(away(part, end), away(part, other)) <= 1e-6 * max(1.0, width)))
        return out
    if extra and single:
        return []
    whole = any(max(away(p, i), away(p, j)) <= 1e-6 * max(1.0, width) for p in parts)
    return [([i, j, *extra], left, whole)]


def _bins(df: DataFrame, step: float, pad: float = 0.0) -> DataFrame:
    """Rows with a box (x0, y0, x1, y1) once for each square bin (bx, by) that the box, padded, meets."""
    cut = lambda lo, hi: F.explode(F.sequence(F.floor((F.col(lo) - pad) / step), F.floor((F.col(hi) + pad) / step)))
    return df.withColumn("bx", cut("x0", "x1")).withColumn("by", cut("y0", "y1"))


def _shapes_near(regions: DataFrame, shapes: DataFrame, step: float) -> DataFrame:
    """(i, j, + the columns of shapes but the box) of shapes whose box meets the region's box; each pair once."""
    box = ("x0", "y0", "x1", "y1")
    left = _bins(regions, step).select("i", "j", "bx", "by", *[F.col(k).alias(f"r_{k}") for k in box])
    right = _bins(shapes, step)
    meet = (F.col("r_x0") <= F.col("x1")) & (F.col("x0") <= F.col("r_x1")) & (F.col("r_y0") <= F.col("y1")) & (F.col("y0") <= F.col("r_y1"))
    home = lambda k: F.greatest(F.floor(F.col(f"r_{k}0") / step), F.floor(F.col(f"{k}0") / step))
    out = left.join(right, ["bx", "by"]).filter(meet & (F.col("bx") == home("x")) & (F.col("by") == home("y")))
    return out.select("i", "j", *[c for c in shapes.columns if c not in box])


def vector_candidates(shapes: DataFrame, search: float, width: float, obstacles: DataFrame | None = None, resolution: float | None = None, strategy: str = "circuit_utility", compat: bool = False, most_pairs: int | None = None) -> DataFrame:
    """Candidates (VECTOR_CANDIDATES) of prepared polygons up to `search` apart; obstacles are prepared polygons too.

    Without obstacles the line runs between the nearest places; with them, around them on a grid from
    centroid to centroid, or straight where no way is found.  Corridors are widened lines without obstacles
    and patches; those that do not connect their patches are left out, unless compat.  A corridor is cut by
    whatever it meets: a join by bins brings each pair the polygons and obstacles around it, and no others.
    most_pairs: more near pairs than that are refused.
    """
    res = resolution or max(width / 2, search / 200)
    near = materialize(near_polygons(shapes, search).filter("dist > 0"), "pairs")
    n_pairs = near.count()
    if most_pairs is not None:
        pairs.guard_count(n_pairs, most_pairs, "pairs of patches to look for corridors between")
    box = ("x0", "y0", "x1", "y1")
    if obstacles is None:
        at = lambda k: (F.col("line")[0][k], F.col("line")[1][k])
        ends = [F.least(*at(0)), F.least(*at(1)), F.greatest(*at(0)), F.greatest(*at(1))]
        regions, pad = near.select("i", "j", *[e.alias(k) for e, k in zip(ends, box, strict=True)]), width
    else:
        sides = [shapes.select(F.col("id").alias(i), *[F.col(k).alias(f"{k}_{i}") for k in box]) for i in "ij"]
        both = near.select("i", "j").join(sides[0], "i").join(sides[1], "j")
        regions, pad = both.select("i", "j", *[(F.least if k[1] == "0" else F.greatest)(f"{k}_i", f"{k}_j").alias(k) for k in box]), search / 2 + width
    regions = regions.select("i", "j", *[(F.col(k) - pad if k[1] == "0" else F.col(k) + pad).alias(k) for k in box])
    items = shapes.select(F.lit(False).alias("wall"), "id", "geom", "area", "x", "y", *box)
    if obstacles is not None:
        items = items.unionByName(obstacles.select(F.lit(True).alias("wall"), "id", "geom", "area", "x", "y", *box))
    around = _shapes_near(regions, items, _step(shapes, search))
    lot = F.pmod(F.xxhash64("i", "j"), F.lit(max(1, -(-n_pairs // TOGETHER)))).alias("lot")
    routed_by_grid = obstacles is not None

    def run(lines: pd.DataFrame, nearby: pd.DataFrame) -> pd.DataFrame:
        held: dict = {}
        rings_of: dict = {}
        for x in nearby.itertuples(index=False):
            if (x.wall, x.id) not in rings_of:
                rings_of[x.wall, x.id] = g.rings(x.geom)
            held.setdefault((x.i, x.j), []).append(x)
        out = []
        for i, j, dist, line in lines[["i", "j", "dist", "line"]].itertuples(index=False):
            here = sorted(held[i, j], key=lambda x: (x.wall, x.id))
            patches = {x.id: rings_of[False, x.id] for x in here if not x.wall}
            areas = {x.id: x.area for x in here if not x.wall}
            walls = [rings_of[True, x.id] for x in here if x.wall]
            way = np.array([list(p) for p in line])
            if routed_by_grid:
                x0, y0, x1, y1 = g.box([*patches[i], *patches[j]])
                edge = search / 2
                start, goal = ((x.x, x.y) for k in (i, j) for x in here if not x.wall and x.id == k)
                routed = g.least_cost_line(start, goal, (x0 - edge, y0 - edge, x1 + edge, y1 + edge), res, walls, width / 2) if walls else None
                way = way if routed is None else routed
            length = float(np.hypot(*np.diff(way, axis=0).T).sum())
            for ids, slabs, whole in _corridor(i, j, way, width, patches, walls, strategy == "largest_network"):
                if whole or compat:
                    size = g.slabs_area(slabs)
                    roi = math.sqrt(areas[ids[0]] * areas[ids[1]]) / max(size, 1e-6)
                    a, c = sorted(ids[:2])
                    out.append((a, c, size, length, size, 0, roi, dist, ids, whole, way.tolist(), _plain(slabs)))
        return pd.DataFrame(out, columns=COLUMNS)

    def distinct(p: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        slabs = lambda k: [(q[0][1], q[0][0], q[1][0], q[2][1], q[3][0], q[2][0]) for q in p["corridor"].iloc[k]]
        groups: dict = {}
        for k, pair in enumerate(zip(p["patch1"], p["patch2"], strict=True)):
            groups.setdefault(pair, []).append(k)
        for rows in groups.values():
            mine: list[tuple[int, list]] = []
            for k in sorted(rows, key=lambda k: (p["area"].iloc[k], p["length"].iloc[k])) if len(rows) > 1 else rows:
                shape = slabs(k) if len(rows) > 1 else []
                if all(g.overlap_ratio(shape, other) < ALIKE for _, other in mine):
                    mine.append((k, shape))
                    if len(mine) == KEEP:
                        break
            kept += [k for k, _ in mine]
        return p.iloc[kept][COLUMNS]

    lots = [df.select(*[F.col(k).alias(k) for k in df.columns]).select("*", lot).repartition(_wide(shapes), "lot") for df in (near, around)]
    found = materialize(lots[0].groupBy("lot").cogroup(lots[1].groupBy("lot")).applyInPandas(run, VECTOR_CANDIDATES), "candidates")
    by_pair = F.pmod(F.xxhash64("patch1", "patch2"), F.lit(max(1, -(-n_pairs // TOGETHER)))).alias("lot")
    several = found.groupBy("patch1", "patch2").count().filter("count > 1").select("patch1", "patch2")
    alike = found.join(several, ["patch1", "patch2"], "left_semi").select("*", by_pair).repartition(_wide(shapes), "lot")
    alone = found.join(several, ["patch1", "patch2"], "left_anti").select(*COLUMNS)
    held = materialize(alone.unionByName(alike.groupBy("lot").applyInPandas(distinct, VECTOR_CANDIDATES)), "candidates")
    order = ["patch1", "patch2", "area", "length"]
    ids = held.select(*order, F.xxhash64("line").alias("_line"))
    ids = selection.running_total(ids.withColumn("_one", F.lit(1).cast("long")), [*order, "_line"], "_one", "_id").drop("_one")
    numbered = held.withColumn("_line", F.xxhash64("line")).drop("id").join(ids.withColumnRenamed("_id", "id"), [*order, "_line"])
    return numbered.select(*held.columns)


def dissolve(corridors: DataFrame, shapes: DataFrame) -> DataFrame:
    """(component_id, patch_ids, corridor), (id, geom) -> (component_id, area, geom): patches and corridors of each network as one."""
    pieces = corridors.select("component_id", F.explode("corridor").alias("ring")).select("component_id", F.array("ring").alias("geom"))
    patches = corridors.select("component_id", F.explode("patch_ids").alias("id")).distinct().join(shapes.select("id", "geom"), "id").select("component_id", "geom")
    grouped = pieces.unionByName(patches).groupBy("component_id").agg(F.collect_list("geom").alias("geoms"))

    def run(batches):
        for b in batches:
            rows = []
            for i, geoms in zip(b["component_id"], b["geoms"], strict=True):
                slabs = g.overlay([g.rings(x) for x in geoms])
                rows.append((i, g.slabs_area(slabs), _plain(slabs)))
            yield pd.DataFrame(rows, columns=["component_id", "area_m2", "geom"])

    return grouped.mapInPandas(run, f"component_id long, area_m2 double, geom {POLY}")


def rasterized(shapes: DataFrame, meta: RasterMeta) -> DataFrame:
    """Cells (cell, r, c) whose centre lies in a polygon (geom)."""

    def run(batches):
        for b in batches:
            out = [np.empty((2, 0), int)]
            for geom in b["geom"]:
                many = g.rings(geom)
                x0, y0, x1, y1 = g.box(many)
                cs = np.arange(max(1, math.floor((x0 - meta.xmin) / meta.res_x)), min(meta.ncol, math.ceil((x1 - meta.xmin) / meta.res_x) + 1) + 1)
                for r in range(max(1, meta.nrow - math.ceil((y1 - meta.ymin) / meta.res_y)), min(meta.nrow, meta.nrow - math.floor((y0 - meta.ymin) / meta.res_y) + 1) + 1):
                    y = meta.ymin + (meta.nrow - r + 0.5) * meta.res_y
                    on = g.contains(many, np.stack([meta.xmin + (cs - 0.5) * meta.res_x, np.full(len(cs), y)], axis=1)) if len(cs) else np.array([], bool)
                    out.append(np.stack([np.full(int(on.sum()), r), cs[on]]))
            r, c = np.concatenate(out, axis=1)
            yield pd.DataFrame({"cell": (r - 1) * meta.ncol + c, "r": r, "c": c})

    return shapes.select("geom").repartition(_wide(shapes)).mapInPandas(run, "cell long, r long, c long").distinct()


def reproject(shapes: DataFrame, epsg: int, inverse: bool = False) -> DataFrame:
    """geom between degrees and a UTM zone (EPSG 326xx or 327xx), in Column maths."""
    zone, south = F.lit(epsg % 100), F.lit(epsg // 100 == 327)
    turn = (lambda p: F.array(*utm_inverse(p[0], p[1], zone, south))) if inverse else (lambda p: F.array(*utm_forward(p[0], p[1], zone)))
    return shapes.withColumn("geom", F.transform("geom", lambda ring: F.transform(ring, turn)))


@dataclass
class Found:
    """What the search for candidates gives: units, warnings, tables and counts."""

    div: float
    step: float
    turned: int | None
    notes: list[str]
    patches: DataFrame
    candidates: DataFrame
    n: int
    n_merged: int


def search_corridors(
    shapes: DataFrame,
    budget: float,
    crs: int | None = None,
    units: str = "metric",
    strategy: str = "circuit_utility",
    min_patch_size: float = 1.0,
    min_corridor_width: float = 20.0,
    max_search_distance: float = 500.0,
    obstacles: list[DataFrame] | None = None,
    obstacle_resolution: float | None = None,
    max_pair_checks: int = 2_000_000,
    repair: bool = True,
    compat: bool = False,
) -> Found:
    """Patches of (id, geom) and the candidate corridors between them.

    max_pair_checks bounds the pairs of patches that are looked at: those within the search distance, which
    the bins find without a look at the others.
    """
    notes: list[str] = []
    if crs is None:
        raise InputError("a coordinate system is needed")
    if not budget > 0 or not max_search_distance > 0 or not min_corridor_width > 0:
        raise InputError("budget, search distance and width must be above 0")
    if units not in ("metric", "imperial"):
        raise InputError(f"unknown units {units!r}")
    div, step = area_divisor(units), 1 / distance_factor(units)
    work, turned = shapes.select("id", "geom"), None
    if not is_projected(crs):
        centre = work.select(F.explode(F.flatten("geom")).alias("p")).agg(F.avg(F.col("p")[0]).alias("x"), F.avg(F.col("p")[1]).alias("y"))
        turned = int(centre.select(utm_epsg(F.col("x"), F.col("y"))).first()[0])
        work = reproject(work, turned)
    ready = materialize(prepared(work, repair), "shapes")
    raw = ready.count()
    if raw < shapes.count():
        notes.append("empty polygons were left out")
    merged = materialize(prepared(merge_touching(ready)), "shapes")
    n_merged = merged.count()
    large = merged.filter(F.col("area") >= min_patch_size * div)
    ranks = labels.dense_numbers(large.select("id"), "id", "_rank")
    patches = materialize(large.join(ranks, "id").withColumn("id", F.col("_rank")).drop("_rank"), "patches")
    n = patches.count()
    if n < 2:
        raise InputError("at least two polygons of the minimum size are needed")
    walls = None
    for k, layer in enumerate(obstacles or []):
        ready_layer = prepared(reproject(layer, turned) if turned else layer, repair).withColumn("id", F.xxhash64(F.lit(k), "id", "geom"))
        walls = ready_layer if walls is None else walls.unionByName(ready_layer)
    walls = materialize(walls, "obstacles") if walls is not None else None
    width, search = min_corridor_width * step, max_search_distance * step
    candidates = materialize(vector_candidates(patches, search, width, walls, obstacle_resolution, strategy, compat, max_pair_checks), "candidates")
    return Found(div, step, turned, notes, patches, candidates, n, n_merged)


def find_corridors(
    shapes: DataFrame,
    budget: float,
    crs: int | None = None,
    units: str = "metric",
    strategy: str = "circuit_utility",
    min_patch_size: float = 1.0,
    min_corridor_width: float = 20.0,
    max_search_distance: float = 500.0,
    obstacles: list[DataFrame] | None = None,
    obstacle_resolution: float | None = None,
    max_pair_checks: int = 2_000_000,
    max_candidates: int = 200_000,
    return_crs: str = "input",
    repair: bool = True,
    compat: bool = False,
) -> Result:
    """(id, geom) -> Result with tables patches, candidates, corridors, networks, report.

    The coordinate system is needed; degrees are worked on in the UTM zone of the first centroid's mean and
    turned back in the end if return_crs is input.
    """
    began = time.monotonic()
    found = search_corridors(shapes, budget, crs, units, strategy, min_patch_size, min_corridor_width, max_search_distance, obstacles, obstacle_resolution, max_pair_checks, repair, compat)
    div, step, turned, notes, patches, candidates = found.div, found.step, found.turned, found.notes, found.patches, found.candidates
    n, n_merged = found.n, found.n_merged
    width, search = min_corridor_width * step, max_search_distance * step
    limit = budget * div
    n_candidates = candidates.count()
    pairs.guard_count(n_candidates, max_candidates, "candidate corridors")
    weights = patches.select(F.col("id").alias("patch_id"), F.col("area").alias("weight"))
    stats = {"primary_links": 0, "redundant_links": 0}
    if strategy == "largest_network":
        edges = candidates.select(F.col("patch1").alias("u"), F.col("patch2").alias("v"), "id", "cost")
        chosen = selection.largest_network(weights.withColumnRenamed("patch_id", "id"), edges, limit)["selected"]
        selected = candidates.join(chosen.select("id"), "id", "left_semi")
    else:
        fields = ["id", "patch_ids", "cost", "length", "roi", "line"]
        pack = candidates.agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("c"))
        sizes = weights.agg(F.collect_list(F.struct("patch_id", "weight")).alias("w"))

        def apart(c: dict, chosen: list[dict]) -> bool:
            # corridors are lines widened by half a width on either side
            for x in (c, *chosen):
                if "way" not in x:
                    x["way"] = np.array([list(p) for p in x["line"]])
            return all(g.lines_apart(c["way"], x["way"]) - width >= search for x in chosen)

        def run(batches):
            for b in batches:
                for c, w in b[["c", "w"]].itertuples(index=False):
                    pool = [{**{k: x[k] for k in fields}, "patch_ids": list(x["patch_ids"])} for x in c]
                    picks, _ = selection.circuit_utility(pool, {x["patch_id"]: x["weight"] for x in w}, limit, pair_limit=1, far_enough=apart)
                    yield pd.DataFrame([(p["id"], p["kind"]) for p in picks], columns=["id", "kind"])

        picked = materialize(pack.crossJoin(sizes).mapInPandas(run, "id long, kind string"), "picked")
        kinds = {r["kind"]: r["count"] for r in picked.groupBy("kind").count().collect()}
        stats = {"primary_links": kinds.get("primary", 0), "redundant_links": kinds.get("redundant", 0)}
        selected = candidates.join(picked.select("id"), "id", "left_semi")
    before = selected.count()
    selected = materialize(selection.one_per_pair(selected), "selected")
    used, spent = selected.agg(F.count("*"), F.coalesce(F.sum("cost"), F.lit(0.0))).first()
    if used < before:
        stats = {"primary_links": used, "redundant_links": 0}
    corridors = materialize(graph.vector_components(selected, patches.select(F.col("id").alias("patch_id"), "area")), "corridors")
    nets = materialize(dissolve(corridors, patches), "networks")
    x0, y0, x1, y1 = patches.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    meta = RasterMeta(math.ceil((y1 - y0) / GRID) + 4, math.ceil((x1 - x0) / GRID) + 4, x0 - 2 * GRID, y0 - 2 * GRID, GRID, GRID, turned or crs)
    pre = materialize(rasterized(patches, meta), "cells")
    rings = corridors.select(F.explode("corridor").alias("r")).select(F.array("r").alias("geom"))
    post = materialize(pre.unionByName(rasterized(rings, meta)).distinct(), "cells")
    report = materialize(landscape.report_rows(pre, post, meta, units), "report")
    corridors = corridors.select(
        "id", "patch1", "patch2", F.concat_ws(",", F.col("patch_ids").cast("array<string>")).alias("patch_ids"), F.col("area").alias("corridor_area_m2"), F.col("length").alias("corridor_length_m"),
        "component_id", F.col("connected_area").alias("connected_area_m2"), "efficiency", "multipart", "is_connected",
        (F.col("area") / div).alias("corridor_area"), (F.col("connected_area") / div).alias("connected_area"), (F.col("length") / step).alias("corridor_length"), F.col("corridor").alias("geom"),
    )
    tables = {"patches": patches, "corridors": corridors, "networks": nets, "candidates": candidates, "report": report}
    if turned and return_crs == "input":
        for k in ("patches", "corridors", "networks"):
            tables[k] = reproject(tables[k], turned, inverse=True)
    if not used:
        notes.append("no corridor was chosen")
    for text in notes:
        py_warnings.warn(text, stacklevel=2)
    n_pairs = candidates.select("patch1", "patch2").distinct().count()
    summary = {"budget_total": budget, "budget_used": float(spent) / div, "corridors_used": used, "candidate_edges": n_candidates, "candidate_pairs": n_pairs, "possible_pairs": n * (n - 1) // 2, "patches": n, "raw_patches": n_merged, "filtered_out": n_merged - n, **stats, "units": units}
    inputs = {"units": units, "budget": budget, "crs_input": crs, "crs_work": turned or crs, "crs_output": crs if return_crs == "input" else turned or crs}
    return Result("vector", inputs, tables, summary, landscape.report_lines(report), notes, {}, {"elapsed_s": time.monotonic() - began, "candidate_edges": n_candidates, "candidate_pairs": n_pairs})
