"""Least-cost corridors between patches over raster cells, and the candidates that they make."""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmosaic.operators.graph import relax
from linkmosaic.operators.masks import disc_offsets, square_offsets
from linkmosaic.operators.pairs import block_subsample, boundary_cells, boundary_pairs, guard_count, moves, pair_seeds, start_positions
from linkmosaic.operators.selection import running_total
from linkmosaic.sources.schema import RASTER_CANDIDATES, RasterMeta
from linkmosaic.sources.shared import materialize

#: Fixed values of the cell codes that routing looks at.
FREE, WALL, BRIDGE = 0, 1, 2
TOGETHER = 32  # pairs of patches that Python gets at a time
KEEP = 4  # routes kept for a pair of patches
ALIKE = 0.75  # share of a route's cells in an earlier one from which it is left out


class Window:
    """A part of the raster around a pair, as one list of codes row by row in a frame of walls: WALL, FREE, BRIDGE or a patch (10 + its id)."""

    def __init__(self, r, c, patch, code, start_of, meta: RasterMeta) -> None:
        self.r0, self.c0 = int(r.min()), int(c.min())
        self.wide = int(c.max()) - self.c0 + 3
        at = (r - self.r0 + 1) * self.wide + (c - self.c0 + 1)
        held = np.full((int(r.max()) - self.r0 + 3) * self.wide, WALL, np.int64)
        held[at] = np.where(patch > 0, patch + 10, code)
        self.codes, self.code = held, held.tolist()
        self.left: dict[tuple, list[float]] = {}
        self.begins = (at, start_of)
        self.ncol = meta.ncol

    def to_go(self, p2: int, most: float, connectivity: int) -> list[float]:
        """What the way to beside p2 costs at least from each place; infinite above `most`, and where nothing is open."""
        if (p2, most, connectivity) not in self.left:
            code, n = self.codes, len(self.codes)
            inner = slice(self.wide + 1, n - self.wide - 1)
            open_ = ((code == FREE) | (code == BRIDGE))[inner]
            step = np.where(code == BRIDGE, 0.0, 1.0)
            near = [(dr * self.wide + dc, math.sqrt(2) if dr and dc else 1.0) for dr, dc in moves(connectivity)]
            shift = lambda a, k: a[inner.start + k : inner.stop + k]
            out = np.full(n, np.inf)
            beside = np.any([shift(code, k) == p2 + 10 for k, _ in near], axis=0)
            out[inner][open_ & beside] = 0.0
            while True:
                now = np.min([shift(out, k) + shift(step, k) * length for k, length in near], axis=0)
                now[~open_ | (now > most)] = np.inf
                lower = now < out[inner] - 1e-12
                if not lower.any():
                    break
                out[inner][lower] = now[lower]
            self.left[p2, most, connectivity] = out.tolist()
        return self.left[p2, most, connectivity]

    def cell(self, at: int) -> int:
        r, c = divmod(at, self.wide)
        return (r - 1 + self.r0 - 1) * self.ncol + c - 1 + self.c0

    def place(self, r: int, c: int) -> tuple[int, int]:
        """Row and column in the frame of a place of the raster."""
        return r - self.r0 + 1, c - self.c0 + 1


def shortest_corridor(win: Window, p1: int, p2: int, most: float, connectivity: int, start: tuple | None, goal: tuple | None) -> tuple[float, list, list] | None:
    """(cost, path cells from the goal's end back, bridge cells) of the cheapest way from beside p1 to p2, or None.

    Starts cost 0; a step costs 1 or the root of 2, none in habitat that belongs to no patch; the step into
    p2 is free; other patches and obstacles are walls.  start and goal are (row, column, radius) boxes.
    Places from which p2 is too far for the cheapest way, or for `most`, are not looked at.
    """
    wide, code, target = win.wide, win.code, p2 + 10
    to_go = win.to_go(p2, most, connectivity)
    begins = np.sort(win.begins[0][win.begins[1] == p1])
    if start is not None and len(begins):
        inside = (np.abs(begins // wide - start[0]) <= start[2]) & (np.abs(begins % wide - start[1]) <= start[2])
        begins = begins[inside] if inside.any() else begins
    begins = begins.tolist()
    least = min((to_go[k] for k in begins), default=math.inf)
    steps = [(dr * wide + dc, math.sqrt(2) if dr and dc else 1.0) for dr, dc in moves(connectivity)]
    for bound in (least, most) if math.isfinite(least) else ():
        got = _search(win, begins, target, to_go, steps, bound + 1e-9, most, goal)
        if got is not None or least >= most:
            return got
    return None


def _search(win: Window, begins: list[int], target: int, to_go: list[float], steps: list[tuple[int, float]], bound: float, most: float, goal: tuple | None) -> tuple[float, list, list] | None:
    wide, code = win.wide, win.code
    cost = {k: 0.0 for k in begins if to_go[k] <= bound}
    came: dict = {}
    heap = [(0.0, k) for k in cost]
    while heap:
        d, k = heapq.heappop(heap)
        if d > cost[k]:
            continue
        for move, length in steps:
            to = k + move
            kind = code[to]
            if kind == target:
                if goal is None or max(abs(to // wide - goal[0]), abs(to % wide - goal[1])) <= goal[2]:
                    path, bridge, at = [], [], k
                    while at is not None:
                        (bridge if code[at] == BRIDGE else path).append(win.cell(at))
                        at = came.get(at)
                    return d, path, bridge
            elif kind == FREE or kind == BRIDGE:
                now = d if kind == BRIDGE else d + length
                if now <= most and now + to_go[to] <= bound and now < cost.get(to, math.inf):
                    cost[to], came[to] = now, k
                    heapq.heappush(heap, (now, to))
    return None


def _moved(cells, offsets, meta: RasterMeta) -> set[int]:
    rc = np.array([divmod(k - 1, meta.ncol) for k in cells]).reshape(-1, 1, 2) + np.array(offsets).reshape(1, -1, 2)
    rc = rc.reshape(-1, 2)
    ok = (rc >= 0).all(axis=1) & (rc[:, 0] < meta.nrow) & (rc[:, 1] < meta.ncol)
    return set((rc[ok, 0] * meta.ncol + rc[ok, 1] + 1).tolist())


def raster_candidates(cells: DataFrame, patches: DataFrame, meta: RasterMeta, search: float, width: float = 1, connectivity: int = 4, compat: bool = True, most_pairs: int | None = None) -> DataFrame:
    """Candidate corridors (RASTER_CANDIDATES) of the pairs of patches that have seeds within `search` cells.

    cells: cell, r, c, patch_id (0: none), habitat, obstacle, passable.  A pair's seeds tell where to look.
    A pair is routed in the part of the raster around its seeds, widened by the search distance; a route
    that leaves this part by free travel through stray habitat is not found.  Blocks of the raster, a row
    each, are sent to the pairs by an equi-join, so no task sees the whole raster unless a pair spans it;
    some TOGETHER pairs go to Python at once, as a call costs more than most pairs.  most_pairs: more pairs with seeds than that are refused.
    """
    labelled = cells.filter("patch_id > 0")
    thin = block_subsample(boundary_cells(labelled.select("cell", "r", "c", "patch_id"), meta, connectivity))
    seeds = materialize(pair_seeds(boundary_pairs(thin, search, compat), width), "seeds")
    n_pairs = seeds.filter("seed = 1").count()
    if most_pairs is not None:
        guard_count(n_pairs, most_pairs, "pairs of patches to look for corridors between")
    reach = int(math.ceil(search)) + int(math.ceil(width)) + 2
    block = max(16, min(256, reach))
    box = seeds.groupBy("p1", "p2").agg(
        (F.min(F.least("r1", "r2")) - reach).alias("ra"), (F.max(F.greatest("r1", "r2")) + reach).alias("rb"),
        (F.min(F.least("c1", "c2")) - reach).alias("ca"), (F.max(F.greatest("c1", "c2")) + reach).alias("cb"),
    )
    blocks = lambda a, b, top: F.explode(
        F.sequence(F.greatest(F.floor((F.col(a) - 1) / block), F.lit(0)).cast("int"), F.least(F.floor((F.col(b) - 1) / block), F.lit((top - 1) // block)).cast("int"))
    )
    wanted = box.withColumn("br", blocks("ra", "rb", meta.nrow)).withColumn("bc", blocks("ca", "cb", meta.ncol))
    begins = start_positions(cells.withColumn("patch_id", F.when(F.col("patch_id") > 0, F.col("patch_id"))), meta, connectivity).select("cell", F.col("patch_id").alias("start_of"))
    stray = F.col("habitat") & (F.col("patch_id") == 0) & ~F.col("obstacle")
    code = F.when(F.col("obstacle"), WALL).when(stray, BRIDGE).when(F.col("passable"), FREE).otherwise(WALL)
    coded = cells.join(begins, "cell", "left").select(
        "r", "c", F.col("patch_id").cast("long").alias("patch_id"), code.cast("int").alias("code"), F.coalesce("start_of", F.lit(0)).cast("long").alias("start_of"),
        F.floor((F.col("r") - 1) / block).cast("int").alias("br"), F.floor((F.col("c") - 1) / block).cast("int").alias("bc"),
    )
    fields = ("r", "c", "patch_id", "code", "start_of")
    packed = coded.groupBy("br", "bc").agg(F.collect_list(F.struct(*fields)).alias("cells"))
    packed = packed.select("br", "bc", *[F.col(f"cells.{k}").alias(k) for k in fields])
    sent = wanted.select("p1", "p2", "br", "bc").join(packed, ["br", "bc"]).drop("br", "bc")
    sizes = patches.select("patch_id", F.col("cell_count").cast("double").alias("n"))
    hints = seeds.join(sizes.select(F.col("patch_id").alias("p1"), F.col("n").alias("n1")), "p1").join(sizes.select(F.col("patch_id").alias("p2"), F.col("n").alias("n2")), "p2")
    disc, grow = disc_offsets(width), square_offsets(max(1, math.ceil(width / 2)))
    near = max(4, math.ceil(2 * width))

    def route(s: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple] = []
        blocks_of: dict = {}
        for x in g.itertuples(index=False):
            blocks_of.setdefault((x.p1, x.p2), []).append(x)
        seeds_of: dict = {}
        for x in s.sort_values("seed").itertuples(index=False):
            seeds_of.setdefault((x.p1, x.p2), []).append(x)
        for (p1, p2), seeds_here in seeds_of.items():
            r, c, patch, code, start_of = (np.concatenate([getattr(x, k) for x in blocks_of[p1, p2]]).astype(np.int64) for k in fields)
            win = Window(r, c, patch, code, start_of, meta)
            shut = set(((r - 1) * meta.ncol + c)[(code == WALL) | (patch > 0)].tolist())
            kept: list[set] = []
            for x in seeds_here:
                a, b = (*win.place(x.r1, x.c1), near), (*win.place(x.r2, x.c2), near)
                got = shortest_corridor(win, p1, p2, search, connectivity, a, b)
                if got is None and x.seed == 1:
                    got = shortest_corridor(win, p1, p2, search, connectivity, a, None)
                if got is None or not got[1]:
                    continue
                cost, path, bridge = got
                wide = _moved(path, disc, meta) - shut
                if not wide or any(len(wide & k) / len(wide) >= ALIKE for k in kept):
                    continue
                larger = _moved(wide, grow, meta)
                kept.append(larger)
                length = (cost if cost > 0 else math.sqrt(x.d2)) * meta.res_max
                roi = math.sqrt(x.n1 * x.n2) / max(len(wide), 1e-6)
                rows.append((p1, p2, float(len(wide)), length, length, 0, roi, f"seed_{x.seed}", path, sorted(wide), sorted(larger), bridge))
                if len(kept) == KEEP:
                    break
        return pd.DataFrame(rows, columns=[k.strip().split()[0] for k in RASTER_CANDIDATES.split(", ")])

    # new names of the columns: both sides come from the seeds; a pair is few bytes and much work, so the
    # number of partitions is given, or few tasks would get them all
    wide = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lot = F.pmod(F.xxhash64("p1", "p2"), F.lit(max(wide, -(-n_pairs // TOGETHER)))).alias("lot")
    hints, sent = (df.select(*[F.col(k).alias(k) for k in df.columns]).select("*", lot).repartition(wide, "lot") for df in (hints, sent))
    found = hints.groupBy("lot").cogroup(sent.groupBy("lot")).applyInPandas(route, RASTER_CANDIDATES)
    held = materialize(found, "candidates")
    order = ["patch1", "patch2", "variant"]
    ids = running_total(held.select(*order, F.lit(1).cast("long").alias("_one")), order, "_one", "_id").drop("_one")
    return held.join(ids, order).withColumn("id", F.col("_id")).select(*held.columns)


def routing_graph(cells: DataFrame, meta: RasterMeta, connectivity: int = 8) -> DataFrame:
    """Directed edges (u, v, cost) between open cells (cell, r, c, bridge): 0 into a bridge cell, else 1 or the root of 2."""
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("dr"), F.lit(b).cast("long").alias("dc"), F.lit(math.sqrt(2) if a and b else 1.0).alias("w")) for a, b in moves(connectivity)])
    sent = cells.withColumn("_o", F.explode(steps)).select(F.col("cell").alias("u"), (F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"), F.col("_o.w").alias("w"))
    to = cells.select("r", "c", F.col("cell").alias("v"), "bridge")
    return sent.join(to, ["r", "c"]).select("u", "v", F.when(F.col("bridge"), 0.0).otherwise(F.col("w")).alias("cost"))


def route_between(edges: DataFrame, start: DataFrame, target: DataFrame, most: float | None = None) -> DataFrame:
    """The cheapest (start, target, cost) between two sets of cells, over edges(u, v, cost); none: no row."""
    paths = relax(start.select(F.col("cell").alias("src"), F.col("cell").alias("id"), F.lit(0.0).alias("dist")), edges, "cost", most)
    found = paths.join(target.select(F.col("cell").alias("id")), "id")
    return found.orderBy("dist", "src", "id").limit(1).select(F.col("src").alias("start"), F.col("id").alias("target"), F.col("dist").alias("cost"))
