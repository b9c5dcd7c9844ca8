"""Pairs of things near each other: binned range joins, boundaries, and seeds between patches."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmosaic.errors import ComputeLimitError
from linkmosaic.operators.masks import shifted
from linkmosaic.sources.schema import RasterMeta


def bin_join(points: DataFrame, most: float, id_col: str = "id", x: str = "x", y: str = "y") -> DataFrame:
    """(i, j, dist) for i < j at distance of most or less.

    A grid with bins of the distance turns the range join into an equi-join: the left side meets the bins
    around its own.  A crowded bin is a hot key; AQE splits it, since the join is an ordinary one.
    """
    if not most or most <= 0:
        return points.select(F.col(id_col).alias("i"), F.col(id_col).alias("j"), F.lit(0.0).alias("dist")).limit(0)
    base = points.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    base = base.withColumn("bx", F.floor(F.col("x") / most)).withColumn("by", F.floor(F.col("y") / most))
    around = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = base.withColumn("_o", F.explode(around)).select(
        F.col("id").alias("i"), F.col("x").alias("x1"), F.col("y").alias("y1"), (F.col("bx") + F.col("_o.dx")).alias("bx"), (F.col("by") + F.col("_o.dy")).alias("by")
    )
    right = base.select(F.col("id").alias("j"), F.col("x").alias("x2"), F.col("y").alias("y2"), "bx", "by")
    d = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    return left.join(right, ["bx", "by"]).filter("i < j").withColumn("dist", d).filter(F.col("dist") <= most).select("i", "j", "dist")


def centroid_candidates(patches: DataFrame, most: float, meta: RasterMeta) -> DataFrame:
    """Pairs of patches by the distance of their centroids in cells: patch1, patch2, cost, distance, id.

    Ids run from 1 in the order of (patch1, patch2): ranks inside patch1, shifted by the counts before.
    """
    near = bin_join(patches, most * meta.res_max, "patch_id").select(F.col("i").alias("patch1"), F.col("j").alias("patch2"), (F.col("dist") / meta.res_max).alias("cost"))
    counts = near.groupBy("patch1").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("patch1").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("patch1", before.alias("_off"))
    inside = F.row_number().over(Window.partitionBy("patch1").orderBy("patch2"))
    return near.join(offsets, "patch1").select("patch1", "patch2", "cost", F.col("cost").alias("distance"), (F.col("_off") + inside).cast("long").alias("id"))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("_", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def cell_of(r: Column, c: Column, ncol: int) -> Column:
    return (r - 1) * ncol + c


def row_col_of(cell: Column, ncol: int) -> tuple[Column, Column]:
    return (F.floor((cell - 1) / ncol) + 1).cast("long"), ((cell - 1) % ncol + 1).cast("long")


def moves(connectivity: int) -> list[tuple[int, int]]:
    straight = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    return straight + [(-1, -1), (-1, 1), (1, -1), (1, 1)] if connectivity == 8 else straight


def boundary_cells(labels: DataFrame, meta: RasterMeta, connectivity: int = 4) -> DataFrame:
    """Cells of a patch with a neighbour outside it; beyond the raster is outside."""
    near = moves(connectivity)
    sent = shifted(labels.select("cell", "r", "c", "patch_id"), near, meta).select(F.col("target"), F.col("patch_id").alias("p"))
    same = sent.groupBy("target", "p").agg(F.count("*").alias("same"))
    joined = labels.join(same, (F.col("cell") == F.col("target")) & (F.col("patch_id") == F.col("p")), "left")
    return joined.filter(F.coalesce("same", F.lit(0)) < len(near)).select("cell", "r", "c", "patch_id")


def block_subsample(boundary: DataFrame, block: int = 2, most: int = 2000) -> DataFrame:
    """Of each patch's boundary the first cell of each block of cells, by columns; then every k-th, `most` at last."""
    first = Window.partitionBy("patch_id", F.floor((F.col("r") - 1) / block), F.floor((F.col("c") - 1) / block)).orderBy("c", "r")
    held = boundary.withColumn("_f", F.row_number().over(first)).filter("_f = 1").drop("_f")
    inside = Window.partitionBy("patch_id")
    held = held.withColumn("_i", F.row_number().over(inside.orderBy("c", "r")) - 1).withColumn("_n", F.count("*").over(inside))
    stride = F.greatest(F.floor(F.col("_n") / most), F.lit(1))
    kept = held.filter((F.col("_n") <= most) | ((F.col("_i") % stride == 0) & (F.col("_i") / stride < most)))
    return kept.select("cell", "r", "c", "patch_id")


def boundary_pairs(sampled: DataFrame, most: float, compat: bool = True) -> DataFrame:
    """Pairs of sampled boundary cells of two patches within `most` cells: p1 < p2, places, d2.

    With compat the bins are those of the definition, 8 to 64 cells wide, of which only the neighbours are
    searched: farther pairs are found only as far as these reach.  Without it, the bins have the distance.
    """
    far = max(1, round(most))
    size = min(max(far, 8), 64) if compat else far
    held = sampled.select("patch_id", "r", "c", F.floor((F.col("r") - 1) / size).alias("br"), F.floor((F.col("c") - 1) / size).alias("bc"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    left = held.withColumn("_o", F.explode(around)).select(
        F.col("patch_id").alias("p1"), F.col("r").alias("r1"), F.col("c").alias("c1"), (F.col("br") + F.col("_o.a")).alias("br"), (F.col("bc") + F.col("_o.b")).alias("bc")
    )
    right = held.select(F.col("patch_id").alias("p2"), F.col("r").alias("r2"), F.col("c").alias("c2"), "br", "bc")
    d2 = (F.col("r1") - F.col("r2")) ** 2 + (F.col("c1") - F.col("c2")) ** 2
    return left.join(right, ["br", "bc"]).filter("p1 < p2").withColumn("d2", d2.cast("long")).filter(F.col("d2") <= far * far).select("p1", "p2", "r1", "c1", "r2", "c2", "d2")


def pair_seeds(pairs: DataFrame, width: float, most_seeds: int = 8, nearest: int = 200) -> DataFrame:
    """Up to most_seeds pairs of places for each pair of patches, nearest first, with both ends apart from those before."""
    order = Window.partitionBy("p1", "p2").orderBy("d2", "r1", "c1", "r2", "c2")
    close = pairs.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= nearest)
    apart = max(4, math.ceil(1.5 * width))
    ranked = close.groupBy("p1", "p2").agg(F.array_sort(F.collect_list(F.struct("d2", "r1", "c1", "r2", "c2"))).alias("s"))
    gap = lambda x, k, r, c: F.greatest(F.abs(x[r] - k[r]), F.abs(x[c] - k[c]))
    crowds = lambda x: lambda k: (gap(x, k, "r1", "c1") <= apart) | (gap(x, k, "r2", "c2") <= apart)
    take = lambda kept, x: F.when((F.size(kept) < most_seeds) & ~F.exists(kept, crowds(x)), F.concat(kept, F.array(x))).otherwise(kept)
    diverse = ranked.select("p1", "p2", F.posexplode(F.aggregate("s", F.slice("s", 1, 0), take)).alias("_i", "x"))
    return diverse.select("p1", "p2", *[f"x.{k}" for k in ("r1", "c1", "r2", "c2", "d2")], (F.col("_i") + 1).alias("seed"))


def start_positions(cells: DataFrame, meta: RasterMeta, connectivity: int = 4) -> DataFrame:
    """Free cells beside a patch, each given to the patch of its first neighbour in the order of moves.

    cells: cell, r, c, patch_id (null: none), habitat, obstacle, passable.
    """
    near = moves(connectivity)
    steps = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(a).cast("long").alias("dr"), F.lit(b).cast("long").alias("dc")) for i, (a, b) in enumerate(near)])
    free = cells.filter(~F.col("habitat") & ~F.col("obstacle") & F.col("passable")).select("cell", "r", "c")
    # a free cell's neighbour by move k is the patch cell that reaches it by the opposite step
    sent = cells.filter(F.col("patch_id").isNotNull() & (F.col("patch_id") != 0)).withColumn("_o", F.explode(steps))
    sent = sent.select((F.col("r") - F.col("_o.dr")).alias("r"), (F.col("c") - F.col("_o.dc")).alias("c"), "patch_id", F.col("_o.k").alias("k"))
    sent = sent.filter(F.col("r").between(1, meta.nrow) & F.col("c").between(1, meta.ncol))
    return free.join(sent, ["r", "c"]).groupBy("cell", "r", "c").agg(F.min_by("patch_id", "k").alias("patch_id"))


def starts_near(starts: DataFrame, r: int, c: int, radius: int) -> DataFrame:
    return starts.filter(F.greatest(F.abs(F.col("r") - r), F.abs(F.col("c") - c)) <= radius)


def nearest_passable(cells: DataFrame, r: int, c: int, radius: int = 6) -> DataFrame:
    """The free cell in the smallest square ring around a place, then nearest, then by column and row."""
    ring = F.greatest(F.abs(F.col("r") - r), F.abs(F.col("c") - c))
    d2 = (F.col("r") - r) ** 2 + (F.col("c") - c) ** 2
    return cells.filter(F.col("passable") & (ring <= radius)).orderBy(ring, d2, "c", "r").limit(1).select("cell", "r", "c")


def guard_count(count: int, most: int, what: str) -> None:
    """Refuses counts above a limit."""
    if count > most:
        raise ComputeLimitError(f"{count:,} {what}; the limit is {most:,}")
