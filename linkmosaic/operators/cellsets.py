"""Sets of raster cells: inflation, overlap, corridor and contiguity rasters, lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmosaic.operators.labels import label_patches
from linkmosaic.operators.masks import disc_offsets, shifted, square_offsets
from linkmosaic.sources.schema import RasterMeta


def inflate(cells: DataFrame, meta: RasterMeta, offsets: list[tuple[int, int]], free: DataFrame | None = None) -> DataFrame:
    """cells(cell, r, c[, id]) moved by all offsets: distinct (cell, r, c[, id]) inside the raster, and in `free` if given."""
    keys = [c for c in cells.columns if c not in ("cell", "r", "c")]
    out = shifted(cells, offsets, meta).select(*keys, F.col("target").alias("cell"), F.col("tr").alias("r"), F.col("tc").alias("c")).distinct()
    return out.join(free.select("cell"), "cell", "left_semi") if free is not None else out


def expand(cells: DataFrame, meta: RasterMeta, radius: int) -> DataFrame:
    """Square inflation by a radius of at least 1."""
    return inflate(cells, meta, square_offsets(max(1, int(radius))))


def overlap(a: Column, b: Column) -> Column:
    """Share of the cells of array a that array b has; an empty a has none."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_distinct(a))).otherwise(0.0)


def corridor_raster(corridors: DataFrame) -> DataFrame:
    """(buffered_cells, connected_size) -> cell, value: the largest size at each cell, 1 where it is unknown."""
    held = corridors.select(F.explode("buffered_cells").alias("cell"), F.coalesce(F.col("connected_size").cast("double"), F.lit(1.0)).alias("v"))
    return held.groupBy("cell").agg(F.max("v").alias("value"))


def segment_raster(pairs: DataFrame, meta: RasterMeta, width: int = 1) -> DataFrame:
    """(x1, y1, x2, y2) -> cells with value 1 along the segments, sampled by the cell's size, widened by a square."""
    x1, y1, x2, y2 = (F.col(k) for k in ("x1", "y1", "x2", "y2"))
    steps = F.greatest(F.ceil(F.sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2) / meta.res_max), F.lit(1)).cast("int")
    held = pairs.withColumn("_n", steps).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    x, y = x1 + (x2 - x1) * F.col("_i") / F.col("_n"), y1 + (y2 - y1) * F.col("_i") / F.col("_n")
    c = (F.floor((x - meta.xmin) / meta.res_x) + 1).cast("long")
    r = (F.lit(meta.nrow) - F.floor((y - meta.ymin) / meta.res_y)).cast("long")
    cells = held.select(r.alias("r"), c.alias("c")).filter(F.col("r").between(1, meta.nrow) & F.col("c").between(1, meta.ncol)).distinct()
    cells = cells.withColumn("cell", (F.col("r") - 1) * meta.ncol + F.col("c"))
    if width > 1:
        cells = expand(cells, meta, int(width) // 2)
    return cells.select("cell", F.lit(1.0).alias("value"))


def contiguous_raster(habitat: DataFrame, corridor: DataFrame, meta: RasterMeta, connectivity: int = 8) -> DataFrame:
    """Cells of habitat or corridor (cell, r, c each) with the number of cells of their component."""
    union = habitat.select("cell", "r", "c").unionByName(corridor.select("cell", "r", "c")).distinct()
    labels = label_patches(union, meta, connectivity)
    sizes = labels.groupBy("patch_id").agg(F.count("*").cast("double").alias("value"))
    return labels.join(sizes, "patch_id").select("cell", "r", "c", "value")


def line_cells(r1: int, c1: int, r2: int, c2: int) -> list[tuple[int, int]]:
    """Cells of the straight line between two cells, both included: one a step along its longer side."""
    n = max(abs(r2 - r1), abs(c2 - c1))
    if not n:
        return [(r1, c1)]
    t = np.arange(n + 1)
    # halves go towards the start, as an integer error term has it
    walk = lambda a, b: a + np.sign(b - a) * ((2 * abs(b - a) * t + n - 1) // (2 * n))
    return list(zip(walk(r1, r2).tolist(), walk(c1, c2).tolist(), strict=True))


def lines_to_cells(lines: DataFrame, meta: RasterMeta) -> DataFrame:
    """(id, r1, c1, r2, c2) -> (id, ord, cell)."""

    def run(batches):
        for b in batches:
            rows = [(i, k, (r - 1) * meta.ncol + c) for i, a, x, d, y in b[["id", "r1", "c1", "r2", "c2"]].itertuples(index=False) for k, (r, c) in enumerate(line_cells(a, x, d, y))]
            yield pd.DataFrame(rows, columns=["id", "ord", "cell"])

    return lines.mapInPandas(run, "id long, ord int, cell long")


def cells_to_line(cells: Column, meta: RasterMeta) -> Column:
    """Array of cells -> array of (x, y): repeats in a row are dropped; a single cell gets a second point 1e-9 away."""
    x = lambda k: meta.xmin + (((k - 1) % meta.ncol) + 0.5) * meta.res_x
    y = lambda k: meta.ymin + (meta.nrow - F.floor((k - 1) / meta.ncol) - 0.5) * meta.res_y
    kept = F.filter(cells, lambda k, i: (i == 0) | (k != F.get(cells, i - 1)))
    points = F.transform(kept, lambda k: F.array(x(k), y(k)))
    return F.when(F.size(kept) == 1, F.array(points[0], F.array(points[0][0] + 1e-9, points[0][1]))).otherwise(points)


def disc(cells: DataFrame, meta: RasterMeta, width: float, free: DataFrame | None = None) -> DataFrame:
    return inflate(cells, meta, disc_offsets(width), free)
