"""Contiguous patches of a mask, their summaries, and dense numbers for keys."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmosaic.operators.components import SMALL, connected_components, merge_pairs
from linkmosaic.sources.schema import RasterMeta
from linkmosaic.sources.shared import materialize

TILE = 512


def dense_numbers(keys: DataFrame, key: str, name: str, buckets: int = 4096) -> DataFrame:
    """distinct long keys -> key and its rank from 1, without a window over all rows.

    Keys are cut into equal ranges; the only window without partitions sees one row a range.
    """
    span = keys.agg(F.min(key), F.max(key)).first()
    if span[0] is None:
        return keys.select(key, F.lit(0).cast("long").alias(name)).limit(0)
    width = max(1, -(-(span[1] - span[0] + 1) // buckets))
    held = keys.withColumn("_b", F.floor((F.col(key) - span[0]) / width).cast("long"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("_b").count().select("_b", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(key))
    return held.withColumn("_i", inside).join(offsets, "_b").select(key, (F.col("_off") + F.col("_i")).cast("long").alias(name))


def label_patches(cells: DataFrame, meta: RasterMeta, connectivity: int = 8, tile: int = TILE) -> DataFrame:
    """cells(cell, r, c) of a mask -> with patch_id, numbered from 1 by the smallest cell.

    Tiles are labelled each in one task; then pairs of touching cells across tile borders merge the tiles'
    labels.  So the loop over components sees borders only, and none of it where one tile holds all.
    Any connectivity but 8 is 4.
    """
    held = cells.select("cell", "r", "c").withColumn("_tr", F.floor((F.col("r") - 1) / tile)).withColumn("_tc", F.floor((F.col("c") - 1) / tile))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 8 else [])

    def within(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("cell")
        r, c = g["r"].to_numpy() - g["r"].min(), g["c"].to_numpy() - g["c"].min()
        at = np.full((r.max() + 3, c.max() + 3), -1)
        at[r + 1, c + 1] = np.arange(len(g))
        a, b = [], []
        for dr, dc in steps:
            other = at[r + 1 + dr, c + 1 + dc]
            ok = other >= 0
            a.append(np.flatnonzero(ok))
            b.append(other[ok])
        label = merge_pairs(len(g), np.concatenate(a), np.concatenate(b))
        return pd.DataFrame({"cell": g["cell"], "r": g["r"], "c": g["c"], "part": g["cell"].to_numpy()[label]})

    # borders, numbers and the result all read the tiles' labels: they are made once
    parts = materialize(held.groupBy("_tr", "_tc").applyInPandas(within, "cell long, r long, c long, part long"), "tiles")
    if meta.nrow > tile or meta.ncol > tile:
        rim = lambda x: ((F.col(x) - 1) % tile).isin(0, tile - 1)
        edge = parts.filter(rim("r") | rim("c"))
        shift = F.array(*[F.struct(F.lit(a).cast("long").alias("dr"), F.lit(b).cast("long").alias("dc")) for a, b in steps])
        moved = edge.withColumn("_o", F.explode(shift)).select((F.col("r") + F.col("_o.dr")).alias("r"), (F.col("c") + F.col("_o.dc")).alias("c"), F.col("part").alias("u"))
        pairs = moved.join(edge.select("r", "c", F.col("part").alias("v")), ["r", "c"]).filter("u <> v").select("u", "v")
        roots = connected_components(pairs, small=SMALL)
        parts = parts.join(roots.withColumnRenamed("id", "part"), "part", "left").withColumn("part", F.coalesce("component", "part")).drop("component")
    ids = dense_numbers(parts.select("part").distinct(), "part", "patch_id")
    return parts.join(ids, "part").select("cell", "r", "c", "patch_id")


def patch_summary(labels: DataFrame, meta: RasterMeta) -> DataFrame:
    """patch_id, cell_count, area, x, y: the mean of the cells' centres."""
    x = meta.xmin + (F.col("c") - 0.5) * meta.res_x
    y = meta.ymin + (F.lit(meta.nrow) - F.col("r") + 0.5) * meta.res_y
    held = labels.filter(F.col("patch_id").isNotNull() & (F.col("patch_id") != 0))
    out = held.groupBy("patch_id").agg(F.count("*").alias("cell_count"), F.avg(x).alias("x"), F.avg(y).alias("y"))
    return out.select("patch_id", "cell_count", (F.col("cell_count") * meta.cell_area).alias("area"), "x", "y")


def min_size(labels: DataFrame, cells: int) -> DataFrame:
    """Labels of patches of at least so many cells; the numbers keep their gaps."""
    large = labels.groupBy("patch_id").count().filter(F.col("count") >= cells).select("patch_id")
    return labels.join(large, "patch_id", "left_semi").select(*labels.columns)


def size_quantiles(patches: DataFrame, at: tuple = (0.0, 0.5, 0.9, 0.99)) -> DataFrame:
    return patches.agg(*[F.percentile("cell_count", F.lit(q)).alias(f"q{int(q * 100)}") for q in at])
