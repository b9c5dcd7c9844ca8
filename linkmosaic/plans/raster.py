"""From a raster to corridors: masks, patches, candidates, choice, widening, rasters and report."""

from __future__ import annotations

import time
import warnings as py_warnings
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmosaic.errors import ComputeLimitError, InputError, ScaleError
from linkmosaic.functions.units import to_pixels
from linkmosaic.operators import cellsets, graph, labels, landscape, masks, pairs, routing, selection
from linkmosaic.sources.schema import RasterMeta, Result
from linkmosaic.sources.shared import materialize

#: Fixed limits of the preflight.
MOST_CELLS = 40_000_000
FINE_RES = 10.0
FINE_CELLS = 2_000_000


def preflight(meta: RasterMeta, allow_large: bool = False) -> list[str]:
    """Refuses rasters beyond the limits unless they are allowed; gives warnings for fine ones."""
    n = meta.nrow * meta.ncol
    if n >= MOST_CELLS and not allow_large:
        raise ComputeLimitError(f"{n:,} cells; allow_large lifts the limit of {MOST_CELLS:,}")
    if meta.crs is not None and meta.res_max < FINE_RES:
        if n >= FINE_CELLS and not allow_large:
            raise ComputeLimitError(f"{n:,} cells of {meta.res_max:g} map units; allow_large lifts the limit of {FINE_CELLS:,}")
        return [f"cells of {meta.res_max:g} map units are fine for a search of corridors"]
    return []


SLIM = ("id", "patch1", "patch2", "cost", "length", "roi")


def _choose(rows: list[dict], weights: dict, budget: float, shared: dict) -> tuple[list[tuple[int, str]], float]:
    """(id, kind) of the greedy choice and of what the leftover budget buys, and what they cost, in one task."""
    alike = lambda a, b: shared.get((a["id"], b["id"]), 0.0)
    picks, stats = selection.circuit_utility(rows, weights, budget, overlap=alike, far_enough=lambda c, chosen: False)
    added, more = selection.spend_leftover(rows, picks, weights, budget - stats["budget_used"])
    picks = [(p["id"], p["kind"]) for p in picks]
    if added:
        order = {c["id"]: i for i, c in enumerate(rows)}
        picks = sorted([*picks, *((c["id"], "leftover") for c in added)], key=lambda p: order[p[0]])
    return picks, stats["budget_used"] + more["budget_used"]


def greedy(candidates: DataFrame, weights: DataFrame, budget: float) -> DataFrame:
    """(id, ord, kind, spent) of the candidates chosen.

    The task that chooses gets a few numbers a candidate; how far two corridors of a pair of patches
    overlap is found before, beside their cells.
    """
    a, b = (candidates.select("patch1", "patch2", F.col("id").alias(f"id_{k}"), F.col(cells).alias(f"cells_{k}")) for k, cells in (("a", "buffered_cells"), ("b", "buffered_cells_expanded")))
    both = a.join(b, ["patch1", "patch2"]).filter("id_a <> id_b")
    shares = both.select("id_a", "id_b", cellsets.overlap(F.col("cells_a"), F.col("cells_b")).alias("share")).filter("share > 0")
    pack = candidates.agg(F.array_sort(F.collect_list(F.struct(*SLIM))).alias("c"))
    sizes = weights.agg(F.array_sort(F.collect_list(F.struct("patch_id", "weight"))).alias("w"))
    alike = shares.agg(F.collect_list(F.struct("id_a", "id_b", "share")).alias("s"))

    def run(batches):
        for batch in batches:
            for c, w, s in batch[["c", "w", "s"]].itertuples(index=False):
                rows = [{**{k: x[k] for k in SLIM}, "patch_ids": [x["patch1"], x["patch2"]]} for x in c]
                picks, spent = _choose(rows, {x["patch_id"]: x["weight"] for x in w}, budget, {(x["id_a"], x["id_b"]): x["share"] for x in s})
                yield pd.DataFrame([(i, n, kind, spent) for n, (i, kind) in enumerate(picks)], columns=["id", "ord", "kind", "spent"])

    return pack.crossJoin(sizes).crossJoin(alike).mapInPandas(run, "id long, ord int, kind string, spent double")


@dataclass
class Found:
    """What the search for candidates gives: tables, numbers in cells, counts and warnings."""

    px: dict
    notes: list[str]
    marked: DataFrame
    kept: DataFrame
    cells: DataFrame
    patches: DataFrame
    candidates: DataFrame
    raw: int
    n: int


def search_corridors(
    cells: DataFrame,
    meta: RasterMeta,
    patch_values: Sequence[float] = (),
    budget: float | None = None,
    patch_ranges: Sequence[Sequence[float]] = (),
    units: str = "pixels",
    min_patch_size: float = 10,
    min_corridor_width: float = 1,
    max_search_distance: float = 50,
    obstacle_values: Sequence[float] = (),
    obstacle_ranges: Sequence[Sequence[float]] = (),
    allow_bottlenecks: bool = False,
    patch_connectivity: int = 8,
    max_pair_checks: int = 2_000_000,
    allow_large: bool = False,
    compat: bool = True,
) -> Found:
    """Patches of cells(cell, r, c, value) and the candidate corridors between them.

    max_pair_checks bounds the pairs of patches that are looked at: those with boundary cells within the
    search distance, which the bins find without a look at the others.
    """
    notes = preflight(meta, allow_large)
    if budget is None or budget <= 0:
        raise InputError("a budget above 0 is needed")
    if max_search_distance <= 0:
        raise InputError("a search distance above 0 is needed")
    habitat = masks.in_values_or_ranges("value", patch_values, patch_ranges)
    if habitat is None:
        raise InputError("patch values or ranges are needed")
    obstacle = masks.in_values_or_ranges("value", obstacle_values, obstacle_ranges)
    obstacle = F.lit(False) if obstacle is None else obstacle
    px = to_pixels(meta, units, budget, min_patch_size, min_corridor_width, max_search_distance)
    marked = cells.select("cell", "r", "c", obstacle.alias("obstacle"), (habitat & ~obstacle).alias("habitat"))
    found = materialize(labels.label_patches(marked.filter("habitat"), meta, patch_connectivity), "labels")
    kept = labels.min_size(found, max(1, round(px["min_patch"])))
    raw = found.select("patch_id").distinct().count()
    patches = materialize(labels.patch_summary(kept, meta), "patches")
    all_cells = marked.join(kept.select("cell", "patch_id"), "cell", "left").fillna(0, ["patch_id"])
    all_cells = all_cells.withColumn("passable", ~F.col("obstacle") & (F.col("patch_id") == 0))
    if not allow_bottlenecks and px["width"] > 1:
        all_cells = masks.clearance(all_cells, meta, px["width"])
    all_cells = materialize(all_cells, "cells")
    ways = routing.raster_candidates(all_cells, patches, meta, px["search"], px["width"], 4 if patch_connectivity != 8 else 8, compat, max_pair_checks)
    return Found(px, notes, marked, kept, all_cells, patches, materialize(ways, "candidates"), raw, patches.count())


def find_corridors(
    cells: DataFrame,
    meta: RasterMeta,
    patch_values: Sequence[float] = (),
    budget: float | None = None,
    patch_ranges: Sequence[Sequence[float]] = (),
    units: str = "pixels",
    strategy: str = "circuit_utility",
    min_patch_size: float = 10,
    min_corridor_width: float = 1,
    max_search_distance: float = 50,
    obstacle_values: Sequence[float] = (),
    obstacle_ranges: Sequence[Sequence[float]] = (),
    allow_bottlenecks: bool = False,
    patch_connectivity: int = 8,
    max_pair_checks: int = 2_000_000,
    max_candidates: int = 200_000,
    allow_large: bool = False,
    budget_pixels: float | None = None,
    compat: bool = True,
    thicken: bool = True,
) -> Result:
    """cells(cell, r, c, value) -> Result with tables cells, patches, candidates, corridors, corridor_raster, contiguous_raster, report.

    The choice is sequential by nature and runs in one task, on at most max_candidates candidates; all the
    rest is distributed over cells, patches and pairs.
    """
    began = time.monotonic()
    if budget_pixels is not None:
        if units != "pixels":
            raise ScaleError("budget_pixels goes with pixels as units")
        budget = budget_pixels
    found = search_corridors(cells, meta, patch_values, budget, patch_ranges, units, min_patch_size, min_corridor_width, max_search_distance, obstacle_values, obstacle_ranges, allow_bottlenecks, patch_connectivity, max_pair_checks, allow_large, compat)
    px, notes, marked, kept, all_cells, patches, candidates = found.px, found.notes, found.marked, found.kept, found.cells, found.patches, found.candidates
    raw, n = found.raw, found.n
    possible = n * (n - 1) // 2
    n_candidates = candidates.count()
    pairs.guard_count(n_candidates, max_candidates, "candidate corridors")
    weights = patches.select("patch_id", F.col("cell_count").cast("double").alias("weight"))
    spent = 0.0
    if strategy == "largest_network":
        edges = candidates.select(F.col("patch1").alias("u"), F.col("patch2").alias("v"), "id", "cost")
        chosen = selection.largest_network(weights.withColumnRenamed("patch_id", "id"), edges, px["budget"])
        selected = candidates.join(chosen["selected"].select("id"), "id", "left_semi").withColumn("thicken_factor", F.lit(1))
        spent = float(chosen["totals"].first()["total_cost"])
    elif strategy in ("circuit_utility", "most_connectivity"):
        picked = materialize(greedy(candidates, weights, px["budget"]), "picked")
        first = picked.select("spent").limit(1).collect()
        spent = first[0][0] if first else 0.0
        selected = materialize(candidates.join(picked.drop("spent"), "id").withColumn("thicken_factor", F.lit(1)).select(*candidates.columns, "thicken_factor", "ord", "kind"), "picked")
        if thicken:
            main = weights.agg(F.min_by("patch_id", F.struct(-F.col("weight"), "patch_id"))).first()[0]
            columns = selected.columns
            selected, extra = selection.thicken(selected.drop("thicken_factor"), all_cells, px["budget"] - spent, px["width"], main, meta)
            selected, spent = selected.select(*columns), spent + extra
    else:
        raise InputError(f"unknown strategy {strategy!r}")
    selected = materialize(graph.connected_sizes(selected, patches), "selected")
    used = selected.count()
    ways = cellsets.corridor_raster(selected)
    placed = ways.withColumns({"r": (F.floor((F.col("cell") - 1) / meta.ncol) + 1).cast("long"), "c": ((F.col("cell") - 1) % meta.ncol + 1).cast("long")})
    joined = cellsets.contiguous_raster(kept, placed, meta, 8)
    post = kept.select("cell", "r", "c").unionByName(placed.select("cell", "r", "c")).distinct()
    report = materialize(landscape.report_rows(kept, post, meta, units), "report")
    if not used:
        notes.append("no corridor was chosen")
    for text in notes:
        py_warnings.warn(text, stacklevel=2)
    totals = marked.agg(F.count(F.when(F.col("habitat"), 1)), F.count(F.when(F.col("obstacle"), 1))).first()
    n_pairs = candidates.select("patch1", "patch2").distinct().count()
    summary = {
        "budget_total": budget, "budget_used": spent, "budget_used_units": spent * budget / px["budget"], "corridors_used": used,
        "candidate_edges": n_candidates, "candidate_pairs": n_pairs, "possible_pairs": possible, "patches": n, "raw_patches": raw, "filtered_out": raw - n,
        "patch_values": list(patch_values), "patch_ranges": [list(x) for x in patch_ranges], "obstacle_values": list(obstacle_values), "obstacle_ranges": [list(x) for x in obstacle_ranges],
        "patch_value_cells": totals[0], "obstacle_cells": totals[1], "min_patch_size": min_patch_size, "min_corridor_width": min_corridor_width,
        "max_search_distance": max_search_distance, "patch_connectivity": patch_connectivity, "units": units,
    }
    tables = {"labels": kept, "patches": patches, "candidates": candidates, "corridors": selected, "corridor_raster": ways, "contiguous_raster": joined, "report": report}
    inputs = {"units": units, "pixel_size": meta.res_mean, "pixel_area": meta.cell_area, "raster_cells": meta.nrow * meta.ncol, "budget": budget}
    return Result("raster", inputs, tables, summary, landscape.report_lines(report), notes, {}, {"elapsed_s": time.monotonic() - began, "candidate_edges": n_candidates, "candidate_pairs": n_pairs, "possible_pairs": possible})


def diagnose_connectivity(cells: DataFrame, meta: RasterMeta, patch_values: Sequence[float], least: int) -> dict:
    """Patches and patches of `least` cells or more by 4 and by 8 neighbours, and which of the two keeps some."""
    hab = cells.filter(masks.in_values("value", patch_values))
    out: dict = {}
    for k in (4, 8):
        sizes = labels.label_patches(hab, meta, k).groupBy("patch_id").count()
        total, kept = sizes.agg(F.count("*"), F.count(F.when(F.col("count") >= least, 1))).first()
        out[k] = {"patches": total, "kept": kept}
    out["use"] = 8 if out[4]["kept"] < 2 <= out[8]["kept"] else 4
    return out
