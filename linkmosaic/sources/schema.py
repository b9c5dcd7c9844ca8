"""Schemas and metadata of rasters, patches, corridors and results."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

CELLS = "cell long, r long, c long, value double"
PATCHES = "patch_id long, cell_count long, area double, x double, y double"
RASTER_CANDIDATES = (
    "patch1 long, patch2 long, cost double, distance_map double, length double, id long, roi double, variant string, "
    "path_cells array<long>, buffered_cells array<long>, buffered_cells_expanded array<long>, habitat_cells array<long>"
)
VECTOR_CANDIDATES = (
    "patch1 long, patch2 long, cost double, length double, area double, id long, roi double, distance_m double, "
    "patch_ids array<long>, is_connected boolean, line array<array<double>>, corridor array<array<array<double>>>"
)
POLYGONS = "id long, geom array<array<array<double>>>"  # rings of one part: the outer one first


@dataclass(frozen=True)
class RasterMeta:
    """Extent of a raster whose cells are numbered from 1, row by row from the top."""

    nrow: int
    ncol: int
    xmin: float = 0.0
    ymin: float = 0.0
    res_x: float = 1.0
    res_y: float = 1.0
    crs: int | None = None  # EPSG code

    @property
    def res_mean(self) -> float:
        return (self.res_x + self.res_y) / 2

    @property
    def res_max(self) -> float:
        return max(self.res_x, self.res_y)

    @property
    def cell_area(self) -> float:
        return abs(self.res_x * self.res_y)


@dataclass
class Patch:
    id: int
    weight: float
    geometry: object = None


@dataclass
class Candidate:
    patch_ids: list[int]
    cost: float
    weight: float
    geometry: object = None


@dataclass
class Result:
    """What a run gives: tables as DataFrames, a one-row summary, report lines, warnings and diagnostics."""

    mode: str
    inputs: dict
    tables: dict[str, DataFrame]
    summary: dict
    report: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    diagnostics: dict = field(default_factory=dict)
    run_stats: dict = field(default_factory=dict)

    def __repr__(self) -> str:
        lines = [f"<{self.mode} result>", *(f"  {k}: {v}" for k, v in self.summary.items())]
        return "\n".join(lines + [f"  warning: {w}" for w in self.warnings])

    def describe(self) -> str:
        return "\n".join([repr(self), "", *self.report])
