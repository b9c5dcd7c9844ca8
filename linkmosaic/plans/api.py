"""One door to the pipelines."""

from __future__ import annotations

import os

from linkmosaic.errors import InputError
from linkmosaic.operators.selection import NetworkOptimizer, engine, optimize_largest_network, optimize_network
from linkmosaic.plans import raster, vector
from linkmosaic.sources.schema import Result
from linkmosaic.sources.writers import write_raster_outputs, write_vector_outputs

__all__ = ["NetworkOptimizer", "engine", "examples", "optimize_largest_network", "optimize_network", "run", "run_raster", "run_vector"]


def run_raster(cells, meta, *args, output_dir: str | None = None, output_prefix: str = "mosaic", **options) -> Result:
    result = raster.find_corridors(cells, meta, *args, **options)
    if output_dir:
        result.diagnostics["paths"] = write_raster_outputs(result, output_dir, output_prefix)
    return result


def run_vector(shapes, *args, output_dir: str | None = None, output_prefix: str = "mosaic", **options) -> Result:
    result = vector.find_corridors(shapes, *args, **options)
    if output_dir:
        result.diagnostics["paths"] = write_vector_outputs(result, output_dir, output_prefix)
    return result


def run(mode: str, *args, **options) -> Result:
    """Dispatch by mode: raster or vector."""
    if mode not in ("raster", "vector"):
        raise InputError(f"unknown mode {mode!r}")
    return (run_raster if mode == "raster" else run_vector)(*args, **options)


def examples(kind: str | None = None) -> list[str]:
    """Paths of the example scripts, those whose name holds `kind` if it is given."""
    folder = os.path.join(os.path.dirname(os.path.dirname(__file__)), "examples")
    names = sorted(x for x in os.listdir(folder) if x.endswith(".py")) if os.path.isdir(folder) else []
    return [os.path.join(folder, x) for x in names if kind is None or kind in x]
