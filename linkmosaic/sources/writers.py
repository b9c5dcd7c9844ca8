"""What a run gives, written to a folder: Parquet for tables and rasters, CSV and text for people."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmosaic.sources.readers import to_wkb
from linkmosaic.sources.schema import Result


def _name(text: str, most: int = 64) -> str:
    return (re.sub(r"[^A-Za-z0-9_-]+", "_", text).strip("_") or "layer")[:most]


def flat(df: DataFrame) -> DataFrame:
    """Arrays as text, for CSV."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f.name) for f in df.schema])


def with_wkb(df: DataFrame, col: str = "geom") -> DataFrame:
    """The geometry as a list of WKB polygons, one a ring or part."""

    @F.pandas_udf("binary")
    def encode(s: pd.Series) -> pd.Series:
        return s.map(lambda g: None if g is None else to_wkb([[list(p) for p in r] for r in g]))

    return df.withColumn(col, encode(F.col(col)))


def _summary(result: Result, path: str, mode: str) -> None:
    rows = [(k, ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v)) for k, v in result.summary.items()]
    spark = next(iter(result.tables.values())).sparkSession
    spark.createDataFrame(rows, "item string, value string").coalesce(1).write.mode(mode).csv(path, header=True)


def _report(result: Result, path: str, mode: str) -> None:
    spark = next(iter(result.tables.values())).sparkSession
    spark.createDataFrame([(x,) for x in result.report], "value string").coalesce(1).write.mode(mode).text(path)


def write_raster_outputs(result: Result, folder: str, prefix: str = "mosaic", overwrite: bool = True, paths: dict | None = None) -> dict[str, str]:
    """Rasters (corridors, contiguous, patches) as Parquet of cells, tables as CSV, summary and metrics; -> name: path."""
    p, mode, given = _name(prefix), "overwrite" if overwrite else "errorifexists", paths or {}
    at = {
        "corridor_raster": f"corridors_{p}.cells", "contiguous_raster": f"contiguous_{p}.cells", "labels": f"patches_{p}.cells",
        "patches": f"patches_{p}.csv", "corridors": f"corridors_{p}.csv", "summary": f"raster_summary_{p}.csv", "metrics": f"landscape_metrics_{p}.txt",
    }
    out = {k: given.get(k, f"{folder}/{v}") for k, v in at.items()}
    for k in ("corridor_raster", "contiguous_raster", "labels"):
        result.tables[k].write.mode(mode).parquet(out[k])
    for k in ("patches", "corridors"):
        flat(result.tables[k]).write.mode(mode).csv(out[k], header=True)
    _summary(result, out["summary"], mode)
    _report(result, out["metrics"], mode)
    return out


def write_vector_outputs(result: Result, folder: str, prefix: str = "mosaic", overwrite: bool = True, paths: dict | None = None) -> dict[str, str]:
    """Layers corridors and networks as Parquet with WKB, summary and metrics; -> name: path."""
    p, mode, given = _name(prefix), "overwrite" if overwrite else "errorifexists", paths or {}
    at = {"corridors": f"vector_{p}/corridors", "networks": f"vector_{p}/networks", "summary": f"vector_summary_{p}.csv", "metrics": f"landscape_metrics_{p}.txt"}
    out = {k: given.get(k, f"{folder}/{v}") for k, v in at.items()}
    for k in ("corridors", "networks"):
        with_wkb(result.tables[k]).write.mode(mode).parquet(out[k])
    _summary(result, out["summary"], mode)
    _report(result, out["metrics"], mode)
    return out
