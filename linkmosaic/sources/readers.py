"""Rasters and polygon layers from files."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmosaic.errors import InputError
from linkmosaic.sources.schema import RasterMeta

POLY = "array<array<array<double>>>"


def read_raster(spark: SparkSession, path: str, meta: RasterMeta | None = None) -> tuple[DataFrame, RasterMeta]:
    """Cells (cell, r, c, value) of a Parquet table of them, or of an ASCII grid (.asc), whose head gives the extent."""
    if path.endswith(".asc"):
        return _ascii_grid(spark, path)
    cells = spark.read.parquet(path)
    if not {"cell", "r", "c", "value"} <= set(cells.columns):
        raise InputError("a raster table has the columns cell, r, c, value")
    if meta is None:
        top = cells.agg(F.max("r"), F.max("c")).first()
        meta = RasterMeta(int(top[0] or 0), int(top[1] or 0))
    return cells.select("cell", "r", "c", F.col("value").cast("double").alias("value")), meta


def _ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, RasterMeta]:
    head = {}
    for (line,) in spark.read.text(path).limit(6).collect():
        parts = line.split()
        if len(parts) == 2 and re.match("[a-zA-Z]", parts[0]):
            head[parts[0].lower()] = float(parts[1])
    if not {"ncols", "nrows", "cellsize"} <= set(head):
        raise InputError("the grid's head lacks ncols, nrows or cellsize")
    half = head["cellsize"] / 2
    x = head.get("xllcorner", head.get("xllcenter", half) - half)
    y = head.get("yllcorner", head.get("yllcenter", half) - half)
    meta = RasterMeta(int(head["nrows"]), int(head["ncols"]), x, y, head["cellsize"], head["cellsize"])
    whole = spark.read.text(path, wholetext=True)
    body = F.filter(F.split("value", r"\r?\n"), lambda s: s.rlike(r"^\s*[-+0-9.]") & ~s.rlike("^[a-zA-Z]"))
    rows = whole.select(F.posexplode(body).alias("_r", "line"))
    cells = rows.select((F.col("_r") + 1).cast("long").alias("r"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("_c", "v"))
    value = F.col("v").cast("double")
    if "nodata_value" in head:
        value = F.when(value != head["nodata_value"], value)
    c = (F.col("_c") + 1).cast("long")
    return cells.select(((F.col("r") - 1) * meta.ncol + c).alias("cell"), "r", c.alias("c"), value.alias("value")), meta


def parse_wkt(text: str) -> list[list]:
    """Rings of each polygon of a POLYGON or MULTIPOLYGON text."""
    m = re.match(r"\s*(?:SRID=\d+;)?\s*(MULTI)?POLYGON\s*(?:Z|M|ZM)?\s*(EMPTY|\(.*\))\s*$", text, re.I | re.S)
    if not m:
        raise InputError("only POLYGON and MULTIPOLYGON can be read")
    if m[2].upper() == "EMPTY":
        return []
    body = re.sub(r"([-+0-9.eE]+(?:\s+[-+0-9.eE]+)+)", lambda p: "[" + ",".join(p[1].split()[:2]) + "]", m[2])
    nested = json.loads(body.replace("(", "[").replace(")", "]"))
    return nested if m[1] else [nested]


def parse_wkb(data: bytes) -> list[list]:
    at = 0

    def take(fmt: str, order: str):
        nonlocal at
        got = struct.unpack_from(order + fmt, data, at)
        at += struct.calcsize(order + fmt)
        return got

    def one() -> list[list]:
        nonlocal at
        order = "<" if data[at] else ">"
        at += 1
        (kind,) = take("I", order)
        if kind & 0x20000000:
            take("I", order)
            kind &= ~0x20000000
        (n,) = take("I", order)
        if kind == 6:
            return [p for _ in range(n) for p in one()]
        if kind != 3:
            raise InputError("only polygons can be read")
        rings = []
        for _ in range(n):
            (k,) = take("I", order)
            flat = take(f"{2 * k}d", order)
            rings.append([list(p) for p in zip(flat[::2], flat[1::2], strict=True)])
        return [rings]

    return one()


def to_wkb(rings: list) -> bytes:
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for ring in rings:
        out.append(struct.pack("<I", len(ring)))
        out += [struct.pack("<2d", float(p[0]), float(p[1])) for p in ring]
    return b"".join(out)


def _geojson(text: str) -> Iterator[list[list]]:
    top = json.loads(text)
    for f in top["features"] if top.get("type") == "FeatureCollection" else [top]:
        geom = f.get("geometry") or f
        if geom["type"] == "Polygon":
            yield [geom["coordinates"]]
        elif geom["type"] == "MultiPolygon":
            yield geom["coordinates"]
        else:
            raise InputError("only polygons can be read")


def polygons(df: DataFrame, col: str, id_col: str = "id", form: str = "wkt") -> DataFrame:
    """(id, geom) of a column of WKT or WKB; each part of a multipolygon is a row with the same id."""
    parse = {"wkt": parse_wkt, "wkb": lambda b: parse_wkb(bytes(b))}[form]

    def run(batches):
        for b in batches:
            rows = [(i, [[list(map(float, p[:2])) for p in r] for r in part]) for i, x in zip(b["id"], b["g"], strict=True) if x is not None for part in parse(x)]
            yield pd.DataFrame(rows, columns=["id", "geom"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(col).alias("g")).mapInPandas(run, f"id long, geom {POLY}")


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """(id, geom) of a Parquet table (geom as nested arrays, wkt or wkb) or of GeoJSON files."""
    if path.endswith((".json", ".geojson")):

        def run(batches):
            for b in batches:
                rows = [(k, [[list(map(float, p[:2])) for p in r] for r in part]) for text in b["value"] for k, parts in enumerate(_geojson(text), 1) for part in parts]
                yield pd.DataFrame(rows, columns=["id", "geom"])

        return spark.read.text(path, wholetext=True).mapInPandas(run, f"id long, geom {POLY}")
    table = spark.read.parquet(path)
    for form in ("wkt", "wkb"):
        if form in table.columns:
            return polygons(table, form, "id", form)
    if "geom" not in table.columns:
        raise InputError("a polygon table has a column geom, wkt or wkb")
    return table.select(F.col("id").cast("long").alias("id"), "geom")


def union_layers(layers: list[DataFrame]) -> DataFrame:
    """Several layers as one."""
    out = layers[0]
    for x in layers[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out
