"""Masks over raster cells: values, ranges, obstacles, clearance and erosion."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkmosaic.errors import InputError
from linkmosaic.sources.schema import RasterMeta


def in_values(col: str, values: Sequence[float]) -> Column:
    """Whether the cell's value is among those given; null is not. No values: an error."""
    if not len(values):
        raise InputError("at least one value is needed")
    return F.coalesce(F.col(col).isin([float(v) for v in values]), F.lit(False))


def in_values_or_ranges(col: str, values: Sequence[float] = (), ranges: Iterable[Sequence[float]] = ()) -> Column | None:
    """Whether the value is given or in a closed range; ranges of fewer than two numbers are skipped; None if nothing is given."""
    terms = [F.col(col).isin([float(v) for v in values])] if len(values) else []
    terms += [F.col(col).between(float(min(r)), float(max(r))) for r in ranges if len(r) > 1]
    if not terms:
        return None
    out = terms[0]
    for t in terms[1:]:
        out = out | t
    return F.coalesce(out, F.lit(False))


def disc_offsets(width: float) -> list[tuple[int, int]]:
    """Offsets (dr, dc) within half the rounded width of the centre; a width of 1 or less is the centre alone."""
    w = max(1, round(width))
    reach = w // 2
    limit = (w / 2) ** 2 + 1e-9
    if w <= 1:
        return [(0, 0)]
    return [(dr, dc) for dr in range(-reach, reach + 1) for dc in range(-reach, reach + 1) if dr * dr + dc * dc <= limit]


def square_offsets(radius: int) -> list[tuple[int, int]]:
    return [(dr, dc) for dr in range(-radius, radius + 1) for dc in range(-radius, radius + 1)]


def kernel(offsets: list[tuple[int, int]]) -> list[list[int]]:
    """The offsets as a square matrix of 0 and 1."""
    reach = max(max(abs(a), abs(b)) for a, b in offsets)
    held = set(offsets)
    return [[int((a, b) in held) for b in range(-reach, reach + 1)] for a in range(-reach, reach + 1)]


def shifted(cells: DataFrame, offsets: list[tuple[int, int]], meta: RasterMeta) -> DataFrame:
    """cells(r, c, ...) moved by every offset, inside the raster: adds tr, tc, target.  The offsets are a literal array."""
    steps = F.array(*[F.struct(F.lit(a).cast("long").alias("dr"), F.lit(b).cast("long").alias("dc")) for a, b in offsets])
    out = cells.withColumn("_o", F.explode(steps)).withColumn("tr", F.col("r") + F.col("_o.dr")).withColumn("tc", F.col("c") + F.col("_o.dc")).drop("_o")
    out = out.filter(F.col("tr").between(1, meta.nrow) & F.col("tc").between(1, meta.ncol))
    return out.withColumn("target", (F.col("tr") - 1) * meta.ncol + F.col("tc"))


def clearance(cells: DataFrame, meta: RasterMeta, width: float, passable: str = "passable", obstacle: str = "obstacle") -> DataFrame:
    """Keeps `passable` only where every disc offset is inside the raster and free of obstacles.

    The cells that an obstacle blocks are found from the obstacles' side: few cells are moved, then taken
    away by an anti-join.
    """
    offsets = disc_offsets(width)
    if len(offsets) <= 1:
        return cells
    reach = max(abs(a) for a, _ in offsets)
    inside = F.col("r").between(1 + reach, meta.nrow - reach) & F.col("c").between(1 + reach, meta.ncol - reach)
    blocked = shifted(cells.filter(F.col(obstacle)).select("r", "c"), offsets, meta).select(F.col("target").alias("cell")).distinct()
    marked = cells.join(blocked.withColumn("_blocked", F.lit(True)), "cell", "left")
    return marked.withColumn(passable, F.col(passable) & inside & F.col("_blocked").isNull()).drop("_blocked")


def erode(cells: DataFrame, mask: str, width: int, name: str = "eroded", strip: int = 4096) -> DataFrame:
    """Square erosion, outside counting as 0: a running minimum along rows, then along columns, by range frames.

    Absent cells count as 0 too.  Rows and columns are cut into strips with a rim, so no window is longer
    than strip + 2 * reach cells.
    """
    reach = int(width) // 2
    if reach < 1:
        return cells.withColumn(name, F.col(mask))

    def along(df: DataFrame, line: str, place: str, col: str, out: str) -> DataFrame:
        blocks = F.array_distinct(F.array(*[F.floor((F.col(place) + d) / strip).cast("long") for d in (-reach, 0, reach)]))
        rimmed = df.withColumn("_b", F.explode(blocks))
        w = Window.partitionBy(line, "_b").orderBy(place).rangeBetween(-reach, reach)
        total = F.sum(F.col(col).cast("int")).over(w)
        return rimmed.withColumn(out, total == 2 * reach + 1).filter(F.col("_b") == F.floor(F.col(place) / strip)).drop("_b")

    return along(along(cells, "r", "c", mask, "_row"), "c", "r", "_row", name).drop("_row")


def value_summary(cells: DataFrame, most: int = 10, sample: float | None = None, seed: int = 1) -> DataFrame:
    """value, n, percent of the commonest values, ties to the smaller; nulls are not counted in percent's base."""
    if sample is not None:
        cells = cells.sample(sample, seed)
    held = cells.filter(F.col("value").isNotNull())
    counts = held.groupBy("value").agg(F.count("*").alias("n"))
    total = held.agg(F.count("*").alias("total"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(most)
    return top.crossJoin(F.broadcast(total)).select("value", "n", (100.0 * F.col("n") / F.col("total")).alias("percent"))
