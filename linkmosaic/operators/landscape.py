"""Landscape metrics of masks and polygons, and the report that sets two masks side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmosaic.functions.units import area_divisor, distance_factor, unit_labels
from linkmosaic.operators.labels import label_patches
from linkmosaic.sources.schema import RasterMeta

METRICS = ("total_area", "num_patches", "total_edge", "mesh", "split", "lps", "lpi", "pd", "ed", "msi", "mean_para", "frac", "ai", "cai", "mean_gyrate")
#: Names, metrics and notes of the report's rows, in order; {a} and {d} are the units of areas and distances.
ROWS = (
    ("Num. Patches (NP)", "num_patches", "count"),
    ("Num. Connected Groups", "groups", "Post = networks"),
    ("Total Area", "total_area", "{a}"),
    ("Eff. Mesh Size", "mesh", "{a} (effective connected habitat)"),
    ("Largest Patch Size", "lps", "{a}"),
    ("Splitting Index", "split", "Higher = more fragmented"),
    ("Largest Patch Index (LPI)", "lpi", "% of landscape"),
    ("Mean Shape Index (MSI)", "msi", "1 = compact, higher = irregular"),
    ("Edge Density (ED)", "ed", "{d} edge per {a}"),
    ("Aggregation Index (AI)", "ai", "0 = Dispersed, 100 = Clumped"),
    ("Core Area Index (CAI)", "cai", "% core habitat"),
)
WIDE = 100


def edge_map(cells: DataFrame) -> DataFrame:
    """cells(cell, r, c, ...) of a mask -> with n4, the neighbours in the mask, and edge = 4 - n4.

    Two range windows find the neighbours in the row and in the column; no join.  A strip of rows or
    columns is a window of its own as in a raster's own lines.
    """
    beside = F.count("*").over(Window.partitionBy("r").orderBy("c").rangeBetween(-1, 1)) - 1
    above = F.count("*").over(Window.partitionBy("c").orderBy("r").rangeBetween(-1, 1)) - 1
    return cells.withColumn("_h", beside).withColumn("n4", F.col("_h") + above).drop("_h").withColumn("edge", 4 - F.col("n4"))


def mask_metrics(mask: DataFrame, meta: RasterMeta, units: str = "pixels", gyrate_limit: int = 1000, gyrate_first: int = 200) -> DataFrame:
    """One row of METRICS for the cells (cell, r, c) of a mask; patches by 8-connectivity; an empty mask gives zeros.

    Cells are aggregated to patches, patches to the landscape: both aggregates are combined before the
    shuffle.  With more than gyrate_limit patches the mean gyration radius is that of the first
    gyrate_first ids, as the definition has it.
    """
    labels = edge_map(label_patches(mask, meta, 8))
    res, cell, div, mult = meta.res_mean, meta.cell_area, area_divisor(units), distance_factor(units)
    core = F.count(F.when(F.col("n4") == 4, 1))
    centre = labels.groupBy("patch_id").agg(
        F.count("*").alias("n"), F.sum("edge").alias("edges"), core.alias("core"), F.avg("c").alias("mc"), F.avg("r").alias("mr")
    )
    away = F.sqrt(((F.col("c") - F.col("mc")) * meta.res_x) ** 2 + ((F.col("r") - F.col("mr")) * meta.res_y) ** 2)
    spread = labels.join(centre.select("patch_id", "mc", "mr"), "patch_id").groupBy("patch_id").agg(F.avg(away).alias("gyrate"))
    patches = centre.join(spread, "patch_id")
    area, side = F.col("n") * cell, F.col("edges") * res
    a = area / div
    frac = F.when((area != 1) & (side > 0), 2 * F.log(0.25 * side) / F.log(area))
    sums = patches.agg(
        F.sum(a).alias("A"),
        F.sum(a * a).alias("A2"),
        F.max(a).alias("lps"),
        F.count("*").cast("double").alias("np"),
        F.sum("n").cast("double").alias("N"),
        F.sum("edges").cast("double").alias("E"),
        F.sum("core").cast("double").alias("core"),
        F.avg(0.25 * side / F.sqrt(area)).alias("msi"),
        F.avg(side / area).alias("para"),
        F.avg(frac).alias("frac"),
        F.avg("gyrate").alias("g_all"),
        F.avg(F.when(F.col("patch_id") <= gyrate_first, F.col("gyrate"))).alias("g_first"),
    )
    n, e = F.col("N"), F.col("E")
    bottom = 2 * n - 2 * F.sqrt(n) - 2
    total_edge = e * res * mult
    values = {
        "total_area": F.col("A"), "num_patches": F.col("np"), "total_edge": total_edge,
        "mesh": F.col("A2") / F.col("A"), "split": F.col("A") * F.col("A") / F.col("A2"),
        "lps": F.col("lps"), "lpi": 100 * F.col("lps") / F.col("A"), "pd": 100 * F.col("np") / F.col("A"), "ed": total_edge / F.col("A"),
        "msi": F.col("msi"), "mean_para": F.col("para"), "frac": F.col("frac"),
        "ai": F.when(bottom > 0, (4 * n - e) / 2 / bottom * 100), "cai": 100 * F.col("core") / n,
        "mean_gyrate": F.when(F.col("np") > gyrate_limit, F.col("g_first")).otherwise(F.col("g_all")) * mult,
    }
    return sums.select(*[F.coalesce(values[k], F.lit(0.0)).alias(k) for k in METRICS])


def polygon_metrics(shapes: DataFrame, units: str = "metric") -> DataFrame:
    """(area, perimeter) in metres -> one row of METRICS; shape measures in converted units, grid measures 0."""
    a, p = F.col("area") / area_divisor(units), F.col("perimeter") * distance_factor(units)
    fine = (F.col("area") > 0) & (F.col("perimeter") > 0)
    frac = F.when((a > 0) & (a != 1) & (p > 0), 2 * F.log(0.25 * p) / F.log(a))
    s = shapes.filter(fine).agg(
        F.sum(a).alias("A"), F.sum(a * a).alias("A2"), F.max(a).alias("lps"), F.count("*").cast("double").alias("np"), F.sum(p).alias("E"),
        F.avg(0.25 * p / F.sqrt(a)).alias("msi"), F.avg(p / a).alias("para"), F.avg(frac).alias("frac"),
    )
    zero = F.lit(0.0)
    values = {
        "total_area": F.col("A"), "num_patches": F.col("np"), "total_edge": F.col("E"), "mesh": F.col("A2") / F.col("A"),
        "split": F.col("A") * F.col("A") / F.col("A2"), "lps": F.col("lps"), "lpi": 100 * F.col("lps") / F.col("A"),
        "pd": 100 * F.col("np") / F.col("A"), "ed": F.col("E") / F.col("A"), "msi": F.col("msi"), "mean_para": F.col("para"),
        "frac": F.col("frac"), "ai": zero, "cai": zero, "mean_gyrate": zero,
    }
    return s.select(*[F.coalesce(values[k], zero).alias(k) for k in METRICS])


def connected_groups(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row `groups`: labels of `after` that hold cells of two or more labels of `before`; both (cell, patch_id)."""
    both = after.select("cell", F.col("patch_id").alias("post")).join(before.select("cell", F.col("patch_id").alias("pre")), "cell")
    joined = both.groupBy("post").agg(F.count_distinct("pre").alias("k")).filter("k >= 2")
    return joined.agg(F.count("*").alias("groups"))


def report_rows(pre: DataFrame, post: DataFrame, meta: RasterMeta, units: str = "pixels") -> DataFrame:
    """ord, item, pre, post, note: the report's rows as a table; pre and post are masks (cell, r, c)."""
    groups = connected_groups(label_patches(pre, meta, 8), label_patches(post, meta, 8)).select(F.col("groups").cast("double"))
    area, step = unit_labels(units)
    sides = []
    for mask, joined in ((pre, None), (post, groups)):
        row = mask_metrics(mask, meta, units)
        row = row.withColumn("groups", F.lit(0.0)) if joined is None else row.crossJoin(F.broadcast(joined))
        rows = [F.struct(F.lit(i).alias("ord"), F.lit(name).alias("item"), F.col(k).alias("value"), F.lit(note.format(a=area, d=step)).alias("note")) for i, (name, k, note) in enumerate(ROWS)]
        sides.append(row.select(F.inline(F.array(*rows))))
    a, b = sides[0].withColumnRenamed("value", "pre"), sides[1].select("ord", F.col("value").alias("post"))
    return a.join(b, "ord").select("ord", "item", "pre", "post", "note")


def report_lines(rows: DataFrame, label: str = "Landscape") -> list[str]:
    """The rows as text: columns of 30, 15 and 15 characters and a last one, with bars between."""
    whole = F.col("ord") < 2
    shown = lambda c: F.when(whole, F.format_number(c, 0)).otherwise(F.format_string("%.2f", c))
    line = F.format_string("%-30s | %-15s | %-15s | %s", "item", shown("pre"), shown("post"), "note")
    body = [x[0] for x in rows.orderBy("ord").select(line).collect()]
    head = f"{'METRIC NAME':<30} | {'PRE':<15} | {'POST':<15} | INTERPRETATION"
    return ["=" * WIDE, f" LANDSCAPE ANALYSIS: {label}", "=" * WIDE, head, "-" * WIDE, *body, "=" * WIDE]
