"""Rasters, graphs, points and rectangles derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkmosaic.sources.schema import RasterMeta

WIDTH = 50
HABITAT = (1.0, 15.0)
OBSTACLE = (46.0, 50.0)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, RasterMeta]:
    """Cells of `part`, 50 a row: the value is p_size."""
    part = read(spark, sf_dir, "part")
    cells = part.select(
        (F.col("p_partkey") + 1).alias("cell"),
        (F.floor(F.col("p_partkey") / WIDTH) + 1).cast("long").alias("r"),
        (F.col("p_partkey") % WIDTH + 1).cast("long").alias("c"),
        F.col("p_size").cast("double").alias("value"),
    )
    n = part.count()
    return cells, RasterMeta(nrow=-(-n // WIDTH), ncol=WIDTH)


def nation_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(id, weight), edges(u, v, id, cost)) of trade between nations."""
    supplier = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customer = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    nations = (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .filter("s_nationkey <> c_nationkey")
    )
    edges = nations.groupBy(
        F.least("s_nationkey", "c_nationkey").cast("long").alias("u"), F.greatest("s_nationkey", "c_nationkey").cast("long").alias("v")
    ).agg(F.count("*").alias("cost"))
    edges = edges.withColumn("id", F.row_number().over(Window.orderBy("u", "v")).cast("long"))
    nodes = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    weights = customer.groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.count("*").cast("double").alias("weight"))
    return nodes.join(weights, "id", "left").fillna(0.0, ["weight"]), edges


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(key.alias("id"), (key % 40).cast("double").alias("x"), F.floor(key / 40).cast("double").alias("y"))


def rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    return read(spark, sf_dir, "supplier").select(
        k.alias("id"),
        ((k % 10) * 220).cast("double").alias("xmin"),
        (F.floor(k / 10) * 220).cast("double").alias("ymin"),
        (60 + n * 2).cast("double").alias("w"),
        (60 + (k * 7) % 50).cast("double").alias("h"),
    )


def rectangle_polygons(rects: DataFrame) -> DataFrame:
    """id, geom: one ring a rectangle."""
    x0, y0, x1, y1 = F.col("xmin"), F.col("ymin"), F.col("xmin") + F.col("w"), F.col("ymin") + F.col("h")
    ring = F.array(*[F.array(a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))])
    return rects.select("id", F.array(ring).alias("geom"))
