"""Masks and value counts over a stream of raster cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmosaic.operators import masks
from linkmosaic.sources.schema import CELLS


def read_cells(spark: SparkSession, folder: str, files_a_trigger: int = 1) -> DataFrame:
    """Parquet files of cells, as they come into a folder."""
    return spark.readStream.schema(CELLS).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def mask_counts(cells: DataFrame, values=(), ranges=()) -> DataFrame:
    """Cells in and out of the mask in each row of the raster, kept up to date as cells come in."""
    mask = masks.in_values_or_ranges("value", values, ranges)
    return cells.withColumn("habitat", mask).groupBy("r").agg(F.count(F.when(F.col("habitat"), 1)).alias("habitat"), F.count("*").alias("cells"))
