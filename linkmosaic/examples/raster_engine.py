"""Corridors of the raster that the table `part` holds: python raster_engine.py FOLDER_OF_TABLES."""

import sys

from pyspark.sql import SparkSession

from linkmosaic.plans.raster import find_corridors
from linkmosaic.sources import fixtures

if __name__ == "__main__":
    spark = SparkSession.builder.getOrCreate()
    cells, meta = fixtures.raster(spark, sys.argv[1])
    print(find_corridors(cells, meta, patch_ranges=[fixtures.HABITAT], budget=120, min_patch_size=5, max_search_distance=12, obstacle_ranges=[fixtures.OBSTACLE]).describe())
