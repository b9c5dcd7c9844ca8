"""Corridors between the rectangles of the table `supplier`: python vector_engine.py FOLDER_OF_TABLES."""

import sys

from pyspark.sql import SparkSession

from linkmosaic.plans.vector import find_corridors
from linkmosaic.sources import fixtures

if __name__ == "__main__":
    spark = SparkSession.builder.getOrCreate()
    shapes = fixtures.rectangle_polygons(fixtures.rectangles(spark, sys.argv[1]))
    print(find_corridors(shapes, 2.0, crs=32618, min_patch_size=0.1, min_corridor_width=20, max_search_distance=200).describe())
