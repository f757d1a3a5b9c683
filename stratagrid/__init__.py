"""Spark-native analytics for point clouds, rasters and the survey catalogs that describe them."""
