"""Spark-native analytics of 2-D and 3-D point clouds: neighbours, interpolation, sampling, rays, indexes."""
