"""A PySpark-native engine for map features, point clouds, rasters and tracks."""
