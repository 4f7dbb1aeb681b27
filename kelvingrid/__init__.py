"""A Spark-native engine for planning pipe-network connections from GeoJSON scenarios."""
