"""PySpark-native analytics over media collections: similarity joins, clustering, timelines, quality and results."""
