"""Lumenlake: Spark-native embedding retrieval, data quality and retrieval analytics."""
