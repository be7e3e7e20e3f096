"""A Spark-native engine for sparse longitudinal score data."""
