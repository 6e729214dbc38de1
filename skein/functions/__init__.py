"""Spark-native analytics over versioned code graphs."""
