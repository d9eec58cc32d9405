"""Spark-native analytics for functional-imaging movies, traces and footprints."""
