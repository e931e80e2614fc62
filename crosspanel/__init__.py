"""Spark-native cross-sectional factor research and portfolio analytics."""
