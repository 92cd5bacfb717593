"""Spark-native analytics for stacks of complex time series on geographic points."""
