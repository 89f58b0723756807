"""Spark-native analytics for windowed time series, directed networks and model evaluation."""
