"""Spark-native analytics for mobile physiological and environmental recordings."""
