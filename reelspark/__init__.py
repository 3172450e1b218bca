"""Spark-native analytics for preparing image, video and text datasets."""
