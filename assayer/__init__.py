"""Spark-native evaluation of model predictions."""
