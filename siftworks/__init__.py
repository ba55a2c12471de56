"""Spark-native building and scoring of evaluation data sets."""
