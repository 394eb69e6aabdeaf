"""Spark-native processing of machine-graded answer sheets."""
