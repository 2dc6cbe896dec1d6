"""Spark-native reconciliation of land records observed by several sources."""
