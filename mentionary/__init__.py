"""Spark-native entity linking, topic-graph analytics and text matching."""
