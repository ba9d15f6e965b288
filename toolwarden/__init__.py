"""Spark-native security analytics for catalogs of agent-callable tools."""
