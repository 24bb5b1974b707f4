"""Spark-native analytics for gossip receipts, graph views and table life cycles."""
