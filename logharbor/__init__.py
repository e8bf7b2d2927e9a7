"""Spark-native governance of slow-query logs and the tables around them."""
